"""Reading captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import semi_join, stage


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``page_id, url, html`` from parquet, orc, json lines, or one html file per page.

    For html files the file name is the URL, percent-encoded, and the id a hash of the
    whole path, so equal names in two folders are two pages.
    """
    if fmt == "html":
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
        )
        # Spark escapes the name once more; a plus sign is itself in both
        decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
        url = decode(F.regexp_replace(decode(F.col("name")), r"\.html?$", ""))
        return raw.select(F.xxhash64("path").alias("page_id"), url.alias("url"), "html")
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")


def pages_for(pages: DataFrame, urls: DataFrame, fits: int = 1_000_000) -> DataFrame:
    """The captured pages of a URL set, one per URL; runs before anything is parsed.

    The captures are chosen by narrow columns. The ids of up to ``fits`` of them, counted
    first (eight bytes each), are sent to the tasks, so pages don't move; more are joined
    by URL, which moves no page either where ``pages`` is bucketed by it, as in a
    :class:`~pagequarry.sources.store.CaptureStore`.
    """
    captured = stage(one_capture(semi_join(pages.drop("html"), urls, "url")), "captured")
    if captured.limit(fits + 1).count() <= fits:
        found = pages.join(F.broadcast(captured.select("page_id")), "page_id", "left_semi")
    else:
        found = only_chosen(pages, captured)
    return found.select("page_id", "url", "html")


def only_chosen(rows: DataFrame, captured: DataFrame) -> DataFrame:
    """The ``rows`` of the captures that count. The ids are compared by two bounds: as an
    equality they would become a key of the join, and buckets by URL alone wouldn't do."""
    chosen = captured.select("url", F.col("page_id").alias("_chosen"))
    return rows.join(chosen, "url").where("page_id >= _chosen and page_id <= _chosen").drop("_chosen")


def one_capture(pages: DataFrame) -> DataFrame:
    """``url, page_id``: of several captures of a URL the newest by ``fetched_at``, where
    there is such a column; then the one with the smallest id."""
    if "fetched_at" not in pages.columns:
        return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    newest = F.min_by("page_id", F.struct((-F.unix_micros(F.col("fetched_at").cast("timestamp"))).alias("age"), "page_id"))
    return pages.groupBy("url").agg(newest.alias("page_id"))


def resolve_urls(
    spark: SparkSession,
    url: str | None = None,
    url_list: list[str] | None = None,
    page_template: str | None = None,
    page_range: str | None = None,
    max_pages: int = 10_000,
) -> DataFrame:
    """The URLs of a job with their order, ``url, ord``: a list, else a template with a
    range, else one URL."""
    from .frontier import expand_template

    if url_list:
        return spark.createDataFrame([(u, i) for i, u in enumerate(url_list)], "url string, ord bigint")
    if page_template and page_range:
        spec = spark.createDataFrame([(page_template, page_range)], "template string, pages string")
        return expand_template(spec, "template", "pages", max_pages).select(
            "url", F.col("pos").cast("bigint").alias("ord")
        )
    if url:
        return spark.createDataFrame([(url, 0)], "url string, ord bigint")
    raise ValueError("give url, url_list, or page_template with page_range")
