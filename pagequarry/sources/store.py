"""Captured pages kept in buckets by URL, with an index of the links to next pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .pages import one_capture, only_chosen


class CaptureStore:
    """Two tables under ``path``: the captures, and the next-page links they hold.

    Both are bucketed and sorted by URL, so joins of them on it shuffle only the other
    side, however large the pages are. Links are parsed once, as captures come in; walks
    read them instead of pages. ``rules`` lists the next-page selectors to index besides
    the automatic rule, which goes by the name ``""``.

    ``add`` may be run again after a failure: captures known by id and URL are left out,
    and a link that is there twice counts once.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64, rules: tuple[str, ...] = ()):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        self.rules = ("", *rules)

    def _append(self, rows: DataFrame, kind: str) -> None:
        # dealt by bucket first: a task writes one file and not one per bucket
        dealt = rows.repartition(self.buckets, "url")
        writer = dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "url").sortBy("url")
        writer.option("path", f"{self.path}/{kind}").saveAsTable(f"{self.name}_{kind}")

    def _table(self, kind: str) -> DataFrame:
        # streams write in a session of their own, so the file list known here may be old
        self.spark.catalog.refreshTable(f"{self.name}_{kind}")
        return self.spark.table(f"{self.name}_{kind}")

    @property
    def pages(self) -> DataFrame:
        """All captures: ``page_id, url, html`` and what else they came with."""
        return self._table("pages")

    @property
    def links(self) -> DataFrame:
        """``rule, page_id, url, next_url`` of every capture that links to a next page."""
        return self._table("links")

    def add(self, captures: DataFrame) -> None:
        """Take in captures ``page_id, url, html``, with ``fetched_at`` where it is known."""
        from ..operators.paginate import rule_links

        if self.spark.catalog.tableExists(f"{self.name}_pages"):
            known = self.pages.select("url", "page_id")
            captures = captures.join(known, ["url", "page_id"], "left_anti").select(*self.pages.columns)
        # links first: after a failure in between the captures are still new
        for rule in self.rules:
            found = rule_links(captures, rule or None)
            self._append(found.select(F.lit(rule).alias("rule"), "page_id", "url", "next_url"), "links")
        self._append(captures, "pages")

    def latest(self) -> DataFrame:
        """``url, page_id`` of the capture that counts for each URL; without an exchange."""
        return one_capture(self.pages.drop("html"))

    def index(self) -> DataFrame:
        """The links of the captures that count, as :func:`walk_pages` reads them."""
        return stage(only_chosen(self.links, self.latest()).distinct(), "index")
