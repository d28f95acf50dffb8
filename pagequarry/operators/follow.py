"""Joining rows with the detail pages they link to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import stage
from ..sources.pages import pages_for
from . import selectors as css


def with_targets(
    rows: DataFrame, field: str, base: str = "url", prefix: str | None = None, out: str = "target"
) -> DataFrame:
    """Add ``out``, the absolute URL behind ``field``, or NULL."""
    target = urls.resolve_follow(text.named(field), text.named(base), prefix)
    return rows.select(*map(text.named, rows.columns), target.alias(out))


def details(
    pages: DataFrame, targets: DataFrame, selectors: dict[str, str], row_selector: str | None = None
) -> DataFrame:
    """``target`` and the fields of the detail pages referred to as ``f``, one row per URL.

    Only pages some row points to are parsed, one capture of each URL.
    """
    wanted = targets.where("target is not null").select(F.col("target").alias("url")).distinct()
    found = pages_for(pages, wanted)
    inner = {f"f{i}": selector for i, selector in enumerate(selectors.values())}
    one = css.extract_one(found, inner, row_selector=row_selector, with_url=True)
    fields = F.struct(*inner)
    return one.select(F.col("url").alias("target"), fields.alias("f"))


def follow(
    rows: DataFrame,
    pages: DataFrame,
    field: str,
    selectors: dict[str, str],
    base: str = "url",
    prefix: str | None = None,
    row_selector: str | None = None,
    on_miss: str = "skip",
) -> DataFrame:
    """``rows`` with the detail fields behind ``field`` merged in.

    A found page overwrites columns of the same name. Without one, new fields are
    ``''`` and existing ones keep their value; ``on_miss="fail"`` stops the query at a
    link whose page was not captured. Rows without a link are never a miss.
    """
    if on_miss not in ("skip", "fail"):
        raise ValueError(f"on_miss must be skip or fail, got {on_miss!r}")
    # Written out once: the links choose the pages to parse and are joined with them.
    linked = stage(with_targets(rows, field, base, prefix, "__target"), "linked")
    found = details(pages, linked.select(F.col("__target").alias("target")), selectors, row_selector)
    found = found.select(F.col("target").alias("__key"), F.col("f").alias("__found"))
    # Rows without a link would all meet in one task under a NULL key; spread them.
    nowhere = F.concat(F.lit(" "), F.xxhash64(*map(text.named, rows.columns)).cast("string"))
    linked = linked.withColumn("__key", F.coalesce("__target", nowhere))
    joined = linked.join(found, "__key", "left")
    hit = F.col("__found").isNotNull()
    if on_miss == "fail":
        lost = F.col("__target").isNotNull() & ~hit
        hit = F.when(
            lost, F.raise_error(F.concat(F.lit("no captured page for "), F.col("__target"))).cast("boolean")
        ).otherwise(hit)
    position = {c: i for i, c in enumerate(selectors)}
    merged = []
    names = [*rows.columns, *[c for c in selectors if c not in rows.columns]]
    for c, name in zip(names, text.unclashing(names)):
        if c not in position:
            merged.append(text.named(c))
            continue
        kept = text.named(c) if c in rows.columns else F.lit("")
        merged.append(F.when(hit, F.col("__found")[f"f{position[c]}"]).otherwise(kept).alias(name))
    return joined.select(*merged)


def misses(rows: DataFrame, pages: DataFrame, field: str, base: str = "url", prefix: str | None = None) -> DataFrame:
    """``target, n_rows`` of links whose page was not captured."""
    linked = with_targets(rows, field, base, prefix, "__target").select(F.col("__target").alias("target"))
    linked = linked.where("target is not null")
    counted = linked.groupBy("target").agg(F.count("*").alias("n_rows"))
    captured = pages.select(F.col("url").alias("target"))
    return counted.join(captured, "target", "left_anti")
