"""Relational steps over the node table: scope, noise, leaves, keys, subtree text.

All of them are windows over ``(page_id, pre)``. A page is one captured document, so
a window partition never exceeds what one input row already held, and all windows
share a single exchange on ``page_id``.
"""

from __future__ import annotations

from collections.abc import Iterable

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Structural elements that never hold data, and the words that mark
# noise in a class, id, role or label. The extractor alone uses the long list, the
# page-to-table flow the short one.
SKIP_TAGS = ["script", "style", "header", "footer", "nav", "noscript", "svg", "iframe",
             "form", "aside"]
FLOW_KEYWORDS = ["nav", "menu", "footer", "header", "sidebar", "breadcrumb", "cookie",
                 "banner", "subscribe", "newsletter", "social"]
ALL_KEYWORDS = FLOW_KEYWORDS + ["popup", "modal", "overlay", "advert", "promo", "skip-link"]


def page():
    return Window.partitionBy("page_id")


def in_order():
    return page().orderBy("pre")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def joined_classes() -> Column:
    return F.coalesce(F.array_join("classes", " "), F.lit(""))


def signature() -> Column:
    return F.concat(F.col("tag"), F.lit(" "), joined_classes())


def field_key() -> Column:
    """The longest class, the first one on equal length, else the tag name."""
    longest = F.aggregate(
        "classes",
        F.lit(""),
        lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best),
    )
    return F.when(F.size("classes") > 0, longest).otherwise(F.col("tag"))


def keyword_pattern(keywords: Iterable[str]) -> str:
    words = "|".join(re.escape(k) for k in keywords)
    return rf"(?iU)(?:^|[\s\x1c-\x1f_-])(?:{words})(?:$|[\s\x1c-\x1f_-])"


def is_noise(skip_tags: Iterable[str] = SKIP_TAGS, keywords: Iterable[str] = ALL_KEYWORDS) -> Column:
    """Whether an element starts a subtree to drop. No keywords: structure only."""
    noise = F.col("tag").isin(list(skip_tags))
    keywords = list(keywords)
    if keywords:
        hay = [joined_classes()] + [
            F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit(""))
            for a in ("id", "role", "aria-label")
        ]
        for h in hay:
            noise = noise | h.rlike(keyword_pattern(keywords))
    return F.coalesce(noise, F.lit(False))


def by_page(rows: DataFrame, *more: str) -> DataFrame:
    """``rows`` exchanged on page_id, and ``more``, over a fixed number of partitions: the windows to come
    cost far more per byte than the merging of small shuffle partitions assumes."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "page_id", *more)


def narrow(dom: DataFrame, noise: Column | None = None) -> DataFrame:
    """The columns the heuristic reads, exchanged on page_id and sorted once.

    Everything costly to carry is reduced before the exchange.
    """
    reduced = dom.select(
        "page_id", "pre", "end", "parent", "tag", "own_len", "up",
        text.normalise(F.col("own")).alias("own"),
        signature().alias("sig"),
        field_key().alias("key"),
        (is_noise() if noise is None else noise).alias("noise"),
    )
    return by_page(reduced).sortWithinPartitions("page_id", "pre")


def in_scope(nodes: DataFrame) -> DataFrame:
    """Rows below the first body element, or below the document when it has none."""
    body = F.min(F.when(F.col("tag") == "body", F.struct("pre", "end"))).over(page())
    return (
        nodes.withColumn("_body", body)
        .where(
            (F.col("pre") > F.coalesce("_body.pre", F.lit(0)))
            & (F.col("_body").isNull() | (F.col("pre") <= F.col("_body.end")))
        )
        .drop("_body")
    )


def alive(nodes: DataFrame) -> DataFrame:
    """Drop noisy subtrees: the largest ``end`` of a noise row so far covers ``pre``."""
    reach = F.max(F.when(F.col("noise"), F.col("end"))).over(so_far())
    return (
        nodes.withColumn("_reach", reach)
        .where(F.coalesce(F.col("_reach") < F.col("pre"), F.lit(True)))
        .drop("_reach", "noise")
    )


def with_leaf(nodes: DataFrame) -> DataFrame:
    """Add ``leaf``: the element has text of its own and no element below it has any."""
    following = F.expr(
        "lead(if(own is not null and tag is not null, pre, null)) ignore nulls "
        "over (partition by page_id order by pre)"
    )
    has_text = F.col("own").isNotNull() & F.col("tag").isNotNull()
    return nodes.withColumn("_next", following).withColumn(
        "leaf", has_text & F.coalesce(F.col("_next") > F.col("end"), F.lit(True))
    ).drop("_next")


def leaf_text(dom: DataFrame, noise: Column | None = None) -> DataFrame:
    """``page_id, pre, tag, key, text`` of every leaf outside the noise."""
    live = with_leaf(alive(in_scope(narrow(dom, noise))))
    return live.where("leaf").select("page_id", "pre", "tag", "key", F.col("own").alias("text"))
