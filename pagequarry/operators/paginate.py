"""Next-page links, walks along them, and extraction over a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import semi_join, stage, stage_counted
from ..sources.pages import one_capture
from ..sources.shred import shred
from . import selectors as css

# What marks an anchor as the way to the next page.
NEXT_TEXT = r"(?iU)^(next|next\s+page|next\s*&raquo;|»|>)$"
NEXT_LABELS = ["next", "next page"]
NEXT_CLASS = r"(?iU)\b(next|pagination__next|page-next)\b"


def next_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, next_url`` of every page with a next link.

    The first link with rel next counts if it has a target, then the first such
    anchor, then the first anchor whose text, label or class says next.
    """
    dom = shred(pages, text_for=({"a"}, ()), keep=(("a", "link"), (), ()))
    href = F.try_element_at("attrs", F.lit("href"))
    rel_next = F.array_contains(
        F.split(F.coalesce(F.try_element_at("attrs", F.lit("rel")), F.lit("")), r"\s+"), "next"
    )
    label = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("aria-label")), F.lit("")))
    says_next = (
        F.coalesce("text", F.lit("")).rlike(NEXT_TEXT)
        | label.isin(NEXT_LABELS)
        | F.array_join("classes", " ").rlike(NEXT_CLASS)
    )
    anchor, link = F.col("tag") == "a", F.col("tag") == "link"
    target = F.struct("pre", F.coalesce(href, F.lit("")).alias("href"))
    found = dom.groupBy("page_id").agg(
        F.max(F.when(F.col("pre") == 0, F.try_element_at("attrs", F.lit("url")))).alias("url"),
        F.min(F.when(link & rel_next, target))["href"].alias("link"),
        F.min(F.when(anchor & rel_next, target))["href"].alias("a"),
        F.min(F.when(anchor & href.isNotNull() & says_next, target))["href"].alias("hint"),
    )
    picked = F.coalesce(
        F.nullif("link", F.lit("")), F.nullif("a", F.lit("")), F.col("hint")
    )
    return (
        found.select("page_id", "url", picked.alias("href"))
        .where("href is not null")
        .select("page_id", "url", urls.join(F.col("url"), F.col("href")).alias("next_url"))
    )


def selected_links(pages: DataFrame, next_selector: str) -> DataFrame:
    """``next_links`` by a CSS selector instead."""
    found = css.extract_one(pages, {"href": next_selector}, attribute="href", with_url=True)
    joined = urls.join(F.col("url"), F.col("href"))
    return found.where("href <> ''").select("page_id", "url", joined.alias("next_url"))


def rule_links(pages: DataFrame, next_selector: str | None = None) -> DataFrame:
    """``page_id, url, next_url`` by the selector, or by the automatic rule without one."""
    return selected_links(pages, next_selector) if next_selector else next_links(pages)


def walk(starts: DataFrame, links: DataFrame, max_pages: int = 100, same_origin: bool = True) -> DataFrame:
    """``start, depth, url`` of the pages reached from ``starts(url)``, each once.

    A walk ends at a page without a link, another origin, a page that was not
    captured, a repeat, or after ``max_pages``. The known path doubles each round:
    ``steps`` spans 1, 2, 4, ... links, so a hundred pages take seven rounds, fewer
    when no chain is that long. Only ``steps`` is staged between the rounds.
    """
    steps = links.select(F.col("url").alias("src"), F.col("next_url").alias("dst"))
    if same_origin:
        steps = steps.where(urls.same_origin(F.col("src"), F.col("dst")))
    seen = starts.select(F.col("url").alias("start"), F.lit(0).alias("depth"), "url").distinct()
    span = 1
    steps, many = stage_counted(steps.distinct(), "steps")
    while span < max_pages and many:
        here = F.struct("depth", "url")
        there = F.struct((F.col("depth") + span).alias("depth"), F.col("dst").alias("url"))
        both = F.when(F.col("dst").isNull(), F.array(here)).otherwise(F.array(here, there))
        ahead = seen.join(steps, seen["url"] == steps["src"], "left").select("start", F.inline(both))
        # A walk that entered a loop meets its pages again, only deeper.
        seen = ahead.groupBy("start", "url").agg(F.min("depth").alias("depth"))
        span *= 2
        if span < max_pages:
            a, b = steps.alias("a"), steps.alias("b")
            longer = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
            steps, many = stage_counted(longer.distinct(), "steps")
    return stage(seen.where(F.col("depth") < max_pages).select("start", "depth", "url"), "walk")


def walk_pages(
    pages: DataFrame,
    starts: DataFrame,
    max_pages: int = 100,
    next_selector: str | None = None,
    same_origin: bool = True,
    index: DataFrame | None = None,
) -> DataFrame:
    """``start, depth, page_id, url`` of the captured pages along each walk.

    With ``index``, the links that a :class:`CaptureStore` keeps, no page is parsed. Else a
    walk that keeps to its origin has the pages of that origin parsed. Of several captures
    of a URL one counts.
    """
    placed = pages
    if same_origin:
        origins = starts.select(urls.origin(F.col("url")).alias("__origin"))
        placed = pages.withColumn("__origin", urls.origin(F.col("url")))
        placed = semi_join(placed, origins, "__origin").drop("__origin")
    captured = stage(one_capture(placed.drop("html")), "captured")
    if index is None:
        links = rule_links(semi_join(placed, captured, "page_id"), next_selector)
    else:
        links = semi_join(index.where(F.col("rule") == (next_selector or "")), captured, ["page_id", "url"])
    # A link to a page that was not captured ends the walk.
    links = links.join(captured.select(F.col("url").alias("next_url")), "next_url", "left_semi")
    reached = walk(starts.select("url"), links, max_pages, same_origin)
    return reached.join(captured, "url").select("start", "depth", "page_id", "url")


def extract_paginated(
    pages: DataFrame,
    starts: DataFrame,
    row_selector: str,
    selectors: dict[str, str],
    max_pages: int = 1,
    next_selector: str | None = None,
    same_origin: bool = True,
    index: DataFrame | None = None,
) -> DataFrame:
    """Rows of every page along each walk: ``start, depth, page_id, row_idx``, fields."""
    route = walk_pages(pages, starts, max_pages, next_selector, same_origin, index)
    visited = semi_join(pages, route, "page_id")
    rows = css.extract_rows(visited, row_selector, selectors)
    return route.drop("url").join(rows, "page_id")
