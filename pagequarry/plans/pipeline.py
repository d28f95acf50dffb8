"""From captured pages to a finished table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells as long
from ..operators import follow as details
from ..operators import profile, selectors, shape, sinks, versions
from ..operators.heuristic import heuristic_cells
from ..operators.paginate import walk_pages
from ..session import stage
from ..sources.pages import pages_for, resolve_urls
from ..sources.shred import failures
from . import registry
from .spec import ExtractSpec

# Where a row comes from. Names no field has, so that any field name works.
KEYS = ("__page_ord", "__page_id", "__row_idx", "__url")


@dataclass
class ExtractResult:
    """A lazy table plus its profile. Rows are ordered by the key columns.

    ``failed`` has the ``page_id``, ``url`` and ``error`` of pages that could not be parsed.
    """

    table: DataFrame
    visited: DataFrame
    spec: ExtractSpec
    failed: DataFrame | None = None
    started: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    @property
    def columns(self) -> list[str]:
        return shape.data_columns(self.table, KEYS)

    def rows(self) -> DataFrame:
        return self.table.select(*map(text.named, self.columns))

    def typed(self) -> DataFrame:
        return profile.coerce(self.table, keys=KEYS)

    def stats(self) -> DataFrame:
        return profile.quality(self.table, keys=KEYS)

    def preview(self, n: int = 5) -> DataFrame:
        return profile.preview(self.table, n, KEYS).select(*map(text.named, self.columns))

    def _shaped(self, fmt: str, options: dict) -> tuple[DataFrame, dict]:
        table = self.typed() if self.spec.typed else self.table
        if fmt == "csv":
            options.setdefault("safe", self.spec.csv_safe)
        if fmt in ("json", "jsonl"):
            options.setdefault("policy", self.spec.null_policy)
            options.setdefault("normalise", self.spec.normalize_keys)
        return table, {"drop_empty": self.spec.drop_empty, "sort": self.spec.sort_columns, **options}

    def _provenance(self) -> DataFrame:
        now = datetime.now(timezone.utc).isoformat()
        how = {"started": self.started, "finished": now, "extractor": self.spec.extractor}
        return sinks.provenance(self.visited, **how, selectors=self.spec.selectors, sample=0)

    def write(self, fmt: str, path: str, on_empty: str = "raise", **options) -> bool:
        """Write the table and the reports asked for. Whether there was a table to write:
        an empty one raises ``EmptyTable``, or writes nothing with ``on_empty="skip"``."""
        table, options = self._shaped(fmt, options)
        try:
            registry.sink(fmt)(table, path, keys=KEYS, **options)
        except sinks.EmptyTable:
            if on_empty != "skip":
                raise
            return False
        if self.spec.quality_report:
            sinks.write_quality(self.stats(), path)
        if self.spec.provenance:
            sinks.write_provenance(self._provenance(), path, self.visited)
        return True

    def publish(self, fmt: str, path: str, on_empty: str = "raise", **options) -> int | None:
        """Write the table, its reports, the visited URLs and the failed pages as one version.

        The version counts once all of it stands; ``versions.read_part`` reads it. Returns
        its number, or None for an empty table under ``on_empty="skip"``, when the version
        before stays.
        """
        table, options = self._shaped(fmt, options)
        parts = {"rows": lambda to: registry.sink(fmt)(table, to, keys=KEYS, **options)}
        if self.spec.quality_report:
            parts["quality"] = lambda to: self.stats().coalesce(1).write.json(to)
        if self.spec.provenance:
            parts["provenance"] = lambda to: self._provenance().coalesce(1).write.json(to)
            parts["urls"] = lambda to: self.visited.select("url").distinct().write.parquet(to)
        if self.failed is not None:
            parts["failed"] = lambda to: self.failed.write.parquet(to)
        try:
            return versions.publish(table.sparkSession, path, fmt, parts)
        except sinks.EmptyTable:
            if on_empty != "skip":
                raise
            return None


def extract_cells(pages: DataFrame, spec: ExtractSpec) -> DataFrame:
    """``page_id, row_idx, col, col_ord, value`` of the discovering extractors, long."""
    if spec.extractor == "heuristic":
        return heuristic_cells(pages, spec.heuristic())
    return registry.extractor(spec.extractor)(pages, spec)


def keyed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``page_id, row_idx`` and further columns under reserved keys and these names."""
    fields = [c for c in rows.columns if c not in ("page_id", "row_idx")]
    picks = [text.named(c).alias(n) for c, n in zip(fields, text.unclashing(names, KEYS))]
    return rows.select(F.col("page_id").alias("__page_id"), F.col("row_idx").alias("__row_idx"), *picks)


def selected(pages: DataFrame, selectors_: dict[str, str], row_selector=None, attribute=None) -> DataFrame:
    """Rows by selectors, under reserved keys; fields have inner names until the end."""
    inner = {f"f{i}": selector for i, selector in enumerate(selectors_.values())}
    if row_selector:
        rows = selectors.extract_rows(pages, row_selector, inner, attribute)
    else:
        rows = long.to_wide(selectors.extract_flat(pages, inner, attribute), list(inner))
    return keyed(rows.select("page_id", "row_idx", *inner), list(selectors_))


def discovered(cells: DataFrame, most: int = 2000) -> DataFrame:
    """Long cells as a wide table under reserved keys.

    The cells are written out first, so that pages are parsed once and not once for the
    names and once for the rows. Of more than ``most`` names none is gathered, and
    ``ValueError`` is raised: name the columns to keep, or take ``run_long``.
    """
    cells = stage(cells, "cells")
    names = long.discover_columns(cells, most)
    inner = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, f"f{i}")]) if names else None
    found = cells.withColumn("col", inner[F.col("col")]) if names else cells
    return keyed(long.to_wide(found, [f"f{i}" for i in range(len(names))]), names)


def extract_wide(pages: DataFrame, spec: ExtractSpec) -> DataFrame:
    """``__page_id, __row_idx`` and one string column per field."""
    if spec.extractor == "selector":
        return selected(pages, spec.selectors, spec.row_selector, spec.attribute)
    return discovered(extract_cells(pages, spec), spec.max_columns)


def _chosen_pages(pages: DataFrame, spec: ExtractSpec, index: DataFrame | None) -> DataFrame:
    """The job's pages with their order; all pages when it names none."""
    if not (spec.url or spec.url_list or spec.page_template):
        return pages.select("page_id", "url", "html").withColumn("page_ord", F.col("page_id"))
    wanted = resolve_urls(
        pages.sparkSession, spec.url, spec.url_list, spec.page_template, spec.pages, spec.max_pages_limit
    )
    if spec.auto_paginate:
        route = walk_pages(pages, wanted, spec.max_auto_pages, index=index)
        order = route.groupBy("url").agg(F.min("depth").cast("bigint").alias("page_ord"))
    else:
        order = wanted.groupBy("url").agg(F.min("ord").alias("page_ord"))
    return pages_for(pages, order).join(order, "url")


def failed_pages(chosen: DataFrame) -> DataFrame:
    """``page_id, url, error`` of the pages that could not be parsed."""
    return failures(chosen).join(chosen.select("page_id", "url"), "page_id").select("page_id", "url", "error")


def run(pages: DataFrame, spec: ExtractSpec, index: DataFrame | None = None) -> ExtractResult:
    """Extract, follow, shape. Only the pages the job names are parsed, and once: the
    table is written out before shaping, profiling and export go over it. With the
    ``index`` of a capture store a walk parses nothing."""
    chosen = _chosen_pages(pages, spec, index)
    table = extract_wide(chosen, spec).join(places(chosen), "__page_id")
    if spec.follow_field and spec.follow_selectors:
        table = details.follow(
            table,
            pages,
            spec.follow_field,
            spec.follow_selectors,
            base="__url",
            prefix=spec.follow_url_prefix,
            row_selector=spec.follow_row_selector,
            on_miss="skip" if spec.follow_skip_on_error else "fail",
        )
    return ExtractResult(finish(stage(table, "table"), spec), chosen.select("url"), spec, failed_pages(chosen))


def run_long(pages: DataFrame, spec: ExtractSpec, index: DataFrame | None = None) -> DataFrame:
    """``page_ord, url, row_idx, col, col_ord, value``: the cells without a wide table.

    For crawls of many sites, whose column names grow with the sites: nothing is
    gathered to name columns, and any sink can write the rows as they are.
    """
    chosen = _chosen_pages(pages, spec, index)
    cells = extract_cells(chosen, spec).where("col is not null")
    rows = cells.join(chosen.select("page_id", "page_ord", "url"), "page_id")
    return rows.select("page_id", "page_ord", "url", "row_idx", "col", "col_ord", "value")


def places(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        F.col("page_id").alias("__page_id"), F.col("page_ord").alias("__page_ord"), F.col("url").alias("__url")
    )


def finish(table: DataFrame, spec: ExtractSpec, deduplicate: bool | None = None) -> DataFrame:
    return shape.shape(
        table,
        trim_cells=spec.trim_cells,
        keep=spec.keep_columns,
        drop=spec.drop_columns,
        mapping=spec.rename_columns,
        required=spec.required_columns,
        lock_after=spec.schema_lock_after,
        deduplicate=spec.deduplicate if deduplicate is None else deduplicate,
        keys=KEYS,
    )
