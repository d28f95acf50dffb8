"""Long cells to wide rows and back, and joining the output of several pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import stage
from . import scan


def discover_columns(cells: DataFrame, limit: int | None = None) -> list[str]:
    """The column names in ``cells``, in first-seen order, for a wide table.

    ``limit`` is the caller's: with more names than that it raises. Crawls with very
    many names are better kept long.
    """
    first = F.min(F.struct("page_id", "col_ord"))
    names = cells.where("col is not null").groupBy("col").agg(first.alias("first"))
    names = names.orderBy("first", "col")
    found = (names.limit(limit + 1) if limit is not None else names).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"more than {limit} distinct columns; name the ones to keep")
    return [r["col"] for r in found]


def to_wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ``(page_id, row_idx)`` with ``columns``; missing cells are ``''``.

    Names that differ in case alone, or equal a key, get a suffix, since a table tells
    no such columns apart.
    """
    picks = [
        F.coalesce(F.max(F.when(F.col("col") == c, F.col("value"))), F.lit("")).alias(n)
        for c, n in zip(columns, text.unclashing(columns, ("page_id", "row_idx")))
    ]
    return cells.groupBy("page_id", "row_idx").agg(*picks)


def to_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of ``to_wide``: one cell per row and column, blanks included."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("col"), F.lit(i).alias("col_ord"), text.named(c).alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return rows.select("page_id", "row_idx", F.inline(cells))


def align(parts: list[DataFrame], order: str = "step") -> DataFrame:
    """Append row sets by name, numbering the parts; absent columns become ``''``."""
    names: list[str] = []
    for part in parts:
        names += [c for c in part.columns if c not in names]
    keys = ("page_id", "row_idx")
    numbered = [p.withColumn(order, F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    filled = [text.named(c) if c in keys else F.coalesce(text.named(c), F.lit("")).alias(c) for c in names]
    return union.select(order, *filled)


def positional_concat(cells: DataFrame, chunk: int | None = None) -> DataFrame:
    """Append the columns of all pages end to end, each column on its own.

    Adds ``pos``, the cell's place in its column over all pages in ``page_id`` order.
    Pages with different columns shift against each other; ``align`` does not. Pages are
    dealt by sampled ranges, or by ``chunk`` ids where ids are known to be even. The cells
    are written out once, since they are counted before they are placed.
    """
    cells = stage(cells.select("page_id", "row_idx", "col", "value"), "cells")
    counts = cells.groupBy("page_id", "col").agg(F.count("*").alias("_n"))
    offsets = scan.running_sum(
        counts, ["col"], ["page_id"], F.floor(F.col("page_id") / chunk) if chunk else None, F.col("_n"), "_upto"
    ).select("page_id", "col", (F.col("_upto") - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("page_id", "col").orderBy("row_idx")) - 1
    return (
        cells.withColumn("_rank", rank)
        .join(offsets, ["page_id", "col"])
        .select("col", (F.col("_before") + F.col("_rank")).alias("pos"), "value", "page_id")
    )
