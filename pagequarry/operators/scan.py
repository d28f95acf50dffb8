"""Ordered scans over keys of any size.

A window partitioned by the key alone puts a hot key into one task. Here the rows are
dealt by sampled ranges of (key, order), so that every range holds about as many rows,
whichever keys and times are hot; windows run inside ``(key, range)``, and a small table
of one row per ``(key, range)`` carries totals from range to range. The totals (sums,
counts, maxima, ends) are associative, so nothing passes through one task. A caller who
knows even chunks of the order, such as pages of a book, may name them by ``chunk``
instead. Rows with a NULL key or an order of NULL are a group of their own; none is
dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import stage


def cut(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """``df`` with ``_chunk``, by the column given or by sampled ranges of (keys, order).

    Ranges are written out: sampled again they would lie elsewhere.
    """
    if chunk is not None:
        return df.withColumn("_chunk", chunk)
    ranged = df.repartitionByRange(*[text.named(c) for c in (*keys, *order)])
    return stage(ranged.withColumn("_chunk", F.spark_partition_id()), "ranges")


def _spec(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _carry(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``totals``, by key and chunk; NULL keys are equal."""
    by = [*keys, "_chunk"]
    totals = totals.withColumnsRenamed({k: f"_of_{i}" for i, k in enumerate(by)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(by)])
    return rows.join(totals, same).drop(*[f"_of_{i}" for i in range(len(by))])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, value: Column, out: str
) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the key's rows up to this one."""
    rows = cut(df.withColumn("_value", value), keys, order, chunk)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    carried = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_total").over(_before(keys)), F.lit(0)).alias("_carry")
    )
    local = F.sum("_value").over(_spec(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        _carry(rows.withColumn("_local", local), carried, keys)
        .withColumn(out, F.col("_carry") + F.col("_local"))
        .drop("_chunk", "_value", "_local", "_carry")
    )


def spaced_slots(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, arrival: Column, gap: int, out: str
) -> DataFrame:
    """Add ``out``: the earliest times not before ``arrival`` and ``gap`` apart per key.

    ``slot_i = max(arrival_i, slot_{i-1} + gap)`` equals ``i * gap`` plus the running
    maximum of ``arrival_j - j * gap``, which splits over chunks.
    """
    rows = cut(df.withColumn("_arrival", arrival), keys, order, chunk)
    local = _spec(keys, order)
    rows = rows.withColumn("_i", F.row_number().over(local)).withColumn(
        "_lead", F.col("_arrival") - F.col("_i") * gap
    )
    rows = rows.withColumn("_max", F.max("_lead").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_n"), F.max("_lead").alias("_top")
    )
    before = _before(keys)
    carried = totals.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = carried.withColumn("_carry", F.max(F.col("_top") - F.col("_skip") * gap).over(before))
    slot = (F.col("_i") + F.col("_skip")) * gap + F.greatest(
        F.col("_max") - F.col("_skip") * gap, F.col("_carry")
    )
    return (
        _carry(rows, carried.select(*keys, "_chunk", "_skip", "_carry"), keys)
        .withColumn(out, slot)
        .drop("_chunk", "_arrival", "_i", "_lead", "_max", "_skip", "_carry")
    )


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, value: Column
) -> DataFrame:
    """Add ``prev`` and ``next``: ``value`` of the rows before and after, NULL at ends."""
    rows = cut(df.withColumn("_value", F.struct(value.alias("v"))), keys, order, chunk)
    place = F.struct(*order)
    edges = rows.groupBy(*keys, "_chunk").agg(
        F.min_by("_value", place).alias("_head"), F.max_by("_value", place).alias("_tail")
    )
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *keys,
        "_chunk",
        F.lag("_tail").over(chunks).alias("_before"),
        F.lead("_head").over(chunks).alias("_after"),
    )
    local = _spec(keys, order)
    placed = rows.withColumn("_lag", F.lag("_value").over(local)).withColumn("_lead", F.lead("_value").over(local))
    return (
        _carry(placed, edges, keys)
        .withColumn("prev", F.coalesce("_lag", "_before")["v"])
        .withColumn("next", F.coalesce("_lead", "_after")["v"])
        .drop("_chunk", "_value", "_lag", "_lead", "_before", "_after")
    )
