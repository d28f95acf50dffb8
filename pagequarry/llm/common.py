"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import stage

#: Words are runs without space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words in a string column."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def whole_row(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over earlier rows of the same group.

    The rows are dealt by ranges of (group, order), so a group that holds a third of all
    rows is spread over as many tasks as its share needs. Each range sums its own rows;
    the sums of whole ranges, one row per range and group, are added on top. The ranges
    are written out first, since a second run could sample other bounds.
    """
    ranged = stage(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = W.partitionBy("_range", *group)
    sums = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    inner = F.sum(value).over(here.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
    return (
        ranged.withColumn("_inner", inner)
        .join(sums, ["_range", *group])
        .withColumn(out, F.col("_before") + F.col("_inner"))
        .drop("_range", "_before", "_inner")
    )
