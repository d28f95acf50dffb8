"""Type inference, typed tables, and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from .shape import KEYS, data_columns

# Fixed value: the share of filled cells a type needs to name its column.
MAJORITY = 0.8


def _unpivot(df: DataFrame, keys) -> DataFrame:
    have = data_columns(df, keys)
    order = [k for k in keys if k in df.columns]
    pairs = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name"), F.coalesce(text.named(c), F.lit("")).alias("v"))
          for i, c in enumerate(have)]
    )
    return df.select(*order, F.inline(pairs))


def profile(df: DataFrame, keys=KEYS) -> DataFrame:
    """One row per column: ``ord, name, inferred_type, non_empty, empty, unique``.

    Equal values are counted together before anything else, so each distinct value is
    classified once and a value filling a third of a column costs one row.
    """
    distinct = (
        _unpivot(df, keys)
        .groupBy("ord", "name", "v")
        .agg(F.count("*").alias("n"))
        .withColumn("kind", values.kind(F.col("v")))
    )
    filled = F.col("kind") != "empty"
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in values.KINDS]
    cols = distinct.groupBy("ord", "name").agg(
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("non_empty"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("empty"),
        F.count("*").alias("unique"),
        *sums,
    )
    best = F.lit("string")
    for k in values.KINDS:
        share = F.col(f"_{k}") / F.nullif("non_empty", F.lit(0))
        best = F.when(share >= MAJORITY, k).otherwise(best)
    return cols.select("ord", "name", best.alias("inferred_type"), "non_empty", "empty", "unique")


#: Distinct values of a stored profile are known to about 1.6 % (HyperLogLog of 2^12 registers).
REGISTERS = 12


def profile_state(df: DataFrame, keys=KEYS) -> DataFrame:
    """A profile that can be stored and merged: one small row per column.

    Counts by kind are exact; the distinct values are a sketch. The rows of several runs,
    one under the other, are what :func:`merged_profile` reads, so a run over new pages
    reads no earlier page. :func:`profile` stays the exact way.
    """
    distinct = _unpivot(df, keys).groupBy("ord", "name", "v").agg(F.count("*").alias("n"))
    distinct = distinct.withColumn("kind", values.kind(F.col("v")))
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in values.KINDS]
    return distinct.groupBy("ord", "name").agg(
        F.sum(F.when(F.col("kind") == "empty", F.col("n")).otherwise(0)).alias("n_empty"),
        F.sum(F.when(F.col("kind") != "empty", F.col("n")).otherwise(0)).alias("n_filled"),
        *kinds,
        F.hll_sketch_agg("v", REGISTERS).alias("seen"),
    )


def merged_profile(states: DataFrame) -> DataFrame:
    """``profile`` of all runs whose states are given, ``unique`` estimated.

    Columns are matched by name; a column that some runs lack counts as empty in their rows.
    """
    runs = states.groupBy("name").agg(
        F.min("ord").alias("ord"),
        *[F.sum(c).alias(c) for c in states.columns if c.startswith("n_")],
        F.hll_union_agg("seen").alias("seen"),
    )
    whole = Window.partitionBy()
    runs = runs.withColumn("_rows", F.max(F.col("n_filled") + F.col("n_empty")).over(whole))
    missing = F.col("_rows") - F.col("n_filled") - F.col("n_empty")
    best = F.lit("string")
    for k in values.KINDS:
        share = F.col(f"n_{k}") / F.nullif("n_filled", F.lit(0))
        best = F.when(share >= MAJORITY, k).otherwise(best)
    return runs.select(
        "ord", "name", best.alias("inferred_type"), F.col("n_filled").alias("non_empty"),
        (F.col("n_empty") + missing).alias("empty"), F.hll_sketch_estimate("seen").alias("unique"),
    )


def samples(df: DataFrame, k: int = 3, keys=KEYS) -> DataFrame:
    """``name, sample``: the first ``k`` filled values of each column, untrimmed."""
    order = [c for c in keys if c in df.columns]
    cells = _unpivot(df, keys).where(~text.is_blank(F.col("v")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    top = cells.withColumn("_k", rank).where(F.col("_k") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_k", "v")))
    return top.groupBy("name").agg(F.transform(ordered, lambda s: s["v"]).alias("sample"))


def summarize(df: DataFrame, keys=KEYS) -> DataFrame:
    """``profile`` with the first three samples of each column."""
    empty = F.array().cast("array<string>")
    return (
        profile(df, keys)
        .join(samples(df, 3, keys), "name", "left")
        .withColumn("sample", F.coalesce("sample", empty))
    )


def quality(df: DataFrame, keys=KEYS) -> DataFrame:
    """``summarize`` with ``rows`` and the share of empty cells."""
    rows = F.col("empty") + F.col("non_empty")
    ratio = F.coalesce(F.col("empty") / F.nullif(rows, F.lit(0)), F.lit(0.0))
    return summarize(df, keys).withColumn("rows", rows).withColumn("null_ratio", ratio)


def infer_types(df: DataFrame, keys=KEYS) -> dict[str, str]:
    """Column name to inferred type; one row per column reaches the driver."""
    return {r["name"]: r["inferred_type"] for r in profile(df, keys).collect()}


def date_layouts(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The layout that reads most values of each column, month first on ties."""
    if not columns:
        return {}
    # On equal counts the order of preference decides; only slashed dates tie.
    preferred = sorted(values.DATE_NAMES, key=lambda n: n == "d/M/yyyy")
    counts = df.agg(
        *[
            F.count(values.parse_date_as(text.named(c), n)).alias(f"c{i}_{j}")
            for i, c in enumerate(columns)
            for j, n in enumerate(preferred)
        ]
    ).first()
    return {
        c: max(
            enumerate(preferred), key=lambda jn: (counts[f"c{i}_{jn[0]}"], -jn[0])
        )[1]
        for i, c in enumerate(columns)
    }


def coerce(
    df: DataFrame,
    types: dict[str, str] | None = None,
    layouts: dict[str, str] | None = None,
    decimal_comma: bool = False,
    keys=KEYS,
) -> DataFrame:
    """Typed columns by ``types`` (inferred when not given); bad cells become NULL."""
    types = infer_types(df, keys) if types is None else types
    dated = [c for c, t in types.items() if t == "date" and c not in (layouts or {})]
    layouts = {**date_layouts(df, dated), **(layouts or {})}

    def typed(c: str):
        kind, col = types.get(c, "string"), text.named(c)
        if kind == "integer":
            return values.to_integer(col)
        if kind in ("number", "currency"):
            return values.to_number(col, decimal_comma)
        if kind == "date":
            return values.parse_date_as(col, layouts[c]).cast("timestamp")
        if kind == "boolean":
            return values.to_boolean(col)
        return col

    order = [k for k in keys if k in df.columns]
    return df.select(*order, *[typed(c).alias(c) for c in data_columns(df, keys)])


def preview(df: DataFrame, n: int = 5, keys=KEYS) -> DataFrame:
    """The first rows by the order keys."""
    order = [k for k in keys if k in df.columns]
    return df.orderBy(*order).limit(n)
