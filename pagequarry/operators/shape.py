"""Row and column shaping of wide tables.

Tables are all-string with key columns ``keys`` (an order such as ``page_id,
row_idx``) that no step touches. "First" always means first by those keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

KEYS = ("page_id", "row_idx")


def data_columns(df: DataFrame, keys=KEYS) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _with(df: DataFrame, columns: list, keys) -> DataFrame:
    picked = [text.named(c) if isinstance(c, str) else c for c in columns]
    return df.select(*[k for k in keys if k in df.columns], *picked)


def trim(df: DataFrame, keys=KEYS) -> DataFrame:
    return _with(df, [text.strip(text.named(c)).alias(c) for c in data_columns(df, keys)], keys)


def keep_or_drop(df: DataFrame, keep=(), drop=(), keys=KEYS) -> DataFrame:
    """``keep`` wins and sets the order; unknown names are ignored.

    When nothing in ``keep`` exists the table is empty: no columns and no rows.
    """
    have = data_columns(df, keys)
    if keep:
        kept = [c for c in dict.fromkeys(keep) if c in have]
        return _with(df, kept, keys) if kept else _with(df, [], keys).limit(0)
    return _with(df, [c for c in have if c not in set(drop)], keys)


def renamed(names: list[str], mapping: dict[str, str]) -> list[str]:
    """New names in order; a name already taken gets the suffix ``_2``, ``_3``, ..."""
    if not mapping:
        return list(names)
    taken: set[str] = set()
    uses: dict[str, int] = {}
    out = []
    for name in names:
        new = mapping.get(name, name)
        base = new
        while new in taken:
            uses[base] = uses.get(base, 1) + 1
            new = f"{base}_{uses[base]}"
        taken.add(new)
        out.append(new)
    return out


def rename(df: DataFrame, mapping: dict[str, str], keys=KEYS) -> DataFrame:
    have = data_columns(df, keys)
    pairs = zip(have, renamed(have, mapping))
    return _with(df, [text.named(a).alias(b) for a, b in pairs], keys)


def require(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Drop rows that are blank in any of ``columns``; unknown names are ignored."""
    known = [c for c in columns if c in data_columns(df, keys)]
    if not known:
        return df
    return df.where(reduce(lambda a, b: a & b, [~text.is_blank(text.named(c)) for c in known]))


def locked_columns(df: DataFrame, first_rows: int, keys=KEYS) -> list[str]:
    """Columns with a value in the first rows, or all when there are no more rows.

    A bounded count and a top-k job; a single row of flags reaches the driver.
    """
    have = data_columns(df, keys)
    if first_rows <= 0 or not have:
        return have
    order = [k for k in keys if k in df.columns]
    if df.limit(first_rows + 1).count() <= first_rows:
        return have
    flags = [F.max(~text.is_blank(text.named(c))).alias(f"c{i}") for i, c in enumerate(have)]
    seen = df.orderBy(*order).limit(first_rows).agg(*flags).first()
    return [c for i, c in enumerate(have) if seen[f"c{i}"]]


def lock_schema(df: DataFrame, first_rows: int, keys=KEYS) -> DataFrame:
    return _with(df, locked_columns(df, first_rows, keys), keys)


def dedupe(df: DataFrame, keys=KEYS) -> DataFrame:
    """Keep the first of equal rows. A plain aggregate, so copies merge map-side."""
    have = data_columns(df, keys)
    order = [k for k in keys if k in df.columns]
    if not order:
        return df.distinct()
    first = F.min(F.struct(*order)).alias("__first")
    have = [text.named(c) for c in have]
    return df.groupBy(*have).agg(first).select("__first.*", *have)


def shape(
    df: DataFrame,
    *,
    trim_cells: bool = True,
    keep=(),
    drop=(),
    mapping: dict[str, str] | None = None,
    required=(),
    lock_after: int = 0,
    deduplicate: bool = False,
    keys=KEYS,
) -> DataFrame:
    """All steps in their fixed order: trim, keep or drop (old names), rename, required
    (new names), schema lock, dedupe."""
    if trim_cells:
        df = trim(df, keys)
    df = keep_or_drop(df, keep, drop, keys)
    df = rename(df, mapping or {}, keys)
    df = require(df, required, keys)
    if lock_after > 0:
        df = lock_schema(df, lock_after, keys)
    return dedupe(df, keys) if deduplicate else df
