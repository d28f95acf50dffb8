"""Export shaping and writers."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .shape import KEYS, data_columns

CODECS = ("snappy", "gzip", "lz4", "zstd", "none")
TABLE_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


class EmptyTable(ValueError):
    """Nothing to export."""


def string_columns(df: DataFrame, keys=KEYS) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and n not in keys]


def filled_columns(df: DataFrame, keys=KEYS) -> list[str]:
    """Data columns with at least one non-blank value; one row reaches the driver."""
    have = data_columns(df, keys)
    if not have:
        return []
    strings = set(string_columns(df, keys))
    filled = [
        F.max(~text.is_blank(text.named(c)) if c in strings else text.named(c).isNotNull()).alias(f"c{i}")
        for i, c in enumerate(have)
    ]
    seen = df.agg(*filled).first()
    return [c for i, c in enumerate(have) if seen[f"c{i}"]]


def drop_empty_columns(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.select(*[k for k in keys if k in df.columns], *map(text.named, filled_columns(df, keys)))


def sort_columns(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.select(*[k for k in keys if k in df.columns], *map(text.named, sorted(data_columns(df, keys))))


def guard_formulas(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.withColumns({c: text.formula_guard(text.named(c)) for c in string_columns(df, keys)})


def normalise_keys(df: DataFrame, keys=KEYS) -> DataFrame:
    have = data_columns(df, keys)
    names = text.unclashing(text.suffixed([text.slug_text(c) for c in have]))
    return df.select(
        *[k for k in keys if k in df.columns], *[text.named(a).alias(b) for a, b in zip(have, names)]
    )


def null_policy(df: DataFrame, policy: str = "empty", keys=KEYS) -> DataFrame:
    """Exactly empty strings kept (``empty``) or made NULL (``null``, ``skip``).

    ``skip`` differs when writing JSON: the key is left out of the row.
    """
    if policy not in ("empty", "null", "skip"):
        raise ValueError(f"unknown null policy {policy!r}")
    if policy == "empty":
        return df
    return df.withColumns({c: F.nullif(text.named(c), F.lit("")) for c in string_columns(df, keys)})


def _export(df: DataFrame, drop_empty: bool, sort: bool, keys) -> DataFrame:
    if not data_columns(df, keys) or df.isEmpty():
        raise EmptyTable("the table is empty")
    if drop_empty:
        df = drop_empty_columns(df, keys)
    if sort:
        df = sort_columns(df, keys)
    return df.drop(*keys)


def write_csv(
    df: DataFrame, path: str, *, safe=False, encoding="utf-8", drop_empty=True, sort=False,
    mode="overwrite", keys=KEYS,
) -> None:
    out = _export(df, drop_empty, sort, keys)
    if safe:
        out = guard_formulas(out, keys)
    options = {
        "header": True, "escape": '"', "encoding": encoding,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    out.write.mode(mode).options(**options).csv(path)


def read_csv(spark, path: str, encoding: str = "utf-8") -> DataFrame:
    """What ``write_csv`` wrote, all strings, empty cells as ``''``."""
    df = spark.read.options(
        header=True, escape='"', encoding=encoding, multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return df.fillna("")


def write_json(
    df: DataFrame, path: str, *, policy="empty", normalise=False, sort=False, drop_empty=True,
    mode="overwrite", encoding="utf-8", keys=KEYS,
) -> None:
    """JSON lines, one object per row."""
    out = null_policy(_export(df, drop_empty, sort, keys), policy, keys)
    if normalise:
        out = normalise_keys(out, keys)
    if sort:
        out = sort_columns(out, keys)
    out.write.mode(mode).option("encoding", encoding).option("ignoreNullFields", policy == "skip").json(path)


def write_parquet(
    df: DataFrame, path: str, *, codec="snappy", drop_empty=True, sort=False, mode="overwrite", keys=KEYS
) -> None:
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {', '.join(CODECS)}, got {codec!r}")
    _export(df, drop_empty, sort, keys).write.mode(mode).option("compression", codec).parquet(path)


def write_table(
    df: DataFrame, name: str = "scrape", *, if_exists="fail", path: str | None = None,
    drop_empty=True, sort=False, keys=KEYS,
) -> None:
    """A catalog table; ``if_exists`` is fail, replace or append."""
    if if_exists not in TABLE_MODES:
        raise ValueError(f"if_exists must be one of {', '.join(TABLE_MODES)}")
    writer = _export(df, drop_empty, sort, keys).write.mode(TABLE_MODES[if_exists])
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_jdbc(
    df: DataFrame, url: str, table: str = "scrape", *, if_exists="fail", properties=None, keys=KEYS
) -> None:
    out = _export(df, True, False, keys)
    out.write.jdbc(url, table, mode=TABLE_MODES[if_exists], properties=properties or {})


def write_quality(report: DataFrame, path: str) -> None:
    """The quality report next to an output, one small JSON file."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}.quality")


def provenance(
    visited: DataFrame, *, started: str, finished: str, extractor: str, selectors=None, options=None,
    sample: int = 1000,
) -> DataFrame:
    """One row on how an output came about: counts, the first ``sample`` URLs, the settings.

    The row is for people; ``write_provenance`` keeps all URLs beside it.
    """

    def text_map(d):
        pairs = [F.lit(x) for kv in (d or {}).items() for x in map(str, kv)]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    first = visited.select("url").distinct().orderBy("url").limit(sample)
    counted = visited.agg(F.count_distinct("url").alias("n_pages")).withColumn(
        "source_urls", F.lit(None).cast("array<string>")
    )
    listed = first.agg(F.array_sort(F.collect_list("url")).alias("source_urls"))
    both = counted.unionByName(listed, allowMissingColumns=True)
    return both.agg(F.max("n_pages").alias("n_pages"), F.max("source_urls").alias("source_urls")).select(
        "n_pages",
        "source_urls",
        F.lit(started).alias("started_at"),
        F.lit(finished).alias("finished_at"),
        F.lit(extractor).alias("extractor"),
        text_map(selectors).alias("selectors"),
        text_map(options).alias("options"),
    )


def write_provenance(row: DataFrame, path: str, visited: DataFrame | None = None) -> None:
    """The row beside an output, and all visited URLs as a table beside it."""
    row.coalesce(1).write.mode("overwrite").json(f"{path}.meta")
    if visited is not None:
        visited.select("url").distinct().write.mode("overwrite").parquet(f"{path}.urls")
