"""Named extractors and sinks that jobs refer to."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import sinks

_extractors: dict[str, Callable] = {}
_sinks: dict[str, Callable] = {
    "csv": sinks.write_csv,
    "json": sinks.write_json,
    "jsonl": sinks.write_json,
    "parquet": sinks.write_parquet,
}


def register_extractor(name: str, fn: Callable) -> None:
    """``fn(pages, spec)`` returns cells ``page_id, row_idx, col, col_ord, value``."""
    _extractors[name] = fn


def register_table_function(name: str, udtf) -> None:
    """Register a Python table function as an extractor.

    It is called once per page, with the page's row as ``TABLE(page_id, url, html)``
    partitioned by ``page_id``, and returns ``page_id, row_idx, col, col_ord, value`` by its
    own ``analyze`` or ``returnType``. SQL may call it by the same name.
    """

    def extract(pages: DataFrame, spec) -> DataFrame:
        spark = pages.sparkSession
        spark.udtf.register(name, udtf)
        view = f"_pages_{uuid.uuid4().hex}"
        pages.select("page_id", "url", "html").createOrReplaceTempView(view)
        rows = spark.sql(f"SELECT * FROM {name}(TABLE({view}) PARTITION BY page_id)")
        return rows.selectExpr("page_id", "cast(row_idx as int) row_idx", "col", "cast(col_ord as int) col_ord", "value")

    register_extractor(name, extract)


def register_sink(name: str, fn: Callable) -> None:
    """``fn(df, path, **options)`` writes a wide table."""
    _sinks[name] = fn


def _get(kind: str, table: dict[str, Callable], name: str) -> Callable:
    if name not in table:
        raise KeyError(f"unknown {kind} {name!r}; available: {', '.join(sorted(table))}")
    return table[name]


def extractor(name: str) -> Callable:
    return _get("extractor", _extractors, name)


def sink(name: str) -> Callable:
    return _get("sink", _sinks, name)
