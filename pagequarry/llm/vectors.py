"""What the vector searches share: clean vectors, and blocks of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of a block, on average.
BLOCK = 4096


def clean(rows: DataFrame, usable: Column | None = None) -> DataFrame:
    """``(vec_id, v)`` with the vectors as doubles.

    Rows with a null id, a null or empty vector, or null, infinite or not-a-number
    components are left out; rows that share an id count once, with the smallest vector.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    kept = kept.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    if usable is not None:
        kept = kept.filter(usable)
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def meetings(vectors: DataFrame, is_query: Column, n: int, shard: int) -> DataFrame:
    """Every block of queries with every shard: ``(block, shard, asks, vec_id, v)``.

    Shards and blocks are dealt by a hash of the id, so equal vectors spread out. A shard
    is sent once per block and a block once per shard; no pair of rows is formed. The
    ``n`` vectors of the table, ``shard`` to a shard, fix how many of each there are.
    """
    shards = max(1, -(-n // shard))
    blocks = max(1, -(-n // (20 * BLOCK)))
    deal = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = vectors.select(every(blocks).alias("block"), deal(shards, 1).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = vectors.filter(is_query).select(deal(blocks, 2).alias("block"), every(shards).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    return held.union(asking)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def split_meeting(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids and vectors, candidate ids and vectors of one meeting, each in order of id."""
    table = table.sort_by("vec_id")
    asks = np.asarray(table["asks"])
    ids = np.asarray(table["vec_id"])
    width = max((len(x) for x in table["v"]), default=0)
    rows = matrix(table["v"], width)
    return ids[asks], rows[asks], ids[~asks], rows[~asks]


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query over all shards, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def result(queries: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    """A table of (query_id, vec_id, score) from each query's ids and scores."""
    rows = [(np.full(len(i), q), i, s) for q, (i, s) in zip(queries.tolist(), found)]
    cat = lambda k: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(cat(0), pa.int64()), "vec_id": pa.array(cat(1), pa.int64()), "score": pa.array(cat(2), kind)})
