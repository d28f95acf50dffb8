"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import stage, stage_counted

#: Links that a task holds at once; a graph of no more is settled by one task, without rounds.
AT_ONCE = 1 << 16


def reach(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _stars(batches: Iterator[pa.RecordBatch], most: int, roots: bool) -> Iterator[pa.RecordBatch]:
    """The links of a stream as stars ``(u, v)`` of the same components, ``v`` the smallest; with ``roots``, of itself too.

    More than ``most`` links are joined part by part, so one component may give several stars.
    """

    def star(u, v):
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[reach(len(nodes), at[: len(u)], at[len(u) :])]
        own = np.ones(len(nodes), bool) if roots else nodes != root
        return nodes[own], root[own]

    held = None
    for batch in batches:
        links = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, links)] if held else links
        if len(held[0]) > most:
            held = star(*held)
            if 2 * len(held[0]) > most:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["u", "v"])
                held = None
    if held and len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in star(*held)], ["u", "v"])


def components(links: DataFrame, a: str, b: str, at_once: int = AT_ONCE) -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the smallest node reachable.

    Each task first makes stars of its own links. If no more than ``at_once`` are left, one
    task joins them. Else each round points every node at the smallest neighbour it or its
    neighbours know, in two joins on aggregated minima, until nothing moves: a logarithmic
    number of rounds. Only a count and a checksum reach the driver. Rounds are written to
    the shared folder, so a lost executor costs no more than one round. Null ends and self
    links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    edges, n = stage_counted(edges.mapInArrow(lambda it: _stars(it, at_once, False), kind), "edges")
    if n <= at_once:
        whole = edges.coalesce(1).mapInArrow(lambda it: _stars(it, at_once, True), kind)
        return stage(whole.toDF("node", "root"), "reached")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).filter("m < v")
        large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = stage(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        passed = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(least.select("u", F.col("m").alias("v")).union(passed).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "reached")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
