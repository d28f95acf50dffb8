"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors of integers are held in shards. In a shard every dimension has postings sorted
by value and cut into segments of like impact. A query turns each segment into a gain:
its least contribution over the dimension's lowest. Segments of all dimensions are
processed by falling gain. A row's lower bound is the sum of the gains of its processed
segments; its upper bound adds what these hide and, for every dimension whose segment is
still to come, the best gain left. The rows of the highest lower bounds are scored
exactly; processing stops only when their k-th score proves that few other rows can still
reach it, and those are scored exactly on their whole vectors. If the proof never comes,
everything is processed, and the result is the same.

Defined results: see :func:`pagequarry.llm.vectors.clean` for rows that take no part;
vectors of different lengths are compared over the shorter one's components; ties go to
the smaller id; a query with fewer candidates than k gets them all; an empty table gives
no rows; extra columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import vectors

#: Vectors of a shard, on average.
SHARD = 8192
#: Segments per dimension, the shares of all segments after which the proof is tried, and
#: the share of a shard worth scoring.
SEGMENTS, TRIES, FEW = 32, (0.7, 1.0), 0.25


class ImpactIndex:
    """Postings of one shard: a dimension's segments in order of value, and for each row its segment."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, width = rows.shape
        #: Scores below this are whole numbers that doubles hold, so rows may be multiplied as such.
        self.exact = rows.astype(np.float64)
        self.largest = int(np.abs(rows).sum(axis=1).max(initial=0))
        order = np.argsort(rows, axis=0, kind="stable")
        cuts = np.unique(np.linspace(0, n, min(SEGMENTS, n) + 1).astype(int))
        self.segments, sizes = len(cuts) - 1, np.diff(cuts)
        #: The segment of each (dimension, row): the postings of all segments, laid out by row.
        self.place = np.empty((width, n), np.intp)
        for d in range(width):
            self.place[d, order[:, d]] = np.repeat(np.arange(self.segments), sizes)
        values = np.take_along_axis(rows, order, axis=0)
        #: Least and greatest value of each (dimension, segment).
        self.low, self.high = values[cuts[:-1]].T, values[cuts[1:] - 1].T
        #: Over all searches: shares of the segments processed, and of the rows scored exactly.
        self.processed, self.scored, self.searches = 0.0, 0, 0

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        if self.largest * int(np.abs(query).max(initial=0)) < 1 << 53:
            # without the linear algebra library, whose threads take more than such a product
            return np.einsum("ij,j->i", self.exact[at], query.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ query

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of id ``own``, best first."""
        n = len(self.ids)
        if not n:
            return self.ids, np.zeros(0, np.int64)
        q = query[:, None]
        least = np.minimum(q * self.low, q * self.high).astype(np.float64)
        most = np.maximum(q * self.low, q * self.high).astype(np.float64)
        floor = least.min(axis=1, keepdims=True)
        gain, reach = least - floor, most - floor
        order = np.argsort(-gain, axis=None, kind="stable")
        maybe = np.arange(n)
        seeds = 4 * (k + 1)
        for share in TRIES if n > 2 * seeds else ():
            to = round(share * len(order))
            dims, segs = np.divmod(order[:to], self.segments)
            left = reach.copy()
            left[dims, segs] = 0
            # a row whose segment isn't processed yet may reach the best of those left
            best = left.max(axis=1)
            lower, upper = np.zeros_like(gain), np.repeat(best[:, None], self.segments, axis=1)
            lower[dims, segs], upper[dims, segs] = gain[dims, segs], reach[dims, segs]
            floors, tops = np.zeros(n), np.zeros(n)
            for d, place in enumerate(self.place):
                floors += lower[d][place]
                tops += upper[d][place]
            # k + 1 rows score so much exactly: one of them may be the query's own
            sample = np.argpartition(-floors, seeds)[:seeds]
            known = np.sort(self.scores(sample, query))[-1 - k] - floor.sum()
            rounding = 2.0**-50 * len(query) * max(1.0, float(np.abs(tops).max()), abs(float(floor.sum())))
            maybe = np.flatnonzero(tops >= known - rounding)
            self.processed += share - (TRIES[TRIES.index(share) - 1] if share != TRIES[0] else 0)
            if len(maybe) <= max(seeds, FEW * n):
                break
        self.searches, self.scored = self.searches + 1, self.scored + len(maybe)
        maybe = maybe[self.ids[maybe] != own]
        scores = self.scores(maybe, query)
        top = np.lexsort((self.ids[maybe], -scores))[:k]
        return self.ids[maybe][top], scores[top]


def search(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best inner products of floor(scale * x)."""
    whole = vectors.clean(rows).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    n = whole.count()

    def meet(table: pa.Table) -> pa.Table:
        queries, asked, ids, held = vectors.split_meeting(table)
        index = ImpactIndex(ids, held.astype(np.int64))
        asked = asked.astype(np.int64)
        return vectors.result(queries, (index.search(q, own, k) for q, own in zip(asked, queries.tolist())), pa.int64())

    met = vectors.meetings(whole, is_query, n, SHARD).groupBy("block", "shard")
    return vectors.best(met.applyInArrow(meet, "query_id long, vec_id long, score long"), k)
