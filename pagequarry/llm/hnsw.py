"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Nearness is the inner product. Each shard builds its own graph: a vector's top layer is
drawn from a hash of its id, and a layer's links are a flat array of neighbour numbers
with a fixed number of places per vector. Vectors enter in batches that double the
graph, all of a batch searching at once as arrays: greedily down the upper layers, then
with a beam on each layer it belongs to. Of the found (and its own batch's) vectors a
new one links to those nearer to it than to a neighbour already chosen, the rest filling
up; neighbours link back and drop the worst when full. A query searches every shard and
the shards' results are merged; scores are exact on the original vectors.

Inner products are made a metric question by one more component that gives all of a
shard's vectors the same length; a query has 0 there. Defined results: zero vectors take
no part, nor what :func:`pagequarry.llm.vectors.clean` leaves out; a query with fewer
candidates than k gets those found; ties go to the smaller id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import vectors

#: Vectors of a shard, on average.
SHARD = 8192
#: Links of a vector (twice as many in the lowest layer), beam when building and when searching.
LINKS, BUILD, BEAM = 16, 64, 160
#: Vectors that enter the graph at once, and queries searched at once.
BATCH, ASKED = 1024, 512


class Graph:
    """A small-world graph over unit-length rows; ``layers[l]`` has row numbers, -1 for none."""

    def __init__(self, rows: np.ndarray, seed: int = 5):
        self.rows = rows.astype(np.float32)
        n = len(rows)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 8)
        self.order = np.argsort(-self.level, kind="stable")  # upper layers first
        top = int(self.level.max(initial=0))
        self.layers = [np.full((n, LINKS * (2 if not at else 1)), -1, np.int32) for at in range(top + 1)]
        self.entry = int(self.order[0]) if n else -1
        done = 1
        while done < n:
            batch = self.order[done : done + min(BATCH, done)]
            self._enter(batch)
            done += len(batch)

    def near(self, queries: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Products of each query with its own list of rows; -1 gives minus infinity."""
        found = np.einsum("bd,bkd->bk", queries, self.rows[who])
        return np.where(who >= 0, found, -np.inf)

    def beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found of each query from its start row, best first: rows and products."""
        links, b = self.layers[layer], len(queries)
        index = np.arange(b)[:, None]
        who = np.full((b, width), -1, np.int32)
        who[:, 0] = start
        value = np.full((b, width), -np.inf, np.float32)
        value[:, 0] = np.einsum("bd,bd->b", queries, self.rows[start])
        open_ = np.zeros((b, width), bool)
        open_[:, 0] = True
        seen = np.zeros((b, len(self.rows) + 1), bool)  # the last column takes the -1
        seen[np.arange(b), start] = True
        live = np.arange(b)
        step = 4 if width > 8 else 1  # candidates that a query expands at once
        while len(live):
            able = np.where(open_[live], value[live], -np.inf)
            pick = np.argpartition(-able, step - 1, axis=1)[:, :step] if step > 1 else able.argmax(axis=1)[:, None]
            real = np.take_along_axis(able, pick, axis=1) > -np.inf
            open_[live[:, None], pick] = False
            fresh = links[np.where(real, who[live[:, None], pick], 0)]
            fresh = np.where(real[:, :, None], fresh, -1).reshape(len(live), -1)
            fresh = np.where(seen[live[:, None], fresh], -1, fresh)
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[live[:, None], fresh] = True
            seen[:, -1] = False
            values = self.near(queries[live], fresh)
            all_who = np.concatenate([who[live], fresh], axis=1)
            all_value = np.concatenate([value[live], values], axis=1)
            all_open = np.concatenate([open_[live], values > -np.inf], axis=1)
            keep = np.argpartition(-all_value, width - 1, axis=1)[:, :width]
            who[live] = np.take_along_axis(all_who, keep, axis=1)
            value[live] = np.take_along_axis(all_value, keep, axis=1)
            open_[live] = np.take_along_axis(all_open, keep, axis=1)
            live = live[open_[live].any(axis=1)]
        best = np.argsort(-value, axis=1, kind="stable")
        return who[index, best], value[index, best]

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """The nearest row found for each query from the top layer down to the one above ``to``."""
        at = np.full(len(queries), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, to, -1):
            at = self.beam(queries, at, layer, 1)[0][:, 0]
        return at

    def _enter(self, batch: np.ndarray) -> None:
        points = self.rows[batch]
        own = points @ points.T
        np.fill_diagonal(own, -np.inf)
        at = self.descend(points, int(self.level[batch].max()))
        for layer in range(int(self.level[batch].max()), -1, -1):
            on = np.flatnonzero(self.level[batch] >= layer)
            who, value = self.beam(points, at, layer, BUILD)
            at = who[:, 0]
            mates = np.where((self.level[batch] >= layer)[None, :], own[on], -np.inf)
            few = min(BUILD // 2, len(batch))
            close = np.argpartition(-mates, few - 1, axis=1)[:, :few]
            close_value = np.take_along_axis(mates, close, axis=1)
            all_who = np.concatenate([who[on], np.where(close_value > -np.inf, batch[close], -1)], axis=1)
            all_value = np.concatenate([value[on], close_value], axis=1)
            chosen = self._choose(all_who, all_value, self.layers[layer].shape[1] // (2 if not layer else 1))
            self.layers[layer][batch[on], : chosen.shape[1]] = chosen
            self._link_back(batch[on], chosen, layer)

    def _choose(self, who: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours first: those nearer to the row than to any chosen before; then the nearest left."""
        order = np.argsort(-value, axis=1, kind="stable")[:, : BUILD]
        who, value = np.take_along_axis(who, order, axis=1), np.take_along_axis(value, order, axis=1)
        vecs = self.rows[who]
        between = np.matmul(vecs, vecs.transpose(0, 2, 1))
        b, m = who.shape
        taken, count = np.zeros((b, m), bool), np.zeros(b, int)
        for j in range(m):
            crowded = (taken & (between[:, :, j] > value[:, j : j + 1])).any(axis=1)
            ok = (value[:, j] > -np.inf) & ~crowded & (count < most)
            taken[:, j] = ok
            count += ok
        rank = np.where(taken, 0, 1) + np.where(value > -np.inf, 0, 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(value, order, axis=1) > -np.inf, np.take_along_axis(who, order, axis=1), -1)

    def _link_back(self, sources: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        most = links.shape[1]
        real = chosen >= 0
        to = chosen[real]
        frm = np.broadcast_to(sources[:, None], chosen.shape)[real]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        targets, starts, many = np.unique(to, return_index=True, return_counts=True)
        widest = int(many.max(initial=0))
        added = np.full((len(targets), widest), -1, np.int64)
        column = np.arange(len(to)) - np.repeat(starts, many)
        added[np.repeat(np.arange(len(targets)), many), column] = frm
        everyone = np.concatenate([links[targets], added], axis=1)
        everyone.sort(axis=1)
        everyone[:, 1:][everyone[:, 1:] == everyone[:, :-1]] = -1
        full = (everyone >= 0).sum(axis=1) > most
        simple = -np.sort(-everyone[~full], axis=1)[:, :most]
        links[targets[~full], : simple.shape[1]] = simple
        for at in range(0, int(full.sum()), 2048):
            rows, crowd = targets[full][at : at + 2048], everyone[full][at : at + 2048]
            links[rows] = self._choose(crowd, self.near(self.rows[rows], crowd), most)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The rows found nearest to each query, -1 where there are none."""
        queries = queries.astype(np.float32)
        return self.beam(queries, self.descend(queries, 0), 0, width)[0]


def search(rows: DataFrame, is_query: Column, k: int = 20, width: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest found."""
    whole = vectors.clean(rows, F.exists("v", lambda x: x != 0))
    n = whole.count()

    def meet(table: pa.Table) -> pa.Table:
        queries, asked, ids, held = vectors.split_meeting(table)
        if not len(ids):
            return vectors.result(queries[:0], iter(()), pa.float64())
        squares = (held**2).sum(axis=1)
        graph = Graph(np.column_stack([held, np.sqrt(np.maximum(squares.max() - squares, 0))]) / np.sqrt(squares.max()))

        def found():
            for at in range(0, len(queries), ASKED):
                part = asked[at : at + ASKED]
                hits = graph.search(np.column_stack([part, np.zeros(len(part))]), max(width, k + 1))
                for q, own, hit in zip(part, queries[at : at + ASKED].tolist(), hits):
                    hit = hit[hit >= 0]
                    hit = hit[ids[hit] != own]
                    scores = (held[hit] * q).sum(axis=1)
                    top = np.lexsort((ids[hit], -scores))[:k]
                    yield ids[hit][top], scores[top]

        return vectors.result(queries, found(), pa.float64())

    met = vectors.meetings(whole, is_query, n, SHARD).groupBy("block", "shard")
    return vectors.best(met.applyInArrow(meet, "query_id long, vec_id long, score double"), k)
