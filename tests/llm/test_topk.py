"""How soon the impact-ordered index can stop, and that it stops on proof only."""

import numpy as np
import pytest

from pagequarry.llm import topk


def brute(ids, rows, q, own, k):
    scores = rows @ q
    order = np.lexsort((ids, -scores))
    order = order[ids[order] != own][:k]
    return ids[order].tolist(), scores[order].tolist()


@pytest.mark.parametrize("kind", ["even", "peaked", "copies", "wide", "zeros"])
def test_same_as_all_products(kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(2000, 16)) * 64
    if kind == "peaked":
        rows *= rng.random(rows.shape) < 0.15
    if kind == "copies":
        rows[500:1500] = rows[7]
    if kind == "wide":
        rows *= 1e6
    if kind == "zeros":
        rows[:] = 0
    rows = np.floor(rows).astype(np.int64)
    ids = rng.permutation(9000)[:2000].astype(np.int64)
    index = topk.ImpactIndex(ids, rows)
    for at in range(0, 60, 3):
        got = index.search(rows[at], int(ids[at]), 20)
        assert (got[0].tolist(), got[1].tolist()) == brute(ids, rows, rows[at], ids[at], 20)


def test_work_is_proven_away():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(4000, 32)) * 64).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), rows)
    for at in range(40):
        index.search(rows[at], at, 20)
    assert index.processed <= 0.75 * index.searches and index.scored <= 0.25 * 4000 * index.searches
