"""Vector searches against all pairs, and chat formatting read back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import chat, hnsw, topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(1500, 24)).astype(np.float32)
    rows[1400:] = rows[7]  # a common vector
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)]
    odd = [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 24, 0), (2003, [float("inf")] * 24, 0), (None, [1.0] * 24, 0),
           (2004, [0.0] * 24, 0), (5, [float(x) for x in rows[5]], 1), (2005, [], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'clash' as v", "1 as block", "2 as score").repartition(6), rows


def ranked(scores, ids, own, k):
    scores = np.where(ids == own, -np.inf, scores)
    return ids[np.lexsort((ids, -scores))][: min(k, int((scores > -np.inf).sum()))].tolist()


@pytest.mark.parametrize("shard", [200, 8192])
def test_topk_is_exact(spark, vectors, shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    df, rows = vectors
    whole = np.vstack([np.floor(64 * rows.astype(float)), np.zeros((1, 24))])
    ids = np.append(np.arange(1500), 2004)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        scores = whole @ whole[np.flatnonzero(ids == q)[0]]
        assert [v for v, _ in found] == ranked(scores, ids, q, 20)
        assert all(s == scores[np.flatnonzero(ids == v)[0]] for v, s in found)


def test_graph_recall_and_scores(spark, vectors):
    df, rows = vectors
    rows = rows.astype(float)
    ids = np.arange(1500)
    got = {}
    for r in hnsw.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in range(1500) if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = rows @ rows[q]
        # equal vectors may stand in for each other
        least = sorted(np.delete(scores, q))[-20]
        hits += sum(s >= least - 1e-9 for _, s in found)
        assert all(s == pytest.approx(scores[v], abs=1e-12) for v, s in found) and len(found) == 20
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(got)) >= 0.9


def test_searches_on_few_or_no_vectors(spark, vectors):
    df, rows = vectors
    for search in (topk.search, hnsw.search):
        assert search(df.limit(0), F.lit(True)).count() == 0
        few = search(df.filter("vec_id < 4"), F.col("vec_id") == 0).orderBy("rank").collect()
        assert [r.rank for r in few] == [1, 2, 3] and {r.vec_id for r in few} == {1, 2, 3}


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "#", "<", ":", "</turn>", "### ", "assistant: ", "\n", "x", "é", "😀", "\\b", "\\l", ""]
    turns = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "a:b: c", None])
            turns.append((conv, turn, role, rng.choice([None, "".join(rng.choices(parts, k=8))])))
    turns += [(None, 1, "user", "no id"), (7, None, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as turns").repartition(5)
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        own.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        replies = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in own))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(replies), sha(replies))
    assert chat.digests(chat.examples(df.limit(0))).count() == 0
