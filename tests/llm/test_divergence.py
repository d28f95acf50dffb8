"""The source audit against a plain recount, and its perfect hashes against the terms themselves."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from pagequarry.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=3, leading=200):
    """The audit by dictionaries and Python's integers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    docs: dict = {}
    counts: dict = {}
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs.setdefault(lang, Counter()).update(set(terms))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
    out = set()
    for lang, sources in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + divergence.SCALE * (of[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < leading}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("Über", "io", "x", "naïve", "Zz", "éa") for b in ("", "ta", "Lk", "ß", "日本", "q")]
    rows = [
        (rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]),
         rng.choice([" ", "-", "3", "\n"]).join(rng.choices(words, k=rng.randrange(40))))
        for _ in range(300)
    ]
    return rows + [("xx", "a", "lonely words"), ("xx", "b", None), ("en", "empty", ""), ("en", "empty", "123 !?")] + [("en", "a", "common line Of words")] * 150


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)


@pytest.mark.parametrize("how", [{}, {"fits": 0}, {"slots": 5, "leading": 4}, {"dense": 100, "slots": 64}])
def test_same_as_plain_recount(spark, corpus, how):
    got = {tuple(r) for r in divergence.audit(frame(spark, corpus), **how).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(corpus, leading=how.get("leading", 200))


@pytest.mark.parametrize("fits", [0, divergence.FITS])
def test_parts_merged_in_several_tasks(spark, corpus, fits, monkeypatch):
    monkeypatch.setattr(divergence, "TOGETHER", 2)
    got = {tuple(r) for r in divergence.audit(frame(spark, corpus), fits=fits).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(corpus)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "'x' as term", "1 as part", "2 as parts", "3 as salt", "4 as _body", "5 as kept")
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    got = divergence.audit(clash).select("lang", "source", "part", "item", "value", "rank").collect()
    assert {tuple(r) for r in got} == plain(rows)
    assert divergence.audit(no_docs).collect() == []


def test_perfect_hash():
    terms = [f"term{k}é".encode() for k in range(5000)]
    others = [f"other{k}".encode() for k in range(5000)]
    table = divergence.PerfectHash.build(terms)
    again = divergence.PerfectHash(table.terms, table.levels())
    for t in (table, again):
        assert sorted(t.slots(terms, divergence.hashes_of(terms)).tolist()) == list(range(5000))
        assert [t.terms[s] for s in t.slots(terms, divergence.hashes_of(terms))] == terms
        assert (t.slots(others, divergence.hashes_of(others)) == -1).all()
    assert divergence.PerfectHash.build([]).slots(terms[:2], divergence.hashes_of(terms[:2])).tolist() == [-1, -1]


def test_terms_of_equal_hash(monkeypatch):
    monkeypatch.setattr(divergence, "hashes_of", lambda terms: np.array([len(t) for t in terms], np.uint64))
    terms = [b"a", b"b", b"cc", b"dd", b"ee", b"fff"]
    table = divergence.PerfectHash.build(terms)
    slots = table.slots(terms, divergence.hashes_of(terms))
    assert sorted(slots.tolist()) == list(range(6)) and [table.terms[s] for s in slots] == terms
    assert table.slots([b"zz"], divergence.hashes_of([b"zz"])).tolist() == [-1]


def test_shares_beyond_64_bits():
    counts = np.array([0, 1, 10**12, 7 * 10**14 + 3], np.int64)
    total = np.array([3, 10**15, 10**15 - 1, 9 * 10**14 + 7], np.int64)
    want = [1 + divergence.SCALE * (c + 1) // t for c, t in zip(counts.tolist(), total.tolist())]
    assert divergence.shares(counts, total).tolist() == want
    assert all(a <= b for a, b in pairwise(divergence.shares(np.arange(50), np.full(50, 60)).tolist()))
