"""Packing: ids against the tokenizer library, gapless sequences, and few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagequarry.llm import packing
from pagequarry.session import stage

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_text(rng):
    signs = ["a", "B", "é", "É", "ß", "İ", "Σ", "σς", "K", "é", "H̱", "́", " ", "  ", "\n", "\t", " ", " ",
             "'s", "'S", "'", "...", ",", "!?", "½", "Ⅷ", "7", "42", "日本", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "_", "&&&", "ﬁ", "\x00", "word", "Word,", "word.\n"]
    return "".join(rng.choice(signs) for _ in range(rng.randrange(40)))


def test_ids_are_the_library_s(tokenizer):
    rng = random.Random(4)
    texts = [odd_text(rng) for _ in range(3000)] + [chr(rng.randrange(0x20, 0x2FFF)) * 2 + " x" for _ in range(2000)]
    encoder = packing.Encoder(tokenizer.to_str(), remembered=20_000)
    for at in range(0, len(texts), 250):  # little is remembered from one part to the next
        some = texts[at : at + 250]
        ids, begin = encoder.encode(pa.array(some))
        assert len(begin) == len(some) + 1
        for k, text in enumerate(some):
            assert ids[begin[k] : begin[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, capacity):
    """Sequences are gapless and not too long; returns how many there are."""
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        upto = 0
        for offset, length in parts:
            assert offset == upto
            upto += length
        assert 0 < upto <= capacity
    return len(filled)


def test_pieces_of_odd_texts(spark, odd_docs, no_docs, tokenizer):
    clash = odd_docs.selectExpr("*", "1 as row_id", "2 as piece", "3 as sequence_id", "4 as sector", "'x' as ids")
    rows = packing.packed_documents(clash, PATH, capacity=100).collect()
    assert check(rows, 100) >= -(-sum(r.length for r in rows) // 100)
    texts = defaultdict(list)
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        texts[r.doc_id] += [(p, 100 * p, tuple(ids[100 * p : 100 * p + 100])) for p in range(-(-len(ids) // 100))]
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, tuple(r.ids)))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert packing.packed_documents(no_docs, PATH).collect() == []


def least(lengths, capacity):
    """The least number of bins, by trying everything."""
    best = [len(lengths)]
    items = sorted(lengths, reverse=True)

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for at in range(len(rooms)):
            if rooms[at] >= items[k] and rooms[at] not in rooms[:at]:
                put(k + 1, [*rooms[:at], rooms[at] - items[k], *rooms[at + 1 :]])
        put(k + 1, [*rooms, capacity - items[k]])

    put(0, [])
    return best[0]


def triplets(n, rng, capacity=1000):
    """Lengths that fill ``n`` bins wholly by threes, which best-fit decreasing alone does not find."""
    out = []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_small_problems_are_solved():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randint(1, 99) for _ in range(9)]
        people = packing.first_individuals(lengths, 100, 6, rng, None)
        people = packing.evolve(people, lengths, 100, 60, rng)
        assert sorted(i for b in people[0] for i in b) == list(range(9))
        assert len(people[0]) == least(lengths, 100)


def test_evolution_beats_best_fit():
    rng = random.Random(1)
    lengths = triplets(40, rng)
    start = packing.first_individuals(lengths, 1000, 8, rng, None)
    ends = packing.evolve(start, lengths, 1000, 400, rng)
    assert packing.fitness(ends[0], lengths) > max(packing.fitness(b, lengths) for b in start)
    for b in ends:
        assert sorted(i for x in b for i in x) == list(range(120)) and max(sum(lengths[i] for i in x) for x in b) <= 1000


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(9)
    lengths = triplets(200, rng) + [rng.randint(1, 999) for _ in range(700)] + [1000] * 50 + [7] * 900
    rows = [(k, n) for k, n in enumerate(lengths)]
    return stage(spark.createDataFrame(rows, "row_id long, length long").repartition(3)), lengths


def test_rounds_and_migration(sized):
    df, lengths = sized
    few = packing.pack(df, 1000, sector=300, rounds=3)
    rows = few.join(df, "row_id").collect()
    assert sorted(r.row_id for r in rows) == list(range(len(lengths)))
    used = check(rows, 1000)
    one = check(packing.pack(df, 1000, sector=300, rounds=1).join(df, "row_id").collect(), 1000)
    lower = -(-sum(lengths) // 1000)
    assert lower <= used <= one and used <= 1.03 * lower


def test_migration_takes_the_best_on(spark):
    rows = [(1, k, b"", b"", [bytes([k])], k, 0) for k in range(3)]
    islands = spark.createDataFrame(rows, packing.ISLAND)
    got = {r.island: [bytes(g) for g in r.genomes] for r in packing._migrate(islands, 3).collect()}
    assert got == {0: [b"\x00", b"\x02"], 1: [b"\x01", b"\x00"], 2: [b"\x02", b"\x01"]}


def test_all_alike(spark):
    df = stage(spark.range(500).select(F.col("id").alias("row_id"), F.lit(500).cast("long").alias("length")))
    assert check(packing.pack(df, 1000, sector=64).join(df, "row_id").collect(), 1000) == 250
