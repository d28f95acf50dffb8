r"""Packing documents into sequences by a grouping genetic algorithm on islands.

A document's ids, then an end id, are cut into pieces only if they are longer than a
sequence; a piece as long as a sequence fills one. All other pieces are dealt by hash
into sectors of about ``SECTOR`` pieces, each a packing problem of its own, which
``ISLANDS`` islands work on. An individual is a partition of the sector's pieces into
sequences. Crossover injects whole well-filled sequences of one parent into the other,
removes the sequences that then hold a piece twice, and puts the displaced pieces back
best-fit, longest first. After every epoch each island's best moves on to the next island.

A sector's sequences that stay below ``WELL`` are taken apart from the rest and dealt
into new sectors, with the packing so far as one of the individuals, so a round never
needs more sequences than the one before; the rounds end with a single sector.

Texts are encoded by the ``tokenizers`` library in parts between spaces and newlines,
which its pattern never crosses, a word of plain Latin letters apart from the signs after
it. Each distinct part is encoded once while it is remembered; words need only the
library's merges.

Defined results: a null text counts as empty, whose only id is the end id; a null
``doc_id`` is kept; repeated rows are packed each; an empty table gives none; extra
columns are ignored; equal pieces are told apart by the place where they were written, so
reruns need not name sequences alike.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import text_of
from pagequarry.session import stage

CAPACITY, END = 4096, 1
#: Pieces of a sector, islands of a sector, individuals of an island, epochs, and children of an epoch.
SECTOR, ISLANDS, POPULATION, EPOCHS, CHILDREN = 2048, 2, 5, 3, 24
#: Sequences filled to this share are settled; rounds of dealing the others anew, and islands of a task.
WELL, ROUNDS, TOGETHER = 0.995, 3, 12

# ---- ids

#: A word of Latin letters; signs after it are a piece of their own in the library's pattern.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Parts encoded at once, characters of text encoded together, and bytes of parts remembered.
AT_ONCE, CHUNK, REMEMBERED = 1000, 8 << 20, 80 << 20
#: What a remembered part takes besides its characters and ids.
OVERHEAD = 180


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after the other, and the length of each."""
    many = lengths[which]
    upto = np.cumsum(many)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[which] - upto + many, many)
    return flat[at], many


class Encoder:
    """Ids of texts by a tokenizer given as JSON."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(spec)
        octets = ByteLevel(add_prefix_space=False, use_regex=False)
        latin = map(chr, range(0xC0, 0x100))
        self.spelt = str.maketrans({c: octets.pre_tokenize_str(c)[0][0] for c in latin})
        self.known: dict[str, bytes] = {"": b""}
        self.held, self.most = 0, remembered

    def _whole(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _remember(self, parts: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(parts, ids))
        self.held += sum(map(len, parts)) + sum(map(len, ids)) + OVERHEAD * len(parts)

    def _learn(self, words: list[str], others: list[str]) -> None:
        """A word is one piece, so it goes straight to the library's merges, spelt in the characters of its bytes."""
        merge, spelt = self.tokenizer.model.tokenize, self.spelt
        self._remember(words, [array("I", [t.id for t in merge(w if w.isascii() else w.translate(spelt))]).tobytes() for w in words])
        for at in range(0, len(others), AT_ONCE):
            some = others[at : at + AT_ONCE]
            self._remember(some, self._whole(some))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (with the end of the last)."""
        if self.held > self.most:
            self.known, self.held = {"": b""}, 0
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        parts = coded.dictionary
        stems = pc.utf8_rtrim(parts, SIGNS)
        plain = pc.match_substring_regex(stems, f"^[{LETTERS}]+$")
        stems = pc.utf8_lower(stems)
        # a part is a word and the signs after it, or, if it is not so plain, itself and nothing
        heads = pc.if_else(plain, stems, parts).dictionary_encode()
        tails = pc.if_else(plain, pc.replace_substring_regex(parts, f"^[{LETTERS}]+", ""), "").dictionary_encode()
        names, signs = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (heads, tails))
        is_word = np.asarray(pc.match_substring_regex(heads.dictionary, f"^[{LETTERS}]+$")).tolist()
        new = [(n, w) for n, w in zip(names, is_word) if n not in self.known]
        self._learn([n for n, w in new if w], [n for n, w in new if not w] + [n for n in signs if n not in self.known])
        pool = [*map(self.known.__getitem__, names), *map(self.known.__getitem__, signs)]
        lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        starts = np.cumsum(lengths) - lengths
        both = np.stack([np.asarray(heads.indices), np.asarray(tails.indices) + len(names)], axis=1).astype(np.int64)
        ids, many = _gather(np.frombuffer(b"".join(pool), "<u4"), starts, lengths, both[np.asarray(coded.indices)].ravel())
        upto = np.concatenate([[0], np.cumsum(many)])
        return ids, upto[2 * np.asarray(cut.offsets).astype(np.int64)]


_encoders: dict[int, Encoder] = {}

PIECES = "row_id long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(row_id, doc_id, piece, start, length, ids_crc32, ids)``, a row per piece.

    ``row_id`` says which task wrote the row and which of its rows it is: write the result
    before using it twice. The tokenizer's file is read here and sent out; its size is fixed.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(spec.value)
        row_id = TaskContext.get().partitionId() << 33

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row_id
            ids, begin = _encoders[key].encode(batch.column(1))
            ids = np.insert(ids, begin[1:], end).astype("<u4")
            begin = begin + np.arange(len(begin))
            many = -(-np.diff(begin) // capacity)
            owner = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            start = begin[owner] + piece * capacity
            stop = np.minimum(start + capacity, begin[owner + 1])
            octets = memoryview(ids.tobytes())
            sums = [zlib.crc32(octets[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
            rows = np.arange(row_id, row_id + len(owner))
            row_id += len(owner)
            offsets = pa.array(np.append(start, len(ids)), pa.int32())
            columns = [
                pa.array(rows), batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(piece * capacity),
                pa.array(stop - start), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.view("<i4"))),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            sizes = np.asarray(pc.utf8_length(batch.column(1))).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // CHUNK
            at = 0
            for rows in np.unique(part, return_counts=True)[1].tolist():
                yield cut(batch.slice(at, rows))
                at += rows

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(each, PIECES.format(kind=kind))


# ---- one sector

Bins = list[list[int]]


def best_fit(bins: Bins, items: list[int], lengths: list[int], capacity: int) -> Bins:
    """``bins`` with ``items`` added in turn, each where it leaves least room, else in a bin of its own."""
    bins = list(bins)
    many = len(lengths) + 1
    # (room, bin) in one number each, in order of room
    rooms = sorted((capacity - sum(map(lengths.__getitem__, b))) * many + k for k, b in enumerate(bins))
    for item in items:
        at = bisect_left(rooms, lengths[item] * many)
        if at < len(rooms):
            room, k = divmod(rooms.pop(at), many)
            bins[k] = [*bins[k], item]
        else:
            room, k = capacity, len(bins)
            bins.append([item])
        insort(rooms, (room - lengths[item]) * many + k)
    return bins


def fitness(bins: Bins, lengths: list[int]) -> tuple[int, int]:
    """Fewer sequences first, then the more uneven filling: higher is better."""
    return -len(bins), sum(sum(map(lengths.__getitem__, b)) ** 2 for b in bins)


def crossover(into: Bins, of: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """``into`` with some of the well-filled sequences of ``of``."""
    well = sorted(of, key=lambda b: -sum(map(lengths.__getitem__, b)))[: max(1, len(of) // 2)]
    start = rng.randrange(len(well))
    injected = well[start : start + rng.randint(1, max(1, len(well) // 3))]
    held = {item for b in injected for item in b}
    kept = [b for b in into if held.isdisjoint(b)]
    # besides those cut up by the injection, the emptiest sequences are dealt anew
    kept.sort(key=lambda b: -sum(map(lengths.__getitem__, b)))
    emptiest = rng.randint(0, 3)
    kept = kept[: len(kept) - emptiest]
    placed = held.union(*kept)
    displaced = [i for b in into for i in b if i not in placed]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(injected + kept, displaced, lengths, capacity)


def first_individuals(lengths: list[int], capacity: int, many: int, rng: random.Random, start: Bins | None) -> list[Bins]:
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    found = [start] if start else []
    found.append(best_fit([], falling, lengths, capacity))
    while len(found) < many:
        nearly = sorted(falling, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        found.append(best_fit([], nearly, lengths, capacity))
    return found


def evolve(population: list[Bins], lengths: list[int], capacity: int, children: int, rng: random.Random) -> list[Bins]:
    """The population, fittest first, after so many children; the least fit make room."""
    ranked = sorted(((fitness(b, lengths), k, b) for k, b in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    least = -(-sum(lengths) // capacity)
    for n in range(children):
        if -ranked[0][0][0] <= least:
            break  # no packing has fewer sequences
        a, b = rng.sample(ranked, 2)
        child = crossover(a[2], b[2], lengths, capacity, rng)
        own = fitness(child, lengths)
        if own > ranked[-1][0] and all(own != r[0] for r in ranked):
            ranked[-1] = (own, len(population) + n, child)
            ranked.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [b for _, _, b in ranked]


def _pack(bins: Bins, n: int) -> bytes:
    """The sequence of every piece, as 16-bit integers."""
    out = np.zeros(n, "<u2")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unpack(genome: bytes) -> Bins:
    bins: dict[int, list[int]] = {}
    for item, k in enumerate(np.frombuffer(genome, "<u2").tolist()):
        bins.setdefault(k, []).append(item)
    return list(bins.values())


# ---- all sectors

ISLAND = "sector long, island int, rows binary, lengths binary, genomes array<binary>, bins long, uneven long"
PLACED = "row_id long, length long, sector long, bin int, offset long, filled long"


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in text.split(", ")])


def _islands(unsettled: DataFrame, sectors: int, islands: int) -> DataFrame:
    """A row per sector and island: row ids and lengths, and the packing so far as its only individual."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row_id", "ascending")])
        rows, lengths = np.asarray(table["row_id"]), np.asarray(table["length"]).astype("<u2")
        genomes = []
        if table["so_far"].null_count == 0:
            _, own = np.unique(np.asarray(table["so_far"]), return_inverse=True)
            genomes = [own.astype("<u2").tobytes()]
        one = {"rows": rows.astype("<i8").tobytes(), "lengths": lengths.tobytes(), "genomes": genomes, "bins": None, "uneven": None}
        return pa.Table.from_pylist([{"sector": key[0].as_py(), "island": k} | one for k in range(islands)], _schema(ISLAND))

    unit = F.coalesce("so_far", F.col("row_id"))
    dealt = unsettled.withColumn("sector", F.pmod(F.xxhash64(unit), F.lit(sectors)))
    return dealt.select("sector", "row_id", "length", "so_far").groupBy("sector").applyInArrow(build, ISLAND)


def _epoch(islands: DataFrame, epoch: int, tasks: int, capacity: int, population: int, children: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u2").tolist()
                rng = random.Random(f"{row['sector']} {row['island']} {epoch}")
                found = [_unpack(g) for g in row["genomes"]]
                if len(found) < 2:
                    found = first_individuals(lengths, capacity, population, rng, found[0] if found else None)
                found = evolve(found, lengths, capacity, children, rng)[:population]
                fewer, uneven = fitness(found[0], lengths)
                row |= {"genomes": [_pack(b, len(lengths)) for b in found], "bins": -fewer, "uneven": uneven}
                yield pa.RecordBatch.from_pylist([row], _schema(ISLAND))

    # the rows are few and long to work on: a number of tasks of their own, which isn't merged by size
    return islands.repartition(tasks).mapInArrow(each, ISLAND)


def _migrate(islands: DataFrame, count: int) -> DataFrame:
    """Each island's population with the best of the island before it."""
    elites = islands.select("sector", F.pmod(F.col("island") + 1, F.lit(count)).alias("island"), F.element_at("genomes", 1).alias("_elite"))
    joined = islands.join(elites, ["sector", "island"])
    genomes = F.array_append("genomes", F.col("_elite")).alias("genomes")
    return joined.select("sector", "island", "rows", "lengths", genomes, "bins", "uneven")


def _placed(islands: DataFrame) -> DataFrame:
    """Where every piece stands in the best individual of its sector."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, lengths = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["lengths"], "<u2").astype(np.int64)
                bins = np.frombuffer(row["best"], "<u2").astype(np.int32)
                order = np.lexsort((rows, bins))
                size, own = lengths[order], bins[order]
                upto = np.cumsum(size)
                first = np.flatnonzero(np.diff(own, prepend=-1))
                starts = np.repeat((upto - size)[first], np.diff(first, append=len(own)))
                filled = np.bincount(bins, lengths)[own].astype(np.int64)
                columns = [rows[order], size, np.full(len(own), row["sector"]), own, upto - size - starts, filled]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _schema(PLACED).types)], schema=_schema(PLACED))

    own = F.struct("rows", "lengths", F.element_at("genomes", 1).alias("best"))
    order = F.struct(-F.col("bins"), "uneven", -F.col("island"))
    chosen = islands.groupBy("sector").agg(F.max_by(own, order).alias("own"))
    return chosen.select("sector", "own.*").mapInArrow(each, PLACED)


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, sector: int = SECTOR, islands: int = ISLANDS, population: int = POPULATION,
    epochs: int = EPOCHS, children: int = CHILDREN, rounds: int = ROUNDS,
) -> DataFrame:
    """``(row_id, sequence_id, offset)`` of written ``pieces`` with ``row_id`` and ``length`` up to ``capacity``.

    A sequence's id tells its round, its sector and its place there; full pieces have negative ones.
    """
    slim = pieces.select("row_id", F.col("length").cast("long").alias("length"))
    settled = slim.filter(F.col("length") >= capacity).select("row_id", (-1 - F.col("row_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    unsettled = slim.filter(F.col("length") < capacity).withColumn("so_far", F.lit(None).cast("long"))
    for at in range(rounds):
        sectors = -(-unsettled.count() // sector)
        if not sectors:
            break
        people = stage(_islands(unsettled, sectors, islands), "islands")
        tasks = max(1, sectors * islands // TOGETHER)
        for epoch in range(epochs):
            people = stage(_epoch(people if not epoch else _migrate(people, islands), epoch, tasks, capacity, population, children), "epoch")
        placed = stage(_placed(people), "placed")
        number = F.lit(at).cast("long") * (1 << 58) + F.col("sector") * (1 << 16) + F.col("bin")
        placed = placed.select("row_id", "length", number.alias("sequence_id"), "offset", (F.col("filled") >= WELL * capacity).alias("well"))
        last = sectors == 1 or at == rounds - 1
        settled = settled.unionByName((placed if last else placed.filter("well")).select("row_id", "sequence_id", "offset"))
        if last:
            break
        unsettled = placed.filter("not well").select("row_id", "length", F.col("sequence_id").alias("so_far"))
    return settled


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, **how) -> DataFrame:
    """All pieces of ``docs``, with their ids, the sequence that holds them and the place there."""
    whole = stage(pieces(docs, tokenizer_path, capacity, end), "pieces")
    return whole.join(pack(whole, capacity, **how), "row_id").drop("row_id")
