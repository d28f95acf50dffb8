"""Byte-level BPE by a rank file, with a hierarchical-bitmap rank queue.

The pieces of many texts are merged together. Each merge rank has a bucket with the
places (in a linked list of symbols) whose pair has that rank; a bitmap of three levels
says which buckets hold any, so find-first-set gives the next rank. A bucket's places
that have changed meanwhile are stale and skipped; the rest merge at once, as arrays, up
to the first in each piece that makes a pair of lower rank, which then comes first. So a
text without a space is no special case: a repetitive piece of a million letters takes
about a second. Each distinct piece of a batch is merged once.

Defined results: a null text counts as empty and has no ids; a null ``doc_id`` is kept;
repeated rows each give a row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import text_of

#: White space by its Unicode property.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of new pieces merged together, and bytes of remembered pieces, tested between chunks of text.
TOGETHER, REMEMBERED = 4 << 20, 64 << 20
#: What a remembered piece takes besides its characters and ids.
OVERHEAD = 160


#: What the classes of a rank file's pattern become. Runs of Latin letters, and of ASCII signs,
#: that meet no character beyond get an alternative of their own, which the engine tests fastest.
LATIN = r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?![^\x00-\xff])"
SIGNS = r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]++(?![^\x00-\x7f])"


def other_numbers() -> str:
    """Characters that count as numbers but not as decimal digits, as ranges of a class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def compile_pattern(pattern: str) -> re.Pattern:
    """The pattern that cuts text into pieces, for the engine of the standard library.

    It knows no ``\\p{L}`` and ``\\p{N}`` and has a wider ``\\s``, so these are spelled out.
    """
    numbers = other_numbers()
    letter, number = rf"[^\W\d_{numbers}]", rf"[\d{numbers}]"
    parts = [
        (r" ?\p{L}+", rf" ?{LATIN}| ?{letter}+"),
        (r" ?[^\s\p{L}\p{N}]+", rf" ?{SIGNS}| ?(?:[^\w{WHITE}]|_)+"),
        (r"\p{N}", number),
        (r"\p{L}", letter),
        (r"\S", f"[^{WHITE}]"),
        (r"\s", f"[{WHITE}]"),
    ]
    known = dict(parts)
    pieces = re.split("(" + "|".join(re.escape(a) for a, _ in parts) + ")", pattern)
    return re.compile("".join(known.get(x, x) for x in pieces))


class RankQueue:
    """Buckets of places per rank; ``pop`` gives the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, places: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(places)
            return
        self.buckets[rank] = [places]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        if not self.top:
            return None
        first = lambda x: (x & -x).bit_length() - 1
        a = first(self.top)
        b = a << 6 | first(self.mid[a])
        rank = b << 6 | first(self.low[b])
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes pieces by the ranks of a file of base64 tokens and ranks."""

    def __init__(self, rank_file: bytes, pattern: str):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        keys, merged = [], []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(rank)
        self.octets = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[order], -1)
        # a token all of whose pairs rank above it may merge at all its places at once
        lowest = np.full(self.size, self.size, np.int64)
        np.minimum.at(lowest, self.keys[:-1] // self.size, self.merged[:-1])
        np.minimum.at(lowest, self.keys[:-1] % self.size, self.merged[:-1])
        self.at_once = lowest > np.arange(self.size)
        self.pattern = compile_pattern(pattern)
        #: Pieces by number, in order of first sight, and their ids.
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.known: list[bytes] = []
        self.held = 0

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two symbols' join, -1 if there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        if not pieces:
            return []
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        symbol = np.append(self.octets[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        # place n stands before the first and after the last symbol of every piece
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(lengths)
        after[ends - 1] = n
        before[ends - lengths] = n
        rank = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        alive = np.ones(n + 1, bool)
        alive[n] = False
        queue = RankQueue(self.size)
        self._push(queue, rank, inner)
        while (got := queue.pop()) is not None:
            r, parts = got
            places = np.concatenate(parts) if len(parts) > 1 else parts[0]
            places = places[rank[places] == r]
            if len(places) > 1:
                places = np.unique(places)
            if not len(places):
                continue
            found = places
            chained = after[places[:-1]] == places[1:]
            if chained.any():  # of places that overlap, every other one from the left
                index = np.arange(len(places))
                start = np.maximum.accumulate(np.where(np.append(True, ~chained), index, 0))
                places = places[(index - start) % 2 == 0]
            if not self.at_once[r]:
                # from the left, up to the first join of each piece that makes a pair of lower rank:
                # that pair comes before the piece's other places, which wait
                kept = places[self._before_lower(r, places, symbol, before, after, piece, n)]
                if len(kept) < len(places):
                    queue.push(r, found[~np.isin(found, kept, assume_unique=True)])
                places = kept
            gone = after[places]
            follow = after[gone]
            alive[gone] = False
            rank[gone] = -1
            symbol[places] = r
            after[places] = follow
            before[follow] = places
            lead = before[places]
            rank[places] = np.where(follow < n, self.pair_ranks(symbol[places], symbol[follow]), -1)
            lead = lead[lead < n]
            rank[lead] = self.pair_ranks(symbol[lead], symbol[after[lead]])
            self._push(queue, rank, np.concatenate([places, lead]))
        alive = alive[:n]
        ids = symbol[:n][alive].astype("<u4").tobytes()
        cuts = np.append(0, np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))) * 4
        cuts = cuts.tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _before_lower(self, r: int, places: np.ndarray, symbol, before, after, piece, n: int) -> np.ndarray:
        """Which joins of rank ``r``, done from the left, come before or make their piece's first pair of lower rank."""
        lead, follow = before[places], after[after[places]]
        left = np.where(lead < n, symbol[lead], 0)
        # the place before may have been joined just now, up to this one
        joined = np.append(False, lead[1:] == after[places[:-1]]) & (lead < n)
        left[joined] = r
        low = np.zeros(len(places), bool)
        for has, a, b in ((lead < n, left, r), (follow < n, r, symbol[follow])):
            rank = self.pair_ranks(np.broadcast_to(a, len(places))[has], np.broadcast_to(b, len(places))[has])
            low[has] |= (rank >= 0) & (rank < r)
        earlier = np.cumsum(low) - low
        own = piece[places]
        first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(len(places)), 0))
        return earlier == earlier[first]

    @staticmethod
    def _push(queue: RankQueue, rank: np.ndarray, places: np.ndarray) -> None:
        found = rank[places]
        places = places[found >= 0]
        if len(places) == 1:
            queue.push(int(rank[places[0]]), places)
        elif len(places):
            found = found[found >= 0]
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order]
            cuts = np.flatnonzero(np.append(True, found[1:] != found[:-1])).tolist()
            for r, a, b in zip(found[cuts].tolist(), cuts, [*cuts[1:], len(found)]):
                queue.push(r, places[a:b])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self.held > REMEMBERED:
            self.number.clear()
            self.known.clear()
            self.held = 0
        numbers = []
        for text in texts:
            pieces = self.pattern.findall(text)
            numbers.append(np.fromiter(map(self.number.__getitem__, pieces), np.int32, len(pieces)))
        self._learn(list(islice(self.number, len(self.known), None)))
        for each in numbers:
            yield b"".join(map(self.known.__getitem__, each.tolist()))

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of these pieces: a piece that is a token is that token, others are merged."""
        found: list[bytes | None] = []
        together, places, held = [], [], 0

        def merge() -> None:
            for at, ids in zip(places, self.merge(together)):
                found[at] = ids

        for piece in pieces:
            octets = piece.encode()
            whole = self.ranks.get(octets)
            found.append(None if whole is None else whole.to_bytes(4, "little"))
            if whole is None:
                places.append(len(found) - 1)
                together.append(octets)
                held += len(octets)
                if held >= TOGETHER:
                    merge()
                    together, places, held = [], [], 0
        merge()
        self.known += found
        self.held += sum(map(len, pieces)) + sum(map(len, found)) + OVERHEAD * len(pieces)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Characters of text whose pieces are learnt together.
CHUNK = 8 << 20
_encoders: dict[int, Encoder] = {}


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document, and ``ids`` if asked for.

    The rank file is read once here and sent to the executors; its size is fixed.
    """
    spec = docs.sparkSession.sparkContext.broadcast((Path(rank_path).read_bytes(), pattern))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _encoders:
            _encoders[key] = Encoder(*spec.value)
        encoder = _encoders[key]
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1).to_pylist()):
                encoded = list(encoder.encode(texts))
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    sha(encoded),
                    sha(map(encoder.decode, encoded)),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in encoded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(each, out)
