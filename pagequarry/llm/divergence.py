r"""Source divergence audit by a recount over minimal perfect hashes.

The first pass counts documents per language and term exactly and keeps the terms of at
least ``least`` documents. Each language's kept terms are dealt by hash into parts of a
bounded number of terms, and every part gets a minimal perfect hash: levels of bitmaps in
which a term's bit is set where no other term of the part falls, the rank of the bit
being the term's slot. The second pass increments dense arrays of slots, one per
(language, source); a term that is not kept may fall on any slot, so the stored term of
the slot is compared. Arrays leave a task as packed pairs of slot and count.

The hashes are sent to all tasks if they take up to ``fits`` bytes together, measured
first. Beyond that, tasks send packed terms and counts to the parts instead, where the
same hashes find the slots. Both ways give the same counts.

A part's arrays are small by construction (its number of slots falls as the number of
sources grows), so shares, differences of all pairs of sources and a part's own leading
terms are worked out per part in exact integers; sums and leading terms of parts are
merged by plain aggregates. A large source is only one array in each part, and no
document, term or source is gathered in one task.

Defined results: null text, lang and source count as empty; every row is a document, so
repeated rows count again; a language without kept terms has differences of 0 and no
terms; a (language, source) without terms has only smoothed shares; ties go to the
smaller item in UTF-8; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import stage

LEAST, LEADING, SCALE = 3, 200, 1_000_000_000
#: Terms of a part at most, and slots times sources of a part.
SLOTS, CELLS = 8192, 1 << 21
#: Bytes of hashes that are sent to all tasks at most.
FITS = 32 << 20
#: Distinct terms counted, and bytes of dense arrays held, before a task gives them off.
COUNTED, DENSE = 400_000, 64 << 20
#: Parts are merged in several tasks if more tasks than this have counted for them.
TOGETHER = 256
SEED = 42
#: Letters of terms lower-cased, all else a space; bytes from 128 on belong to longer code points.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HASHES = "lang string, part int, terms binary, levels array<binary>"
COUNTS = "lang string, part int, source string, terms binary, slots binary, counts binary, total long"
VALUES = "lang string, source string, part string, item string, value long"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and code points from 128 on, A-Z lower-cased."""
    return text.translate(FOLD).split()


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each hash falls at a level: a mixer of 64 bits, then the remainder."""
    x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n-1 of n terms. Terms whose hashes are equal come last and are found by name."""

    LEVELS = 48

    def __init__(self, terms: list[bytes], levels: list[bytes]):
        self.terms = terms
        self.bits = [np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in levels]
        counts = [int(b.sum()) for b in self.bits]
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        #: The slot of a set bit: the bits set before it, in this level and those above.
        self.ranks = [(np.cumsum(b) - 1 + s).astype(np.int32) for b, s in zip(self.bits, starts)]
        self.alike = {t: k for k, t in enumerate(terms[starts[-1] :], int(starts[-1]))}

    @classmethod
    def build(cls, terms: list[bytes]) -> PerfectHash:
        left, hashes = np.arange(len(terms)), hashes_of(terms)
        order, levels = [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = -(-3 * len(left) // 16) * 8  # half as many again, in whole bytes
            at = _place(hashes[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone).tobytes())
            mine = alone[at]
            order += left[mine][np.argsort(at[mine])].tolist()
            left = left[~mine]
        return cls([terms[k] for k in chain(order, left.tolist())], levels)

    def levels(self) -> list[bytes]:
        return [np.packbits(b).tobytes() for b in self.bits]

    def slots(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Each term's slot, -1 for terms that have none."""
        found = np.full(len(terms), -1, np.int64)
        left = np.arange(len(terms))
        for level, bits in enumerate(self.bits):
            at = _place(hashes[left], level, len(bits))
            hit = bits[at]
            found[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        stored = self.terms
        for k in left.tolist() if self.alike else ():
            found[k] = self.alike.get(terms[k], -1)
        same = [s >= 0 and stored[s] == t for s, t in zip(found.tolist(), terms)]
        found[~np.array(same, bool)] = -1
        return found


def _slim(docs: DataFrame, *columns: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(*[empty(c) for c in columns])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The batch's rows, the last column (the text) as bytes and one at a time."""
    texts = batch.column(batch.num_columns - 1).cast(pa.binary())
    yield from zip(*[c.to_pylist() for c in batch.columns[:-1]], (t.as_py() for t in texts))


def kept_terms(docs: DataFrame, least: int = LEAST, counted: int = COUNTED) -> DataFrame:
    """``(lang, term)``: each language's terms that at least ``least`` of its documents have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def give() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                numbers = pa.array(list(counts.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), terms, numbers], ["lang", "term", "n"])
            found.clear()

        for batch in batches:
            for lang, text in _rows(batch):
                found[lang].update(set(terms_of(text)))
                if sum(map(len, found.values())) > counted:
                    yield from give()
        yield from give()

    counts = _slim(docs, "lang", "text").mapInArrow(each, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def build_hashes(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """A perfect hash for each part of a language's terms; ``langs`` says how many parts."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        found = PerfectHash.build([t.as_py() for t in table["term"].cast(pa.binary())])
        lang, part = key[0].as_py(), key[1].as_py()
        row = {"lang": [lang], "part": [part], "terms": [b" ".join(found.terms)], "levels": [found.levels()]}
        return pa.table(row, pa.schema([("lang", pa.string()), ("part", pa.int32()), ("terms", pa.binary()), ("levels", pa.list_(pa.binary()))]))

    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    dealt = kept.join(langs.select("lang", "parts"), "lang").select("lang", part.alias("part"), "term")
    return dealt.groupBy("lang", "part").applyInArrow(build, HASHES)


def _packed(slots: np.ndarray, counts: np.ndarray) -> dict:
    return {"slots": slots.astype("<u4").tobytes(), "counts": counts.astype("<i8").tobytes(), "total": int(counts.sum())}


def _count_batches(rows: Iterator[dict], together: int = 256) -> Iterator[pa.RecordBatch]:
    """The packed counts in batches of a few rows, so that no task holds all of them twice."""
    rows = iter(rows)
    while part := list(islice(rows, together)):
        yield _count_batch(part)


def _count_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("lang", pa.string()), ("part", pa.int32()), ("source", pa.string()), ("terms", pa.binary()), ("slots", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


#: Hashes that a worker has unpacked, by the run they belong to.
_unpacked: dict[str, dict] = {}


class Recount:
    """The second pass in one task, with all hashes at hand."""

    def __init__(self, hashes: dict[str, dict[int, PerfectHash]], parts: dict[str, int], dense: int):
        self.hashes, self.parts, self.most = hashes, parts, dense
        #: Where each part's slots start in the language's array, and how long that is.
        self.starts, self.width = {}, {}
        for lang, n in parts.items():
            sizes = [len(h.terms) if (h := hashes.get(lang, {}).get(p)) else 0 for p in range(n)]
            self.starts[lang] = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            self.width[lang] = int(self.starts[lang][-1])
        self.arrays: dict[tuple[str, str], np.ndarray] = {}
        self.held = 0

    def slots(self, lang: str, terms: list[bytes]) -> np.ndarray:
        hashes = hashes_of(terms)
        parts = hashes.astype(np.int64) % self.parts[lang]
        found = np.full(len(terms), -1, np.int64)
        order = np.argsort(parts, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
            part = int(parts[mine[0]]) if len(mine) else 0
            table = self.hashes.get(lang, {}).get(part)
            if table and len(mine):
                slots = table.slots([terms[k] for k in mine.tolist()], hashes[mine])
                found[mine] = np.where(slots < 0, -1, slots + self.starts[lang][part])
        return found

    def add(self, rows: list[tuple[str, str, list[bytes]]]) -> Iterator[dict]:
        by_lang: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for lang, source, terms in rows:
            by_lang[lang][source].append(terms)
        for lang, sources in by_lang.items():
            if not self.width.get(lang):
                continue
            distinct = list(set(chain.from_iterable(chain.from_iterable(sources.values()))))
            slot_of = dict(zip(distinct, self.slots(lang, distinct).tolist()))
            for source, found in sources.items():
                slots = np.fromiter(map(slot_of.__getitem__, chain.from_iterable(found)), np.int64)
                if (lang, source) not in self.arrays:
                    if self.held and self.held + 8 * self.width[lang] > self.most:
                        yield from self.give()
                    self.arrays[lang, source] = np.zeros(self.width[lang], np.int64)
                    self.held += 8 * self.width[lang]
                self.arrays[lang, source] += np.bincount(slots[slots >= 0], minlength=self.width[lang])

    def give(self) -> Iterator[dict]:
        for (lang, source), array in self.arrays.items():
            used = np.flatnonzero(array)
            cuts = np.searchsorted(used, self.starts[lang])
            for part in range(self.parts[lang]):
                mine = used[cuts[part] : cuts[part + 1]]
                if len(mine):
                    yield {"lang": lang, "part": part, "source": source, "terms": None} | _packed(mine - self.starts[lang][part], array[mine])
        self.arrays, self.held = {}, 0


#: Bytes of text whose terms are looked up together.
CHUNK = 4 << 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str, list[bytes]]]]:
    rows, held = [], 0
    for batch in batches:
        for lang, source, text in _rows(batch):
            rows.append((lang, source, terms_of(text)))
            held += len(text)
            if held >= CHUNK:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def recount(docs: DataFrame, hashes: DataFrame, langs: DataFrame, fits: int = FITS, dense: int = DENSE) -> DataFrame:
    """Packed counts per (lang, part, source): of slots if the hashes fit into ``fits`` bytes, else of terms."""
    spark = docs.sparkSession
    size = F.octet_length("terms") + F.aggregate("levels", F.lit(0), lambda a, b: a + F.octet_length(b))
    small = (hashes.agg(F.sum(size.cast("long"))).first()[0] or 0) <= fits
    parts = {r.lang: r.parts for r in langs.select("lang", "parts").collect()}
    packed = [(r.lang, r.part, bytes(r.terms), [bytes(b) for b in r.levels]) for r in hashes.collect()] if small else []
    sent, run = spark.sparkContext.broadcast((parts, packed)), uuid.uuid4().hex

    def with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, packed = sent.value
        if run not in _unpacked:
            _unpacked.clear()
            tables: dict[str, dict[int, PerfectHash]] = defaultdict(dict)
            for lang, part, terms, levels in packed:
                tables[lang][part] = PerfectHash(terms.split(b" ") if terms else [], levels)
            _unpacked[run] = tables
        count = Recount(_unpacked[run], parts, dense)
        for rows in _chunks(batches):
            yield from _count_batches(count.add(rows))
        yield from _count_batches(count.give())

    def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _ = sent.value
        for rows in _chunks(batches):
            found: dict[tuple[str, str], Counter] = defaultdict(Counter)
            for lang, source, terms in rows:
                found[lang, source].update(terms)
            given = []
            for (lang, source), counts in found.items():
                terms, numbers = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                part = hashes_of(terms).astype(np.int64) % parts[lang]
                for p in np.unique(part).tolist():
                    mine = np.flatnonzero(part == p)
                    row = {"lang": lang, "part": p, "source": source, "terms": b" ".join(terms[k] for k in mine.tolist())}
                    given.append(row | {"slots": None, "counts": numbers[mine].astype("<i8").tobytes(), "total": 0})
            if given:
                yield _count_batch(given)

    return _slim(docs, "lang", "source", "text").mapInArrow(with_hashes if small else with_terms, COUNTS)


def _streamed(rows: DataFrame, head: DataFrame, keys: list[str], each, out: str) -> DataFrame:
    """``each(key, batches' rows)`` over the rows of a key, its row of ``head`` first, as a stream."""
    both = head.withColumn("_body", F.lit(0)).unionByName(rows.withColumn("_body", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "_body").mapInArrow(each, out)


def merge(counts: DataFrame, hashes: DataFrame, salts: int) -> DataFrame:
    """Counts of slots per (lang, part, source), terms looked up, from ``salts`` tasks a part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table, arrays = None, None, {}

        def give() -> list[dict]:
            rows = []
            for source, array in arrays.items():
                used = np.flatnonzero(array)
                if len(used):
                    rows.append({"lang": key[0], "part": key[1], "source": source, "terms": None} | _packed(used, array[used]))
            return rows

        for batch in batches:
            given = []
            for r in batch.to_pylist():
                if not r["_body"]:
                    given += give() if key else []
                    key, arrays = (r["lang"], r["part"], r["salt"]), {}
                    table = PerfectHash(r["names"].split(b" ") if r["names"] else [], r["levels"])
                    continue
                if (r["lang"], r["part"], r["salt"]) != key:
                    continue  # a part in which no term is kept
                n = np.frombuffer(r["counts"], "<i8")
                if r["terms"] is None:
                    slots = np.frombuffer(r["slots"], "<u4").astype(np.int64)
                else:
                    terms = r["terms"].split(b" ")
                    slots = table.slots(terms, hashes_of(terms))
                    n, slots = n[slots >= 0], slots[slots >= 0]
                if r["source"] not in arrays:
                    arrays[r["source"]] = np.zeros(len(table.terms), np.int64)
                arrays[r["source"]][slots] += n
            if given:
                yield _count_batch(given)
        if key:
            yield _count_batch(give())

    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    head = hashes.select("lang", "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("terms").alias("names"), "levels")
    return _streamed(counts.withColumn("salt", salt), head, ["lang", "part", "salt"], each, COUNTS)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (counts + 1) / total)``, by long division in steps of 1000, so that 64 bits hold it."""
    out, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def part_values(terms: list[bytes], counts: np.ndarray, totals: np.ndarray, kept: int, leading: int):
    """From counts (source, slot): sums of all pairs of sources, and each source's leading (slot, value)."""
    p = shares(counts, (totals + kept)[:, None])
    pairs = np.stack([((row - p) ** 2 // p).sum(axis=1) for row in p])
    q = shares(counts.sum(axis=0), np.full(counts.shape[1], totals.sum() + kept))
    by_name = np.empty(len(terms), np.int64)
    by_name[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    best = []
    for row, own in zip(p, counts):
        at = np.flatnonzero((own > 0) & (row > q))
        value = (row[at] - q[at]) ** 2 // q[at]
        if len(at) > leading:
            enough = value >= np.partition(value, -leading)[-leading]
            at, value = at[enough], value[enough]
        order = np.lexsort((by_name[at], -value))[:leading]
        best.append((at[order].tolist(), value[order].tolist()))
    return pairs, best


def evaluate(counts: DataFrame, head: DataFrame, leading: int) -> DataFrame:
    """Each part's share of the sums, and its candidates for the leading terms."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, arrays = None, {}

        def give() -> Iterator[pa.RecordBatch]:
            terms = row["names"].split(b" ") if row["names"] else []
            sources, n = row["sources"], len(row["sources"])
            table = np.zeros((n, len(terms)), np.int64)
            for k, source in enumerate(sources):
                if source in arrays:
                    table[k] = arrays[source]
            if terms:
                pairs, best = part_values(terms, table, np.array(row["totals"], np.int64), row["kept"], leading)
            else:
                pairs, best = np.zeros((n, n), np.int64), [([], [])] * n
            for k, source in enumerate(sources):
                others = [j for j in range(n) if j != k]
                slots, values = best[k]
                items = [sources[j] for j in others] + [terms[s].decode() for s in slots]
                names = ["pair"] * len(others) + ["term"] * len(slots)
                columns = [[row["lang"]] * len(items), [source] * len(items), names, items, [int(pairs[k, j]) for j in others] + values]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types)], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                if not r["_body"]:
                    if row:
                        yield from give()
                    row, arrays = r, {}
                    size = r["names"].count(b" ") + 1 if r["names"] else 0
                elif r["source"] is not None:
                    if r["source"] not in arrays:
                        arrays[r["source"]] = np.zeros(size, np.int64)
                    arrays[r["source"]][np.frombuffer(r["slots"], "<u4")] += np.frombuffer(r["counts"], "<i8")
        if row:
            yield from give()

    return _streamed(counts, head, ["lang", "part"], each, VALUES)


def audit(docs: DataFrame, least: int = LEAST, leading: int = LEADING, fits: int = FITS, slots: int = SLOTS, dense: int = DENSE) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source differs from the others of its language.

    Part ``pair`` has a row for every other source, part ``term`` the up to ``leading``
    terms that the source uses more than its language does.
    """
    groups = _slim(docs, "lang", "source").distinct()
    kept = stage(kept_terms(docs, least), "kept")
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").fillna({"kept": 0})
    # more sources, smaller parts: a part's arrays of all sources stay within CELLS
    most = F.greatest(F.lit(64), F.least(F.lit(slots), F.floor(F.lit(CELLS) / F.size("sources"))))
    langs = stage(langs.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("kept") / most)).cast("int")), "langs")
    hashes = stage(build_hashes(kept, langs), "hashes")
    counts = stage(recount(docs, hashes, langs, fits, dense), "counts")
    packed = counts.filter(F.col("terms").isNotNull()).isEmpty()
    salts = -(-max(1, len(counts.inputFiles())) // TOGETHER)
    if not packed or salts > 1:
        counts = stage(merge(counts, hashes, salts), "merged")
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    whole = langs.select("lang", "kept", F.explode("sources").alias("source")).join(totals, ["lang", "source"], "left")
    whole = whole.groupBy("lang", "kept").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("all"))
    whole = whole.select("lang", "kept", F.col("all.source").alias("sources"), F.col("all.total").alias("totals"))
    # a language without kept terms has one part, and no terms in it
    parts = hashes.select("lang", "part", F.col("terms").alias("names"))
    none = langs.filter("kept = 0").select("lang", F.lit(0).alias("part"), F.lit(b"").alias("names"))
    head = parts.unionByName(none).join(whole, "lang")
    found = evaluate(counts.select("lang", "part", "source", "slots", "counts"), head, leading)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= leading))
