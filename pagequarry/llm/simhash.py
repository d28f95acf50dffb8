"""Near duplicates by 64-bit SimHash fingerprints and a binary-trie self-join.

Distinct fingerprints go into tries. A pair of trie nodes is walked downwards together:
where the two take the same branch nothing is spent, where they part one bit of the
error budget is, and the pair is dropped once the budget is overdrawn. To deal the walk
out to tasks, the trie is laid out several times, each time with another block of bits
on top: with one block more than errors, two fingerprints in budget agree on a whole
block, so each sub-trie below a block's value can be walked on its own, for all
sub-tries of a task at once as arrays of node ranges. Blocks that hold too many
fingerprints are cut by further blocks of their remaining bits, for which the same
holds, so no task holds an unbounded sub-trie and no link is lost.

Defined results: a null text counts as empty; texts without a word have fingerprint
zero and are linked like any other; a null ``doc_id`` is ignored when the smallest id
of a group is taken, and a group of nulls alone has a null id; repeated rows each give
a row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import text_of, whole_row
from pagequarry.llm.components import components, reach
from pagequarry.session import scratch_path, semi_join, shuffles_dropped, stage

#: Fingerprints of one sub-trie at most; larger ones are cut by further blocks.
GROUP = 4096
#: Fingerprints that a task walks at once, in whole sub-tries.
BATCH = 32768
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of UTF-8 text, A-Z in lower case; of the whole words if they are fewer."""
    found = text.lower().split()
    if len(found) < words:
        shingles = iter([b" ".join(found)] if found else [])
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
    n = max(len(found) - words + 1, bool(found))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if over half the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        octets = hashes[at : at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of UTF-8 text."""
    return majority(shingle_hashes(text, words))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every document; ``fp`` is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_buffer().to_pybytes(), words) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"]
            )

    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("octets"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, text_hash long, fp long")


def trie_pairs(fps: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints in budget of each other, within each group.

    ``fps`` has a row per fingerprint and a column per 64 bits, sorted within the groups
    that begin at ``starts`` (the last entry is the end). A trie node is a range of
    places; all live node pairs go down a bit at a time.
    """
    lo, hi = starts[:-1], starts[1:]
    many = hi - lo > 1
    a0, a1 = lo[many], hi[many]
    b0, b1, spent = a0, a1, np.zeros(len(a0), np.int16)
    left, right = [], []
    for bit in range(64 * fps.shape[1]):
        if not len(a0):
            break
        digit = (fps[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        apart = (spent < budget).nonzero()[0]
        cross = apart[a0[apart] != b0[apart]]
        pairs = [
            (a0, am, b0, bm, spent),
            (am, a1, bm, b1, spent),
            (a0[apart], am[apart], bm[apart], b1[apart], spent[apart] + 1),
            (am[cross], a1[cross], b0[cross], bm[cross], spent[cross] + 1),
        ]
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*pairs))
        size_a, size_b = a1 - a0, b1 - b0
        live = (size_a > 0) & (size_b > 0) & ~((a0 == b0) & (size_a == 1))
        leaf = live & (size_a == 1) & (size_b == 1)
        i, j = a0[leaf], b0[leaf]
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int16) <= budget
        left.append(i[near])
        right.append(j[near])
        live &= ~leaf
        a0, a1, b0, b1, spent = (x[live] for x in (a0, a1, b0, b1, spent))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _walk(batches: Iterator[pa.RecordBatch], budget: int, spanning: bool, batch_rows: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a sorted stream of (mask, part, node, fingerprint words)."""

    def solve(mask, part, node, *words):
        words = [w.view(np.uint64) for w in words]
        order = np.lexsort((*reversed(words), part, mask))
        mask, part, node = mask[order], part[order], node[order]
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])])
        starts = np.concatenate([np.flatnonzero(new), [len(node)]])
        i, j = trie_pairs(np.column_stack(words)[order], starts, budget)
        if spanning:
            root = reach(len(node), i, j)
            i = np.flatnonzero(root != np.arange(len(node)))
            j = root[i]
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, batch.num_rows, batch_rows):
            part = [np.asarray(c) for c in batch.slice(at, batch_rows).columns]
            held = [np.concatenate([h, c]) for h, c in zip(held, part)] if held else part
            if len(held[2]) >= batch_rows:
                # the last group may go on in what comes next
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                if not last.all():
                    cut = int(np.flatnonzero(~last)[-1]) + 1
                    yield solve(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
    if held and len(held[2]):
        yield solve(*held)


def _blocks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` blocks of its free bits added."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:]) if y > x]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, budget: int = 2, spanning: bool = True) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``fp`` of ``fps`` at most ``budget`` bits apart.

    With ``spanning``, a sub-trie gives only as many links as hold its linked
    fingerprints together; without, every pair.
    """
    found = None
    masks = {0}
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        children = {m: _blocks(m, budget + 1) for m in masks}
        masks = {c for cs in children.values() for c in cs}
        cut = F.lit(None).cast("array<long>")
        for m, cs in children.items():
            cut = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(c)) for c in cs])).otherwise(cut)
        keyed = rows.select("fp", F.explode(cut).alias("mask")).withColumn("part", F.expr("fp & mask"))
        sizes = stage(keyed.groupBy("mask", "part").count().filter("count > 1"), "blocks")
        joined = keyed.join(sizes, ["mask", "part"])
        small = joined.filter(F.col("count") <= GROUP).select("mask", "part", "fp", F.col("fp").alias("word"))
        walked = (
            small.repartition("mask", "part")
            .sortWithinPartitions("mask", "part")
            .mapInArrow(lambda it: _walk(it, budget, spanning, BATCH), "a long, b long")
        )
        found = walked if found is None else found.union(walked)
        if sizes.filter(F.col("count") > GROUP).isEmpty():
            return found.distinct()
        rows = stage(joined.filter(F.col("count") > GROUP).select("fp", "mask").distinct(), "crowded")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` of every document.

    ``component_id`` is the smallest ``doc_id`` among the documents reached over links.
    """
    marked = stage(fingerprints(docs, words), "fingerprints")
    fps = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return _classes(marked, fps, components(links(fps, budget), "a", "b"))


def _classes(marked: DataFrame, fps: DataFrame, reached: DataFrame) -> DataFrame:
    """``marked`` with each row's component, from the nodes' roots and the smallest id of each ``fp``."""
    linked = fps.join(reached.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "component_id")
    alone = fps.join(classes.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return marked.join(stage(classes.union(alone), "classes"), "fp")


#: For similarity on shingle sets: least hashes, words of a parity bitmap, and members of a bucket compared at once.
LEAST, WORDS, CLOSE = 12, 8, 1024
#: Words of a second parity bitmap, for pairs of sets too large for the first to tell apart.
WIDE = 64
#: Rounds of pivots at most before all open pairs are taken; the links found span the same classes after any number.
PIVOTS = 4


def parity(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A bit per residue of the hashes: whether an odd number of them has it."""
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, text_hash, fp, n, p0.., least, wide)`` of the shingle set: hash, size, parity bitmap, least hashes, wide bitmap."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            bits, least, wide = np.zeros((WORDS, batch.num_rows), np.uint64), [], []
            for k, x in enumerate(batch.column(2)):
                hashes = np.unique(shingle_hashes(x.as_buffer().to_pybytes(), words))
                fp[k], n[k] = xxhash.xxh64_intdigest(hashes.tobytes(), 42), len(hashes)
                bits[:, k] = parity(hashes)
                wide.append(parity(hashes, WIDE).view(np.int64))
                least.append(np.array([mixed(hashes, m).min() for m in range(LEAST * bool(len(hashes)))], np.uint64).view(np.int64))
            columns = [*batch.columns[:2], pa.array(fp.view(np.int64)), pa.array(n), *[pa.array(w.view(np.int64)) for w in bits]]
            columns += [pa.array(least, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))]
            names = ["doc_id", "text_hash", "fp", "n", *[f"p{w}" for w in range(WORDS)], "least", "wide"]
            yield pa.RecordBatch.from_arrays(columns, names)

    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("octets"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = ", ".join(f"p{w} long" for w in range(WORDS))
    return rows.mapInArrow(each, f"doc_id {kind}, text_hash long, fp long, n long, {out}, least array<long>, wide array<long>")


def shingle_sets(docs: DataFrame, words: int, texts: DataFrame) -> DataFrame:
    """``(node, hashes)``: the shingle sets of the documents whose ``text_hash`` is in ``texts``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(x.as_buffer().to_pybytes(), words)) for x in batch.column(1)]
            fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in found], np.uint64)
            hashes = pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), hashes], ["node", "hashes"])

    rows = docs.select(F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("octets"))
    return semi_join(rows, texts, "text_hash").mapInArrow(each, "node long, hashes array<long>").dropDuplicates(["node"])


def least_apart(a: str, b: str) -> Column:
    """At least so many elements are in one of two sets alone, by their sizes and parity bitmaps.

    Every bit in which the bitmaps differ takes an element that is in one set alone.
    """
    bits = sum((F.bit_count(F.col(f"{a}.p{w}").bitwiseXOR(F.col(f"{b}.p{w}"))) for w in range(WORDS)), F.lit(0))
    return F.greatest(bits, F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")))


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """False only for sets that sizes or parity bitmaps prove to be less similar."""
    share = (1 - similarity) / (1 + similarity)
    return least_apart(a, b) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * share + 1e-6


def still_similar(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` ``(a, b)`` that the wide bitmaps don't prove to be less similar, before any set is moved."""
    share = (1 - similarity) / (1 + similarity)
    wide = lambda end, out: nodes.select(F.col("node").alias(end), F.struct("n", "wide").alias(out))
    both = pairs.select("a", "b").join(wide("a", "x"), "a").join(wide("b", "y"), "b")
    bits = F.zip_with("x.wide", "y.wide", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    return both.filter(apart <= (F.col("x.n") + F.col("y.n")) * share + 1e-6).select("a", "b")


def by_node(sets: DataFrame) -> DataFrame:
    """``sets`` written in buckets by node under the shared folder, so that joins on it move only the other side."""
    spark = sets.sparkSession
    path = scratch_path(spark, "sets")
    name, parts = "sets_" + path.rsplit("-", 1)[1], int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "node").write.format("parquet").bucketBy(parts, "node").sortBy("node")
    with shuffles_dropped(spark):
        dealt.option("path", path).saveAsTable(name)
    return spark.table(name)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` ``(a, b)`` whose sets have this Jaccard similarity, counted exactly."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common, size = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return stage(both.filter((1 + similarity) * common >= similarity * size - 1e-6).select("a", "b"), "verified")


def _open(members: DataFrame, reached: DataFrame) -> DataFrame:
    """The ``members`` ``(bucket, node, root, ..)`` with the roots of ``reached``, of the buckets that still hold several."""
    placed = members.join(reached.withColumnRenamed("root", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
    several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    return placed.join(several.select("bucket"), "bucket")


def similar_links(
    nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, linked: DataFrame | None = None
) -> DataFrame:
    """Links ``(a, b)`` that hold the nodes ``(node, n, p0.., least)`` at this similarity together.

    ``sets`` gives ``(node, hashes)`` for nodes. Links found otherwise, ``linked``, come along; nodes
    that they hold together are not compared any more. Nodes are dealt into buckets by each least
    hash; a pair shares each with its similarity. The members of a bucket are compared with
    one pivot first, each node with the likeliest of its buckets' pivots. Where that leaves a bucket with several classes, all its pairs of
    different classes are compared: its members are dealt into parts, and each pair of
    parts is a key of its own, so a bucket of any size is compared whole.
    """
    about = nodes.select("node", F.struct("node", "n", *[f"p{w}" for w in range(WORDS)]).alias("own"))
    keys = nodes.select("node", F.posexplode("least").alias("m", "key")).select("node", F.xxhash64("m", "key").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members, found = keys.join(shared, "bucket").withColumn("root", F.col("node")), linked
    rest = stage(members if linked is None else _open(members, components(linked, "a", "b")), "members")
    held = by_node(sets(rest.select("node").distinct()))
    for k in range(PIVOTS):
        pivots = rest.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(k))).alias("pivot"))
        pairs = rest.join(pivots, "bucket").filter(F.col("root") != F.col("pivot.root"))
        pairs = pairs.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct()
        pairs = pairs.join(about.toDF("a", "x"), "a").join(about.toDF("b", "y"), "b").filter(may_be_similar("x", "y", similarity))
        # a node's sets travel with each pair, so of its pivots only the likeliest is tried now
        apart = F.struct(least_apart("x", "y") / (F.col("x.n") + F.col("y.n")), "b")
        pairs = pairs.groupBy("a").agg(F.min_by("b", apart).alias("b"))
        fresh = verified(still_similar(pairs, nodes, similarity), held, similarity)
        found = fresh if found is None else found.union(fresh)
        rest = stage(_open(rest, components(found, "a", "b")), "open")
        if rest.filter(F.col("size") > CLOSE).isEmpty():
            break
    parts = F.ceil(F.col("size") / CLOSE).cast("int")
    rest = rest.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).join(about, "node")
    low = rest.select("bucket", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.struct("own", "root").alias("x"))
    high = rest.select("bucket", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.struct("own", "root").alias("y"))
    both = low.join(high, ["bucket", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x.own.node") < F.col("y.own.node")))
    both = both.filter((F.col("x.root") != F.col("y.root")) & may_be_similar("x.own", "y.own", similarity))
    ends = F.least("x.own.node", "y.own.node").alias("a"), F.greatest("x.own.node", "y.own.node").alias("b")
    pairs = stage(still_similar(both.select(*ends).distinct(), nodes, similarity), "pairs")
    return found.union(verified(pairs, held, similarity))


def trie_classes(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """``(text_hash, root)`` of every text: the smallest fingerprint that its own reaches over the trie's links."""
    marked = stage(fingerprints(docs, words).select("text_hash", "fp").distinct(), "fingerprints")
    reached = components(links(marked.select("fp").distinct(), budget), "a", "b")
    found = marked.join(reached.withColumnRenamed("node", "fp"), "fp", "left")
    return found.select("text_hash", F.coalesce("root", "fp").alias("root"))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, classes: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` with links at this Jaccard similarity of the shingle sets.

    Each link is checked on the sets themselves; ``fp`` is a hash of the set. A pair at 0.8
    is missed if it shares none of the least hashes: one in 240 million. Texts of one root in
    ``classes`` ``(text_hash, root)``, such as :func:`trie_classes`, are linked as well.
    """
    bits = [f"p{w}" for w in range(WORDS)]
    marked = stage(sketches(docs, words), "sketches")
    same = [F.first(c).alias(c) for c in ("n", *bits, "least", "wide")]
    nodes = marked.groupBy("fp").agg(*same, F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("first"))
    nodes = stage(nodes, "distinct")

    def sets(wanted: DataFrame) -> DataFrame:
        texts = nodes.withColumnRenamed("fp", "node").join(wanted, "node", "left_semi").select("text_hash")
        return shingle_sets(docs, words, texts)

    linked = None
    if classes is not None:
        ends = marked.join(classes, "text_hash").select("root", F.col("fp").alias("a")).distinct()
        least = ends.groupBy("root").agg(F.min("a").alias("b"), F.max("a").alias("hi")).filter("b < hi")
        linked = stage(ends.join(least, "root").filter("a > b").select("a", "b"), "linked")
    found = similar_links(nodes.withColumnRenamed("fp", "node"), sets, similarity, linked)
    return _classes(marked.select("doc_id", "text_hash", "fp"), nodes.select("fp", "first"), components(found, "a", "b"))


def keep_one(docs: DataFrame, near: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of ``near``: the one of the smallest ``doc_id``.

    Among rows of the same id the smallest text hash decides; of rows alike in both, one stays.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "fp")
    roots = near.withColumn("_none", F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = roots.groupBy("component_id", "_none").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    kept = kept.select(key.alias("_id"), F.col("text_hash").alias("_hash"))
    keyed = docs.select(key.alias("_id"), F.xxhash64(text_of()).alias("_hash"), whole_row(docs).alias("_row"))
    return keyed.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
