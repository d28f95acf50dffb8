"""The operators on documents against plain versions, and on odd and empty tables."""

import base64
import hashlib
import random
import re
import struct
import time
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import bpe, langid, linedup, mixing, pii, simhash, toxicity
from pagequarry.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------ near duplicates


def plain_fingerprint(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", lower)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)][: len(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, budget):
    """Of {id: fingerprint}, the smallest id each id reaches."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_is_the_plain_one(spark, odd_docs):
    got = rows(simhash.fingerprints(odd_docs), "doc_id", "fp")
    want = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()]
    assert got == sorted(((i, f - (1 << 64) if f >> 63 else f) for i, f in want), key=repr)


@pytest.mark.parametrize("group", [8, 4096])
def test_trie_join_finds_every_link(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    base = [rng.getrandbits(64) for _ in range(40)] + [0]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {tuple(sorted(r)) for r in simhash.links(df, 2, spanning=False).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert got == want
    held = {r.node: r.root for r in components(simhash.links(df, 2), "a", "b").collect()}
    assert {k: v for k, v in classes({signed(f): f for f in fps}, 2).items() if k in held} == held


@pytest.mark.parametrize("at_once", [4, 1 << 16])
def test_components_of_any_size_and_few_tables(spark, at_once):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(1, 40)]
    links += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    odd = [(None, 5), (5, None), (7, 7), *links[:10]]
    df = spark.createDataFrame([*links, *odd], "a long, b long").repartition(8)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    got = components(df, "a", "b", at_once)
    made = set(folder.iterdir()) - before
    assert sorted(map(tuple, got.collect())) == sorted(root.items())
    # a small graph is settled without rounds of written tables
    assert at_once < len(links) or len(made) == 2
    assert components(df.limit(0), "a", "b", at_once).count() == 0


def test_near_duplicates_on_odd_rows(spark, odd_docs, no_docs):
    near = simhash.near_duplicates(odd_docs)
    assert near.count() == odd_docs.count()
    by_id = {r.doc_id: r.component_id for r in near.filter("doc_id is null or doc_id <> 1").collect()}
    assert by_id[2] == by_id[3] == by_id[4] == 2 and by_id[None] in (1, 2)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs, near)
    assert kept.columns == odd_docs.columns
    assert kept.count() == near.select("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).distinct().count()


def test_similar_sets_share_a_class(spark, odd_docs, no_docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(80, 300))
        texts.append(base)
        for _ in range(2):
            copy = list(base)
            for _ in range(len(base) // 80):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    df = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    close = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
    assert close and sum(got[i] == got[j] for i, j in close) >= 0.98 * len(close)
    assert all(i // 3 == got[i] // 3 for i in got)
    assert simhash.similar(odd_docs).count() == odd_docs.count() and simhash.similar(no_docs).count() == 0


def exact_classes(texts, similarity=0.8):
    """The smallest number each text reaches over pairs of this exact Jaccard similarity, and all similarities."""
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root, alike = list(range(len(sets))), {}
    for i in range(len(sets)):
        for j in range(i):
            alike[j, i] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if alike[j, i] >= similarity and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root, alike


def edited(rng, base, edits):
    copy = list(base)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = f"new{rng.random()}"
    return copy


@pytest.mark.parametrize("close", [8, 1024])
def test_crowded_buckets_are_compared_whole(spark, close, monkeypatch):
    monkeypatch.setattr(simhash, "CLOSE", close)
    rng = random.Random(11)
    base = [f"w{rng.random()}" for _ in range(200)]
    texts = [edited(rng, base, rng.randrange(1, 6)) for _ in range(80)]
    for _ in range(30):  # chains that leave the group step by step
        texts.append(edited(rng, rng.choice(texts), rng.randrange(1, 6)))
    want, _ = exact_classes(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_links_are_exact_around_the_limit(spark):
    rng = random.Random(12)
    texts = []
    for k in range(150):
        base = [f"w{rng.random()}" for _ in range(rng.randrange(60, 300))]
        texts += [base, edited(rng, base, max(1, round(len(base) * (0.02 + 0.04 * k / 150))))]
    want, alike = exact_classes(texts)
    steps = [alike[2 * k, 2 * k + 1] for k in range(150)]
    assert sum(0.6 <= s < 0.8 for s in steps) > 30 and sum(0.8 <= s < 0.85 for s in steps) > 10
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


# ------------------------------------------------------------------ line runs


def plain_line_dedup(texts, least):
    """Texts (in order) without the lines of runs of ``least`` words that occur earlier, by all runs."""
    seqs = [[(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    first, cut = {}, [set() for _ in texts]
    for d, seq in enumerate(seqs):
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                run = tuple(x for _, x in seq[i:j])
                if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (d, i)) != (d, i):
                    cut[d] |= set(range(seq[i][0], seq[j - 1][0] + 1))
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[d]) for d, t in enumerate(texts)]


def test_line_runs_against_all_runs(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdef", k=rng.randrange(1, 5))) + f" {k}" for k in range(9)] + ["", "  "]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(0, 14))) for _ in range(60)]
    texts += [texts[3], texts[3], "\n".join([pool[0]] * 12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in linedup.drop_repeats(df, 8).collect()}
    assert [got[i] for i in range(len(texts))] == plain_line_dedup(texts, 8)


def test_line_runs_on_odd_rows(spark, odd_docs, no_docs):
    out = linedup.drop_repeats(odd_docs)
    assert out.count() == odd_docs.count() and linedup.drop_repeats(no_docs).count() == 0
    got = {r.doc_id: r for r in out.filter("doc_id > 1").collect()}
    # the third copy of a line within a document, and all after the first document's
    assert got[8].text == "" and got[8]._deleted == 3 and got[7]._deleted == 0 and got[2].text == ""
    # rows alike in id and text count as one document
    assert out.filter("doc_id = 1 and _deleted = 0").count() == 3
    clean = linedup.clean_documents(odd_docs)
    assert clean.columns == odd_docs.columns and clean.filter("doc_id = 8 or doc_id is null and text is not null and text <> ''").count() == 0


# ------------------------------------------------------------------ mixing


def test_targets_fill_up_to_the_cap(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), ("d", 5), (None, 50)]
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes], "no_source boolean, src string, size long")
    got = {(r.no_source, r.src): r.target for r in mixing.targets(df).collect()}
    weights = dict(zip("abcd", (5, 2, 1, 5))) | {None: 2}
    goal, free, left = {}, dict(sizes), sum(n for _, n in sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * dict(sizes)[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3.0 * free.pop(s)
            left -= goal[s]
    assert {(s is None, s or ""): pytest.approx(t) for s, t in goal.items()} == got


def test_demand_is_inverted(spark):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    for knots in mixing.SCHEDULES:
        area = np.trapezoid([w for _, w in knots], [t for t, _ in knots])
        for r in df.select("s", mixing.demand_inverse(F.col("s"), knots).alias("t")).collect():
            grid = np.linspace(0, r.t, 2001)
            rate = np.interp(grid, [t for t, _ in knots], [w for _, w in knots])
            assert np.trapezoid(rate, grid) / area == pytest.approx(r.s, abs=1e-6)


def test_mix_on_odd_rows(spark, odd_docs, no_docs):
    mixed = mixing.mix(odd_docs)
    assert mixed.count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert mixed.filter("taken > 3 * size or copies <> size(positions)").count() == 0
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert rows(mixing.mix(odd_docs), "doc_id", "size", "taken") == rows(mixed, "doc_id", "size", "taken")


# ------------------------------------------------------------------ byte pairs


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_agrees_with_the_library():
    encoder, plain = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN), reference()
    rng = random.Random(1)
    parts = ["a", "the", " ", "\n", "'s", "é", "日本", "😀", "12", "²", "_", "-", "\x1c", "\x85", " ", "ß", "====", "aaaa", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(50))) for _ in range(3000)]
    texts += ["a" * 30_000, "ab" * 20_000, "=" * 50_000, "".join(rng.choices("abcdefgh", k=60_000)), " " * 4000, ""]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_long_repetitive_pieces_are_merged_in_time():
    encoder = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(12)
    for part in ("ab", "x", "éa", "ingtion", "thethe", "aabab"):
        text = part * (4000 // len(part))
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == library.encode_ordinary(text)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "b", "t", "i", "o", "n", "ing", "er", "é", "s", "ch", "de"], k=rng.randrange(1, 40)))
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == library.encode_ordinary(text)
    began = time.process_time()
    for part in ("ab", "x", "schen"):
        assert encoder.decode(next(encoder.encode([part * (1_000_000 // len(part))])))[:5] == (part * 5).encode()[:5]
    assert time.process_time() - began < 20  # the square of the length would take days


def test_rank_queue_gives_the_lowest_rank():
    rng, queue, held = random.Random(4), bpe.RankQueue(50_257), []
    for _ in range(3000):
        if held and rng.random() < 0.5:
            rank, places = queue.pop()
            assert rank == min(held) and sum(len(p) for p in places) == held.count(rank)
            held = [r for r in held if r != rank]
        else:
            held.append(rng.choice([0, 63, 64, 4095, 4096, 50_256, rng.randrange(50_257)]))
            queue.push(held[-1], np.zeros(1, np.int64))


def test_encode_documents(spark, odd_docs, no_docs):
    plain = reference()
    got = rows(bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, ids=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in odd_docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ personal data


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(digits))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_against_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b", ".", "@", "-", "_", "1", "25", "255", "4", " ", "+", "(", ")", "é", "x@y.z", "4111 1111 1111 1111", "😀", "1.2.3.4", "%", "\n", "+49 "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3000)] + ["4111111111111111" * 50, "a@b.c " * 300, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.scan(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == plain_spans(texts[r.doc_id] or "")


def test_disclosing_terms(spark, odd_docs, no_docs):
    docs = [(i, f"call boss Zanzibar{'x' * (i % 3)} Miller at bob@corp.example about plan {'abcdefghij'[i]}qq") for i in range(6)]
    docs += [(10 + i, "call the boss about nothing at all with a plan") for i in range(30)]
    docs += [(50, None), (51, "Zanzibar alone far from anyone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.digests(pii.personal_data(df, support=3)).collect()}
    words = {docs[0][1][int(a) : int(b)] for a, b in (x.split(":")[1:] for x in out[0].spans.split(",") if x.startswith("term"))}
    assert "Miller" in words and not words & {"call", "boss", "plan", "about"}
    assert out[50].spans == "" and out[10].spans == ""
    text = {r.doc_id: r.text for r in pii.sanitise(df, support=3).collect()}
    assert "[EMAIL]" in text[0] and "Miller" not in text[0] and text[50] is None and text[10] == docs[6][1]
    assert pii.digests(pii.personal_data(odd_docs)).count() == odd_docs.count()
    assert pii.personal_data(no_docs).count() == 0 and pii.sanitise(odd_docs).columns == odd_docs.columns


def test_terms_far_from_the_entity_and_without_it(spark):
    filler = "some quite plain filler words that go on for a long while and then on again "
    docs = [(i, f"Zanzibar {filler * 2}number {'abcdefgh'[i] * 4} mail bob@corp.example") for i in range(6)]
    docs += [(10 + i, filler + f"mail number {'abcdefgh'[i % 8] * 4}") for i in range(80)] + [(99, filler + "met Zanzibar once")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.digests(pii.personal_data(df, support=3)).collect()}
    at = len(filler) + 4
    assert "term:0:8" in out[0] and out[99] == f"term:{at}:{at + 8}" and out[10] == ""
    text = {r.doc_id: r.text for r in pii.sanitise(df, support=3).collect()}
    assert "Zanzibar" not in text[0] + text[99]


# ------------------------------------------------------------------ toxicity and language


def plain_marginals(model, tokens):
    """Forward-backward over every token."""
    found = [np.nan_to_num(model.emission(t)) + model.bias for t in tokens]
    own, move = np.exp([[0.0, e] for e in found]), np.exp(model.transition)
    a, b = own.copy(), np.ones_like(own)
    for k in range(1, len(own)):
        a[k] = a[k - 1] @ move * own[k]
        a[k] /= a[k].sum()
    for k in range(len(own) - 2, -1, -1):
        b[k] = move @ (own[k + 1] * b[k + 1])
        b[k] /= b[k].sum()
    return (a * b)[:, 1] / (a * b).sum(axis=1)


def labelled(rng, n):
    clean = [f"plain{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(5, 90))
        if toxic := i % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["gruff", "vileness", "Vilest", "SNARK"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_field_learns_and_its_marginals_are_exact(spark, odd_docs, no_docs):
    rng = random.Random(8)
    texts, labels = labelled(rng, 400)
    model = toxicity.fit([t for t, y in zip(texts, labels) if y], [t for t, y in zip(texts, labels) if not y])
    fresh, truth = labelled(rng, 200)
    assert sum((model.tag(t)[0] >= toxicity.REJECT) == bool(y) for t, y in zip(fresh, truth)) >= 195
    for text in fresh[:60]:
        places, got = model.marginals(text)
        assert np.allclose(plain_marginals(model, toxicity.TOKEN.findall(text))[places], got)
    score, starts, ends = model.tag("so 😀 gruff, plain1 gruff!")
    assert [("so 😀 gruff, plain1 gruff!")[a:b] for a, b in zip(starts, ends)] == ["gruff", "gruff"] and score > 0.7
    out = odd_docs.select("doc_id", toxicity.tagger(model)(F.col("text")).alias("t"))
    assert out.filter("t.score >= 0.7").count() == 0 and out.count() == odd_docs.count()
    assert toxicity.reject(odd_docs, model).count() == odd_docs.count()
    assert toxicity.reject(no_docs, model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(odd_docs, none, toxicity.learn_fold()).weights == {}


def test_network_gradients():
    net = langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(60, 130, (12, 5)).astype(np.uint16)
    y = np.array([0, 1, 2, 1, 0])

    def loss():
        letters = langid.IS_LETTER[x]
        return -(np.log(net.probabilities(x)[y, :, np.arange(5)].T) * letters).sum() / letters.sum()

    for name, grad in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(grad[name] if isinstance(grad, dict) else grad).argmax(), grad.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        high = loss()
        net.p[name][at] = old - 1e-2
        low = loss()
        net.p[name][at] = old
        assert grad[at] == pytest.approx((high - low) / 2e-2, rel=1e-2, abs=1e-6), name


def test_language_of_held_out_texts(spark, odd_docs, no_docs):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "é", "oir"]}
    docs = []
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        docs.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(4, 60))), lang))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    network = langid.learn(df, F.col("doc_id") < 200)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, network).collect()}
    assert Counter(got[i] == lang for i, _, lang in docs[200:])[True] >= 98
    assert network.positions("kato schein".encode()).shape == (11, 3)
    odd = {r.doc_id: r for r in langid.identify(odd_docs, network).filter("doc_id > 1").collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (2, 3, 4, 10)) and odd[9].lang_pred != "und"
    assert langid.identify(no_docs, network).count() == 0
    assert langid.learn(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}


def test_every_language_has_an_output(spark):
    rng = random.Random(5)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 256 * k + x) for x in range(4)]
        rows += [(100 * k + i, "".join(rng.choices(letters, k=30)), f"l{k:02}") for i in range(8 if k < 64 else 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.learn(df, F.lit(True))
    assert network.langs == [f"l{k:02}" for k in range(70)] and network.p["out"].shape[0] == 70
    found = {r.doc_id: r.lang_pred for r in langid.identify(df, network).collect()}
    assert {found[100 * k] for k in range(64, 70)} & {f"l{k:02}" for k in range(64, 70)}


def test_numbers_are_no_letters_and_rows_alike_teach(spark):
    rows = [(k, f"{'ka to mi' if k % 2 else 'sch ung ein'} {k} wort", "aa" if k % 2 else "bb") for k in range(40)]
    alike = [(1000 + lang, f"qx{lang} zz{lang} " * 9, f"l{lang}") for lang in range(6) for _ in range(50)]
    docs = spark.createDataFrame(rows + alike, "doc_id long, text string, lang string").repartition(4)
    network = langid.learn(docs, F.lit(True), per_lang=5)
    assert network.langs == ["aa", "bb", *[f"l{k}" for k in range(6)]]
    odd = spark.createDataFrame([(1, "\u00b2 \u00bd \u2460 \u2167"), (2, "12 _ 3"), (3, "\u00e9")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, network).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"
    again = langid.learn(docs.repartition(7), F.lit(True), per_lang=5)
    assert all(np.array_equal(network.p[k], again.p[k]) for k in network.p)


def plain_states(p, d, x):
    """A gated unit read off its definition, one byte after the other."""
    h = langid.STATES
    sigma = lambda v: 1 / (1 + np.exp(-v))
    state, out = np.zeros(h), {}
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        gates, inner = p[f"{d}x"][:, x[t]].astype(float), p[f"{d}h"].astype(float) @ state
        update, reset = sigma(gates[:h] + inner[:h]), sigma(gates[h : 2 * h] + inner[h : 2 * h])
        new = np.tanh(gates[2 * h :] + reset * inner[2 * h :])
        state = (1 - update) * new + update * state
        out[t] = state
    return np.array([out[t] for t in range(len(x))])


def test_network_is_the_plain_recurrent_one():
    net = langid.Network(["a", "b", "c"], seed=3)
    x = np.random.default_rng(1).integers(0, 257, 20)
    both = np.concatenate([plain_states(net.p, "f", x), plain_states(net.p, "b", x)], axis=1)
    scores = both @ net.p["out"].astype(float).T + net.p["bias"][:, 0]
    want = np.exp(scores - scores.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    got = net.probabilities(x.astype(np.uint16)[:, None])[:, :, 0]
    assert np.allclose(got.T if got.shape[0] == 3 else got, want, atol=1e-4)


def test_pipeline_keeps_one_of_what_the_trie_links(spark):
    """Texts of one much repeated phrase differ in no bit, though hardly any of their shingles is shared."""
    from corpus_pipeline import drop_near_copies

    tails = [" ".join(f"{w}{i}" for i in range(40)) for w in ("left", "right")]
    texts = ["spam and eggs " * 400 + t for t in tails] + [" ".join(f"alone{i}" for i in range(60))]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    apart = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    trie = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert apart == {0: 0, 1: 1, 2: 2} and trie == {0: 0, 1: 0, 2: 2}
    assert {r.doc_id for r in drop_near_copies(spark, df, "").collect()} == {0, 2}


def test_links_of_both_kinds_make_one_class(spark):
    """What the trie links and what is similar join up, over texts that both know."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:-4], "a", "b", "c", "d"]), "other text of a few words here", "and one more that is alone too"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = df.selectExpr("doc_id", "xxhash64(text) as text_hash")
    classes = hashed.selectExpr("text_hash", "if(doc_id in (1, 2), 7L, doc_id) as root")
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r.doc_id: r.component_id for r in simhash.similar(df, classes=classes).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
