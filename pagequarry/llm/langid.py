"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 in windows of ``WINDOW`` bytes, once forwards and once backwards;
at every position both states together give a distribution over the languages. A
document's distribution is the mean over the positions of its letters, in all windows of
the whole text. It is trained here, in numpy, by backpropagation through time on windows
cut from about ``per_lang`` documents of each language (never more than twice as many in
all); every labelled language has an output, however many there are.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
rows to learn from everything is ``und``; rows of null ``lang`` teach nothing; of equal
probabilities the first language by name wins; repeated rows each give a row; an empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import other_numbers
from pagequarry.llm.common import text_of
from pagequarry.session import stage

WINDOW, PAD, STATES = 64, 256, 8
#: Windows run through the network together, and languages from which on they are fewer and training is longer.
TOGETHER, MANY = 2048, 64
PER_LANG = 1500
#: Letters alone: the engine's word characters without digits, other numbers and the underscore.
LETTER = re.compile(rf"[^\W\d_{other_numbers()}]")
#: Bytes of letters: ASCII letters and all bytes of longer code points.
IS_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)] + [False])


class Network:
    """Forward and backward gated units, and the layer that reads both."""

    def __init__(self, langs: list[str], seed: int = 7):
        self.langs = langs
        rng = np.random.default_rng(seed)
        h, c = STATES, len(langs)
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        #: Gates in the order update, reset, new; columns are bytes.
        self.p = {"out": draw(c, 2 * h, scale=0.3), "bias": np.zeros((c, 1), np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": draw(3 * h, 257, scale=0.3), f"{d}h": draw(3 * h, h, scale=0.3)}

    def _run(self, d: str, x: np.ndarray, keep: bool = False):
        """States at every position of windows ``x`` (position, window); with ``keep`` also what training needs."""
        h = STATES
        # signs and a factor go into the weights, so each gate is one exponential
        fold = np.repeat(np.array([-1, -1, 2], np.float32), h)[:, None]
        wx, wh = self.p[f"{d}x"] * fold, self.p[f"{d}h"] * fold
        state = np.zeros((h, x.shape[1]), np.float32)
        states = np.empty((len(x), *state.shape), np.float32)
        kept = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates, inner = np.take(wx, x[t], axis=1), wh @ state
            both = gates[: 2 * h]
            both += inner[: 2 * h]
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            new = inner[2 * h :]
            if keep:
                pre = new / 2
            new *= both[h:]
            new += gates[2 * h :]
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            if keep:
                kept.append((t, state, both[:h].copy(), both[h:].copy(), pre, new))
            state = state - new
            state *= both[:h]
            state += new
            states[t] = state
        return states, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(language, position, window)."""
        with np.errstate(over="ignore"):
            f, b = self._run("f", x)[0], self._run("b", x)[0]
        h = STATES
        flat = lambda s: s.transpose(1, 0, 2).reshape(h, -1)
        logits = self.p["out"][:, :h] @ flat(f) + self.p["out"][:, h:] @ flat(b) + self.p["bias"]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(len(logits), *x.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss at the letters of windows ``x``, whose languages are ``y``."""
        h = STATES
        (f, kept_f), (b, kept_b) = self._run("f", x, True), self._run("b", x, True)
        both = np.concatenate([f, b], axis=1)
        logits = np.einsum("ck,tkn->tcn", self.p["out"], both) + self.p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        wrong = np.exp(logits)
        wrong /= wrong.sum(axis=1, keepdims=True)
        wrong[:, y, np.arange(len(y))] -= 1
        letters = IS_LETTER[x][:, None, :]
        wrong *= letters / max(1, letters.sum())
        grad = {"out": np.einsum("tcn,tkn->ck", wrong, both), "bias": wrong.sum(axis=(0, 2))[:, None]}
        back = np.einsum("ck,tcn->tkn", self.p["out"], wrong)
        for d, kept, part in (("f", kept_f, back[:, :h]), ("b", kept_b, back[:, h:])):
            wh = self.p[f"{d}h"]
            gx, gh = np.zeros((257, 3 * h), np.float32), np.zeros_like(wh)
            carry = np.zeros((h, x.shape[1]), np.float32)
            for t, state, update, reset, inner, new in reversed(kept):
                carry = carry + part[t]
                d_new = carry * (1 - update) * (1 - new * new)
                d_update = carry * (state - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                d_state = np.concatenate([d_update, d_reset, d_new * reset])
                d_input = np.concatenate([d_update, d_reset, d_new])
                np.add.at(gx, x[t], d_input.T)
                gh += d_state @ state.T
                carry = carry * update + wh.T @ d_state
            grad |= {f"{d}x": gx.T, f"{d}h": gh}
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 220, batch: int = 384, rate: float = 0.02, seed: int = 3):
        """Adam steps on batches of windows (position, window)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for at in range(1, steps + 1):
            some = rng.integers(0, x.shape[1], batch)
            pace = rate * min(1.0, 2 * (1 - at / (steps + 1)))
            with np.errstate(over="ignore"):
                grads = self.gradients(x[:, some], y[some])
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= pace * (first[k] / (1 - 0.9**at)) / (np.sqrt(second[k] / (1 - 0.99**at)) + 1e-8)

    def positions(self, text: bytes) -> np.ndarray:
        """The distribution at every byte of a text (byte, language)."""
        x = windows([text])[0]
        return self.probabilities(x).transpose(2, 1, 0).reshape(-1, len(self.langs))[: len(text)]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution over each text's letter bytes, zeros if it has none (text, language)."""
        x, owner = windows(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        together = max(1, TOGETHER * MANY // max(MANY, len(self.langs)))
        for at in range(0, x.shape[1], together):
            part, own = x[:, at : at + together], owner[at : at + together]
            letters = IS_LETTER[part]
            found = np.einsum("ctn,tn->nc", self.probabilities(part), letters.astype(np.float32))
            np.add.at(sums, own, found)
            np.add.at(count, own, letters.sum(axis=0))
        return sums / np.maximum(count, 1)[:, None]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, (position, window), and whose each is."""
    many = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.full(int(many.sum()) * WINDOW, PAD, np.uint16)
    at = 0
    for text, n in zip(texts, many.tolist()):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * WINDOW
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), np.repeat(np.arange(len(texts)), many)


def learn(docs: DataFrame, learns: Column, per_lang: int = PER_LANG) -> Network | None:
    """A network trained on windows of the rows for which ``learns`` holds; None without any."""
    rows = docs.filter(learns & F.col("lang").isNotNull() & text_of().rlike(r"\p{L}"))
    # a row is drawn if its hash lies below its language's share: no language is gathered in one
    # place; the least hash is drawn anyway, so rows that are all alike teach their language, too
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    counts = stage(rows.groupBy("lang").agg(F.count("*").alias("count"), F.min(draw).alias("_least")), "langs")
    names = sorted(r.lang for r in counts.select("lang").collect())
    if not names:
        return None
    shares = counts.select("lang", (per_lang / F.col("count")).alias("_share"), "_least")
    octets = F.col("text").cast("binary")
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1))
    parts = F.array(*[F.substring(octets, (place(k) + 1).cast("int"), F.lit(WINDOW)) for k in range(3)])
    drawn = (draw < F.col("_share")) | (draw == F.col("_least"))
    picked = rows.select("doc_id", "text", "lang").join(shares, "lang").filter(drawn)
    picked = picked.select("lang", F.explode(F.array_distinct(parts)).alias("part")).distinct()
    # by hash, so that reruns learn from the same windows should there be too many
    picked = picked.orderBy(F.xxhash64("lang", "part"), "lang", "part").limit(6 * per_lang * len(names))
    places = {name: k for k, name in enumerate(names)}
    found = sorted((places[r.lang], bytes(r.part)) for r in picked.collect() if r.part)
    x, owner = windows([part for _, part in found])
    network = Network(names)
    steps = 220 * max(MANY, len(names)) // MANY
    network.train(x, np.array([k for k, _ in found])[owner], steps)
    return network


#: Bytes of text whose windows are laid out together.
CHUNK = 8 << 20


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(texts: list[str]) -> tuple[list[str], list[float]]:
            if network is None:
                return ["und"] * len(texts), [0.0] * len(texts)
            found = network.pooled([t.encode() for t in texts])
            best = found.argmax(axis=1)
            whole = [bool(LETTER.search(t)) for t in texts]
            return [network.langs[b] if w else "und" for b, w in zip(best, whole)], [
                float(found[k, b]) if w else 0.0 for k, (b, w) in enumerate(zip(best, whole))
            ]

        for batch in batches:
            langs, scores, part, held = [], [], [], 0
            for text in batch.column(1).to_pylist():
                part.append(text)
                held += len(text)
                if held >= CHUNK:
                    a, b = named(part)
                    langs, scores, part, held = langs + a, scores + b, [], 0
            if part:
                a, b = named(part)
                langs, scores = langs + a, scores + b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, lang_pred string, score double")


def learn_fold(fold: int = 2) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 4, is not ``fold``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != fold
