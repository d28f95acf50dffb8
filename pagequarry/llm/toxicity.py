"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters with two states, plain and toxic. A token's features are its
lower-cased form and its beginnings; features that are much commoner in toxic documents
than in others are the vocabulary. Training tokens are labelled from the documents:
toxic where a token of a toxic document has such a feature, plain everywhere else. The
field learns feature weights, a bias and transitions by gradient steps on the
log-likelihood, with the forward-backward recursion over windows of tokens. A tagged
document's marginals give its offending offsets (marginal of half or more) and, by a
logistic fit on their maximum and sum, its score.

Tokens without a feature all have the same potentials, so a stretch of them is a power
of one matrix: the recursion steps from featured token to featured token and is still
that of the whole text.

The field is fitted on ``per_class`` labelled documents a class at most, of at most
``longest`` code points each, on their ``vocabulary`` most telling features and
``windows`` windows, drawn by hash, at most; scoring covers every whole text. Texts never
reach the driver. Defined results: a null or empty text, or one without a letter, gets the
score of no evidence; labels that are null, or of no document, are ignored, and of
several labels of a document the largest holds; without toxic labels every score is 0;
repeated rows each give a row; an empty table gives none; extra columns are ignored, or
kept by :func:`reject`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import text_of
from pagequarry.session import stage

TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: A feature's least number of toxic documents, and least log-odds.
SUPPORT, ODDS = 5, 2.0
WINDOW = 48
PER_CLASS, LONGEST = 3000, 50_000
REJECT = 0.7
FEATURED, POWERS = 1 + len(BEGINNINGS), 512
#: Features and windows that the driver gets at most, windows of a gradient step, features counted before a task gives them off.
VOCABULARY, WINDOWS, BLOCK, COUNTED = 50_000, 30_000, 4096, 400_000
WINDOW_ROWS = pa.schema([("draw", pa.int64()), ("at", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("many", pa.int32())])
SCORED = "score double, starts array<int>, ends array<int>"


def features(token: str) -> list[str]:
    low = token.lower()
    return [low, *(f"{low[:n]}-" for n in BEGINNINGS if len(low) >= n)]


@dataclass
class Model:
    """Weights by feature; bias; transition[a, b] from state a to b; the logistic fit's weights."""

    weights: dict[str, float]
    bias: float
    transition: np.ndarray
    fit: tuple[float, float, float]
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        step = np.exp(self.transition) * np.exp([0.0, self.bias])
        powers = [np.eye(2)]
        for _ in range(POWERS):
            powers.append(powers[-1] @ step)
            powers[-1] /= powers[-1].sum()
        #: From one featured token over k plain ones to the next, not counting its own potential.
        self.across = [p @ np.exp(self.transition) for p in powers]
        self.step = step

    def crossing(self, k: int) -> np.ndarray:
        """The step over ``k`` plain tokens to the next one, by repeated squaring where no power is kept."""
        if k < len(self.across):
            return self.across[k]
        out, square = np.eye(2), self.step
        while k:
            if k & 1:
                out = out @ square
                out /= out.sum()
            square = square @ square
            square /= square.sum()
            k >>= 1
        return out @ np.exp(self.transition)

    def emission(self, token: str) -> float:
        """The toxic state's potential from a token's features; nan if it has none."""
        found = [self.weights[f] for f in features(token) if f in self.weights]
        return sum(found) if found else np.nan

    def marginals(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places (among the tokens) of the featured tokens, and how likely each is toxic."""
        tokens = TOKEN.findall(text)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = self.emission(token)
        found = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
        places = np.flatnonzero(~np.isnan(found))
        n = len(places)
        if not n:
            return places, np.zeros(0)
        own = np.exp(np.stack([np.zeros(n), np.clip(found[places] + self.bias, -50, 50)], axis=1))
        moves = [self.crossing(k) for k in (np.diff(places) - 1).tolist()]
        begin = np.array([1.0, np.exp(self.bias)]) @ self.crossing(int(places[0]) - 1) if places[0] else np.ones(2)
        forward, backward = np.empty((n, 2)), np.empty((n, 2))
        state = begin * own[0]
        forward[0] = state / state.sum()
        for k in range(1, n):
            state = forward[k - 1] @ moves[k - 1] * own[k]
            forward[k] = state / state.sum()
        rest = len(tokens) - 1 - int(places[-1])
        state = (self.crossing(rest - 1) * np.exp([0.0, self.bias])).sum(axis=1) if rest else np.ones(2)
        backward[-1] = state / state.sum()
        for k in range(n - 2, -1, -1):
            state = moves[k] @ (own[k + 1] * backward[k + 1])
            backward[k] = state / state.sum()
        both = forward * backward
        return places, both[:, 1] / both.sum(axis=1)

    def score(self, marginals: np.ndarray) -> float:
        a, b, c = self.fit
        x = a + (b * marginals.max() + c * np.log1p(marginals.sum()) if len(marginals) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))

    def tag(self, text: str) -> tuple[float, list[int], list[int]]:
        """A text's score, and the starts and ends of its offending tokens in code points."""
        places, toxic = self.marginals(text)
        offending = set(places[toxic >= 0.5].tolist())
        spans = [m.span() for k, m in enumerate(TOKEN.finditer(text)) if k in offending] if offending else []
        return self.score(toxic), [a for a, _ in spans], [b for _, b in spans]


NOTHING = Model({}, 0.0, np.zeros((2, 2)), (-50.0, 0.0, 0.0))


def _features_of(text: str) -> set[str]:
    return {f for token in set(TOKEN.findall(text)) for f in features(token)}


def _windows(text: str, label: int, index: dict[str, int], known: dict[str, list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Feature ids (token, feature), token labels, and how many tokens there are, of a text's windows.

    A window for each stretch of tokens with a feature in it, and the text's first.
    """
    none = len(index)
    tokens = TOKEN.findall(text)
    if len(known) > 200_000:
        known.clear()
    for token in set(tokens).difference(known):
        known[token] = [index[f] for f in features(token) if f in index]
    starts, last = [0], WINDOW
    for k, token in enumerate(tokens):
        if known[token] and k >= last:
            starts.append(k - WINDOW // 4)
            last = starts[-1] + WINDOW
    for at in starts:
        part = [known[t] for t in tokens[at : at + WINDOW]]
        many = len(part)
        part += [[]] * (WINDOW - many)
        ids = np.array([f + [none] * (FEATURED - len(f)) for f in part], np.uint16)
        yield ids, np.array([bool(f) and bool(label) for f in part]), many


def _gradient(theta: np.ndarray, ids: np.ndarray, marks: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Gradient of the windows' log-likelihood (summed) by feature weights, bias and transitions."""
    n, length, _ = ids.shape
    size = len(theta) - 6
    labels = marks.astype(int)
    pairs = there[:, 1:]
    gold = np.bincount((2 * labels[:, :-1] + labels[:, 1:]).ravel(), pairs.ravel(), 4)
    own = np.zeros((length, n, 2))
    own[:, :, 1] = ((theta[ids].sum(axis=2) + theta[size + 1]) * there).T
    own = np.exp(np.clip(own, -40, 40))
    move = np.exp(theta[-4:].reshape(2, 2))
    forward, backward = np.empty((length, n, 2)), np.ones((length, n, 2))
    scale = np.empty((length, n, 1))
    for t in range(length):
        state = own[t] if not t else np.where(there[:, t, None] > 0, forward[t - 1] @ move, forward[t - 1]) * own[t]
        scale[t] = state.sum(axis=1, keepdims=True)
        forward[t] = state / scale[t]
    for t in range(length - 2, -1, -1):
        state = own[t + 1] * backward[t + 1] / scale[t + 1]
        backward[t] = np.where(there[:, t + 1, None] > 0, state @ move.T, state)
    both = forward * backward
    toxic = (both[:, :, 1] / both.sum(axis=2)).T
    wrong = (marks - toxic) * there
    grad = np.zeros_like(theta)
    grad[: size + 1] = np.bincount(ids.ravel(), np.repeat(wrong.ravel(), FEATURED), size + 1)
    grad[size + 1] = wrong.sum()
    joint = forward[:-1, :, :, None] * move * (own[1:] * backward[1:] / scale[1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    grad[-4:] = gold - (joint * pairs.T[:, :, None, None]).sum(axis=(0, 1)).ravel()
    return grad


def _train(ids: np.ndarray, marks: np.ndarray, there: np.ndarray, size: int, rounds: int = 60, rate: float = 0.3):
    """Gradient ascent (Adam) on the windows' log-likelihood, ``BLOCK`` windows at a time in memory.

    Returns weights, bias, transitions.
    """
    theta = np.zeros(size + 1 + 1 + 4)  # features and none, bias, transitions
    theta[size + 1] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for at in range(1, rounds + 1):
        theta[size] = 0.0
        parts = [slice(k, k + BLOCK) for k in range(0, len(ids), BLOCK)]
        grad = sum(_gradient(theta, ids[p], marks[p].astype(float), there[p].astype(float)) for p in parts)
        grad = grad / len(ids) - 1e-4 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += rate * (first / (1 - 0.9**at)) / (np.sqrt(second / (1 - 0.99**at)) + 1e-8)
    return theta[:size], float(theta[size + 1]), theta[-4:].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float, float]:
    """Newton steps on the ridge-penalised likelihood, the classes weighed alike."""
    x = np.column_stack([np.ones(len(x)), x])
    weigh = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2]) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weigh * (y - p)) - ridge @ w
        curve = (x * (weigh * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3)
        w = w + np.linalg.solve(curve, slope)
    return tuple(map(float, w))


def _field(names: list[str], windows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The field over features ``names`` that windows teach, without the logistic fit."""
    ids, marks = np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows])
    there = np.arange(WINDOW) < np.array([w[2] for w in windows])[:, None]
    weights, bias, transition = _train(ids, marks, there, len(names))
    return Model(dict(zip(names, weights.tolist())), bias, transition, (0.0, 0.0, 0.0))


def _evidence(marginals: np.ndarray) -> tuple[float, float]:
    return (float(marginals.max()), float(np.log1p(marginals.sum()))) if len(marginals) else (0.0, 0.0)


def fit(toxic: list[str], clean: list[str]) -> Model:
    """A field from the whole texts of some toxic and some clean documents; :func:`learn` does it from a table."""
    bad, good = (Counter(f for text in texts for f in _features_of(text)) for texts in (toxic, clean))
    odds = lambda f: np.log((bad[f] + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (good[f] + 0.5))
    names = sorted(f for f, n in bad.items() if n >= SUPPORT and odds(f) >= ODDS)
    if not names:
        return NOTHING
    labelled, index = [(t, 1) for t in toxic] + [(t, 0) for t in clean], {f: k for k, f in enumerate(names)}
    model = _field(names, [w for text, label in labelled for w in _windows(text, label, index, {})])
    found = [_evidence(model.marginals(text)[1]) for text, _ in labelled]
    model.fit = _logistic(np.array(found), np.array([label for _, label in labelled], float))
    model.known.clear()
    return model


def _feature_counts(sample: DataFrame) -> DataFrame:
    """``(feature, bad, good)``: the toxic and the other documents that have each feature."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def give() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)]
            return pa.RecordBatch.from_arrays(columns, ["feature", "bad", "good"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[0 if label else 1].update(_features_of(text))
                if len(counts[0]) + len(counts[1]) > COUNTED:
                    yield give()
                    counts = (Counter(), Counter())
        yield give()

    found = sample.select("text", "label").mapInArrow(each, "feature string, bad long, good long")
    return found.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _window_rows(sample: DataFrame, names: list[str]) -> DataFrame:
    """``(draw, at, ids, marks, many)``, a row per window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = {f: k for k, f in enumerate(names)}, {}
        for batch in batches:
            rows: list[dict] = []
            for draw, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                for at, (ids, marks, many) in enumerate(_windows(text, label, index, known)):
                    rows.append({"draw": draw, "at": at, "ids": ids.tobytes(), "marks": marks.tobytes(), "many": many})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, WINDOW_ROWS)

    return sample.select(F.xxhash64("doc_id").alias("draw"), "text", "label").mapInArrow(each, "draw long, at int, ids binary, marks binary, many int")


def _evidence_rows(sample: DataFrame, model: Model) -> DataFrame:
    """``(label, most, total)``: what the logistic fit sees of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_evidence(model.marginals(t)[1]) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "most", "total"])

    return sample.select("label", "text").mapInArrow(each, "label int, most double, total double")


def learn(
    docs: DataFrame, labels: DataFrame, learns: Column, per_class: int = PER_CLASS, longest: int = LONGEST,
    vocabulary: int = VOCABULARY, windows: int = WINDOWS,
) -> Model:
    """Fits on the labelled rows for which ``learns`` (on doc_id) holds.

    Texts stay in tasks, which count features, cut windows, and find the evidence for the
    logistic fit; the driver gets at most ``vocabulary`` features, ``windows`` windows of
    fixed size and two numbers a document.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    sized = docs.select("doc_id", F.char_length(text_of()).alias("chars")).filter(learns & (F.col("chars") <= longest))
    # the ids alone are drawn first: the table sent out has a fixed size, and only drawn texts are shuffled
    drawn = stage(sized.select("doc_id").distinct().join(marked, "doc_id"), "labelled")
    draw = F.xxhash64("doc_id")
    some = lambda label: drawn.filter(F.col("label") == label).orderBy(draw, "doc_id").limit(per_class)
    ids = stage(some(1).union(some(0)), "drawn")
    many = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    if not many.get(1):
        return NOTHING
    # of rows that share an id one text is learnt from
    texts = docs.select("doc_id", text_of().alias("text")).filter(F.char_length("text") <= longest)
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = stage(sample, "sample")
    odds = F.log((F.col("bad") + 0.5) / (many[1] + 1) * (many.get(0, 0) + 1) / (F.col("good") + 0.5))
    telling = _feature_counts(sample).filter((F.col("bad") >= SUPPORT) & (odds >= ODDS))
    names = sorted(r.feature for r in telling.orderBy(odds.desc(), "feature").limit(vocabulary).collect())
    if not names:
        return NOTHING
    cut = _window_rows(sample, names).orderBy("draw", "at").limit(windows).collect()
    held = [(np.frombuffer(r.ids, np.uint16).reshape(WINDOW, FEATURED), np.frombuffer(r.marks, bool), r.many) for r in cut]
    model = _field(names, held)
    found = sorted(tuple(r) for r in _evidence_rows(sample, model).collect())
    model.fit = _logistic(np.array([r[1:] for r in found]), np.array([r[0] for r in found], float))
    model.known.clear()
    return model


def tagger(model: Model):
    """A column function from text to ``(score, starts, ends)``."""

    @F.pandas_udf(SCORED)
    def tagged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([model.tag(t) for t in part], columns=["score", "starts", "ends"])

    return lambda text: tagged(F.coalesce(text, F.lit("")))


def learn_fold(fold: int = 1) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not ``fold``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != fold


def reject(docs: DataFrame, model: Model, threshold: float = REJECT) -> DataFrame:
    """``docs`` whose score is below ``threshold``."""
    return docs.filter(tagger(model)(F.col("text"))["score"] < threshold)
