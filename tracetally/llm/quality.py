"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line (symbols, capitals, separators, repeated
words, length, ...), its neighbours and where they repeat it. The field is trained from document
labels: first all lines carry the label of their document, then lines of bad documents that look good
by themselves are relabelled and the field is trained again. A document's good share is the mean of
its lines' forward-backward marginals weighted by their length; a logistic curve fitted to the same
sample turns it into a score.

Training reads a bounded sample: at most ``sample`` documents of each label, those with the smallest
hash of the id, of rows outside the held-out quarter. Of these, the field learns from ``train_parts``
stretches of ``STRETCH`` lines a document, picked by hash over the whole text; the curve is fitted to
whole texts, of which tasks send one good share each. Scoring reads every line of every text.

Defined results: null text counts as empty; an empty text is one empty line; every row gives one row,
repeated ones too; labels without document, null labels and null ids are not learnt from; without
labels of both kinds every score is the smoothed share of label 1. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, per_row, texts

FOLDS, HELD_OUT = 4, 2
STRETCH = 50
THRESHOLD = 0.7

LETTER_UP, LETTER_LOW, DIGIT, MARK, PIPE, BANG, POINT, OTHER = range(8)
_KIND = np.full(256, OTHER, np.uint8)
for _chars, _kind in (
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER_UP), ("abcdefghijklmnopqrstuvwxyz", LETTER_LOW), ("0123456789", DIGIT),
    ("#$%&*@^~_=<>{}[]\\/+", MARK), ("|", PIPE), ("!", BANG), (".,;:?'\"()-", POINT),
):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _kind
OWN = 11  # features of a line by itself
FEATURES = 1 + 2 * OWN + 1


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and length of every line."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer(data, np.uint8)
    line_of = np.repeat(np.arange(len(lines)), size + 1)[:-1]
    kinds = np.bincount(line_of * 8 + _KIND[codes], minlength=8 * len(lines)).reshape(-1, 8) if len(codes) else np.zeros((len(lines), 8))
    own = np.zeros((len(lines), OWN))
    for i, x in enumerate(lines):
        words = x.split()
        n = len(words)
        if n:
            again = sum(map(bytes.__eq__, words, words[1:]))
            own[i, 5] = again / n
            own[i, 6] = 1 - len(set(words)) / n if n >= 8 else 0.0
            own[i, 8] = len(x) / n / 10
            own[i, 9] = n < 3
            own[i, 10] = x.endswith((b".", b"!", b"?", b'"', b":"))
            own[i, :5] = kinds[i, PIPE] / n, kinds[i, MARK] / n, 0, kinds[i, BANG] / n, kinds[i, DIGIT] / len(x)
    letters = kinds[:, LETTER_UP] + kinds[:, LETTER_LOW]
    own[:, 2] = kinds[:, LETTER_UP] / np.maximum(letters, 1)
    own[:, 7] = np.log1p(size) / 8
    own = np.minimum(own, 3.0)
    near = np.zeros_like(own)
    near[1:] += own[:-1] / 2
    near[:-1] += own[1:] / 2
    twin = np.zeros(len(lines))
    for i in range(1, len(lines)):
        if size[i] and lines[i] == lines[i - 1]:
            twin[i] = twin[i - 1] = 1
    return np.column_stack([np.ones(len(lines)), own, near, twin]), np.maximum(size, 1)


def marginals(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(good) of every line; emit: log-odds of good; step: 2 x 2 scores of (before, now), bad first."""
    e = np.exp(np.clip(emit, -30, 30)).tolist()
    (bb, bg), (gb, gg) = np.exp(step).tolist()
    n, fore = len(e), []
    b, g = 0.5, 0.5 * e[0]
    for t in range(n):
        if t:
            b, g = b * bb + g * gb, (b * bg + g * gg) * e[t]
        s = b + g
        b, g = b / s, g / s
        fore.append(g)
    out, b, g = [0.0] * n, 1.0, 1.0
    for t in range(n - 1, -1, -1):
        good, bad = fore[t] * g, (1 - fore[t]) * b
        out[t] = good / (good + bad)
        back = g * e[t]
        b, g = b * bb + back * bg, b * gb + back * gg
        s = b + g
        b, g = b / s, g / s
    return np.array(out)


class Field:
    """Weights of the chain and of the curve that turns a good share into a score."""

    def __init__(self, w: np.ndarray, step: np.ndarray, slope: float, offset: float):
        self.w, self.step, self.slope, self.offset = w, step, slope, offset

    def share(self, x: np.ndarray, size: np.ndarray) -> float:
        return float((marginals(x @ self.w, self.step) * size).sum() / size.sum())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.share(*line_features(text)) + self.offset))))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, text: str) -> float:
        return self.value


def _chains(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(x) for x in xs)
    pad = np.zeros((len(xs), longest, xs[0].shape[1]))
    live = np.zeros((len(xs), longest), bool)
    for i, x in enumerate(xs):
        pad[i, : len(x)], live[i, : len(x)] = x, True
    return pad, live


def _expected(emit: np.ndarray, live: np.ndarray, step: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) per line and expected transitions (chains weighted) of a padded batch, scaled per line."""
    n, longest = emit.shape
    e, m = np.exp(np.clip(emit, -30, 30)), np.exp(step)
    fore, back = np.zeros((longest, n, 2)), np.ones((longest, n, 2))
    a = np.stack([np.full(n, 0.5), 0.5 * e[:, 0]], 1)
    fore[0] = a / a.sum(1, keepdims=True)
    for t in range(1, longest):
        a = fore[t - 1] @ m
        a[:, 1] *= e[:, t]
        a = np.where(live[:, t, None], a, fore[t - 1])
        fore[t] = a / a.sum(1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        b = back[t + 1].copy()
        b[:, 1] *= e[:, t + 1]
        pair = fore[t][:, :, None] * m[None] * b[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        moves += np.einsum("n,nab->ab", np.where(live[:, t + 1], weight, 0.0), pair)
        b = b @ m.T
        back[t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    good = fore * back
    return (good[:, :, 1] / good.sum(2)).T, moves


def _train(x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the log likelihood of the labels, chains weighted."""
    w, step = np.zeros(x.shape[2]), np.zeros((2, 2))
    both = (live[:, 1:] & live[:, :-1]) * weight[:, None]
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j)) * both for j in (0, 1)] for i in (0, 1)]).sum((2, 3))
    count = (live * weight[:, None]).sum()
    first, second = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for k in range(1, rounds + 1):
        p, moves = _expected(x @ w, live, step, weight)
        slope = np.concatenate([np.einsum("nt,ntf->f", np.where(live, y - p, 0.0) * weight[:, None], x), (seen - moves).ravel()]) / count
        slope -= decay * np.concatenate([w, step.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        w, step = w + move[: w.size], step + move[w.size :].reshape(2, 2)
    return w, step


def _curve(s: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic curve by damped Newton steps, with a small penalty that keeps it finite; labels weigh alike."""
    x, b = np.column_stack([s - 0.5, np.ones(len(s))]), np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    keep = np.diag([0.05, 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - keep @ b
        b = b + 0.7 * np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, grad)
    return float(b[0]), float(b[1] - 0.5 * b[0])


def stretches(x: np.ndarray, text: str, most: int) -> list[np.ndarray]:
    """At most so many stretches of a text's lines, picked by hash of text and place over the whole text."""
    starts = range(0, len(x), STRETCH)
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    picked = sorted(starts, key=lambda a: zlib.crc32(f"{seed}:{a}".encode()))[:most]
    return [x[a : a + STRETCH] for a in sorted(picked)]


def fit_lines(parts: list[tuple[np.ndarray, int]]) -> Field:
    """The field, still without its curve, from (features, label) of stretches of documents."""
    parts = sorted(parts, key=lambda d: (len(d[0]), d[0].sum(), d[1]))  # padding stays small; the order of rows has no effect
    x, live = _chains([p for p, _ in parts])
    label = np.repeat(np.array([y for _, y in parts])[:, None], x.shape[1], 1)
    lines = live.sum(1)  # both labels weigh alike, however many lines carry them
    weight = np.where(label[:, 0] == 1, 1 / max(1, lines[label[:, 0] == 1].sum()), 1 / max(1, lines[label[:, 0] == 0].sum())) * lines.sum() / 2
    w, step = _train(x, live, label, weight)
    alone = x @ w > 0  # bad documents hold good lines, not the other way round
    w, step = _train(x, live, np.where(live & alone, 1, label), weight)
    return Field(w, step, 1.0, 0.0)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, train_parts: int = 4, id_col: str = "doc_id", text_col: str = "text") -> Field | Constant:
    """Train on rows outside the held-out quarter."""
    docs = texts(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1)").filter(remainder(F.col("k")) != HELD_OUT)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return Constant((shares.get(1, 0) + 1) / (sum(shares.values()) + 2))
    picked = [known.filter(F.col("label") == v).orderBy(F.xxhash64("k"), "k").limit(sample) for v in (0, 1)]  # at most 2 * sample rows of numbers
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.join(picked, F.col("doc_id") == F.col("k")).select("label", "text")

    def make():
        def one(label, text):
            x, _ = line_features(text)
            return [(label, len(part), part.ravel().tolist()) for part in stretches(x, text, train_parts)]

        return one

    sampled = per_row(rows, make, "label int, n int, x array<double>").collect()
    parts = [(np.array(r["x"]).reshape(r["n"], -1), r["label"]) for r in sampled]
    if len({y for _, y in parts}) < 2:
        return Constant((shares[1] + 1) / (sum(shares.values()) + 2))
    field = fit_lines(parts)
    found = per_row(rows, lambda: lambda label, text: [(label, field.share(*line_features(text)))], "label int, share double").collect()
    found = sorted((r["share"], r["label"]) for r in found)
    field.slope, field.offset = _curve(np.array([s for s, _ in found]), np.array([y for _, y in found]))
    return field


def score(docs: DataFrame, field: Field | Constant, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    docs = texts(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = per_row(docs, lambda: lambda doc_id, text: [(doc_id, field.score(text))], f"doc_id {kind}, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field | Constant, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text scores at least ``threshold``; each row is judged by its own text."""
    return keep_rows(docs, text_col, lambda text: field.score(text) >= threshold)
