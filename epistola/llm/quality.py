"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are word unigrams and bigrams, and 1- to 5-grams of word shapes in which a word
that repeats the one before it has a sign of its own. Each indicator is scaled by the
log-count ratio of the two classes, each of the two groups of indicators to unit length, and
a linear model of squared hinge loss is fitted by dual coordinate descent; a logistic curve fitted on
rows left out of that fit turns margins into scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import map_rows, text_of, tune

#: Labelled rows that a fit reads at most: those with the smallest hashes of their keys.
SAMPLE_ROWS = 6_000
#: Hashed indicators of each group.
BITS = 17
ORDERS = 5
CACHE_WORDS = 100_000
HELD_OUT_EVERY = 5
THRESHOLD = 0.3

_U = np.uint64
_RUNS = [(re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


def shape(word: str) -> str:
    """Runs of letters as X, Xx or x, of digits as 9, of one sign as two of it."""

    def letters(m: re.Match) -> str:
        w = m[0]
        return ("X" if len(w) > 1 else "Xx") if w.isupper() else "Xx" if w[0].isupper() else "x"

    out = _RUNS[0][0].sub(letters, word)
    for pattern, to in _RUNS[1:]:
        out = pattern.sub(to, out)
    return out


class _Codes(dict):
    """word -> (hash of the word, hash of its shape)"""

    def __missing__(self, word: str) -> tuple[int, int]:
        self[word] = pair = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass")))
        return pair


_codes = _Codes()
_P1, _P2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _fold(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(29))) * _P2
        return ((h ^ (h >> _U(32))) * _P1) >> _U(64 - bits)


def indicators(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams and shape n-grams of a whole text."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(_codes) > CACHE_WORDS:
        _codes.clear()
    codes = np.array([_codes[w] for w in words], _U)
    word, sign = codes[:, 0], codes[:, 1].copy()
    sign[1:][word[1:] == word[:-1]] = _U(7)
    with np.errstate(over="ignore"):
        grams = [_fold(word * _P1 + _U(1), bits)]
        if len(words) > 1:
            grams.append(_fold((word[:-1] * _P1 + word[1:]) * _P2 + _U(2), bits))
        shapes, h = [], np.zeros(len(words), _U)
        for n in range(1, min(ORDERS, len(words)) + 1):
            h = h[: len(words) - n + 1] * _P1 + sign[n - 1 :] + _U(n)
            shapes.append(_fold(h, bits))
    return np.unique(np.concatenate(grams)).astype(np.int64), np.unique(np.concatenate(shapes)).astype(np.int64)


def _both(text: str) -> np.ndarray:
    a, b = indicators(text)
    return np.concatenate([a, b + (1 << BITS)])


def scaled(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Values of the indicators x: log-count ratios, each group of unit length."""
    v = ratio[x]
    split = np.searchsorted(x, 1 << BITS)
    for part in (v[:split], v[split:]):
        norm = np.sqrt((part * part).sum())
        if norm > 0:
            part /= norm
    return v


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the squared hinge-loss linear model, solved in the dual one row at a time."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    diagonal = 1 / (2 * cost)
    norm = np.array([v @ v + 1.0 for _, v in rows]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i]
            gradient = y[i] * (w[x] @ v + w[-1]) - 1 + diagonal[i] * alpha[i]
            step = max(alpha[i] - gradient / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[x] += step * y[i] * v
                w[-1] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of P(1) = 1 / (1 + exp(-(a m + b))), with smoothed targets, by damped Newton steps."""
    positive, negative = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, s = p - target, p * (1 - p) + 1e-9
        ha, hab, hb = (s * margin * margin).sum() + 1e-6, (s * margin).sum(), s.sum() + 1e-6
        ga, gb = (g * margin).sum(), g.sum()
        det = ha * hb - hab * hab
        da, db = (hb * ga - hab * gb) / det, (ha * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 0.0), b


def fit(x: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, float, float]:
    """From each row's indicators: weights per indicator (ratios folded in, the bias last) and the logistic curve.

    With one class only the score is that class everywhere; without rows it is 0.5.
    """
    size = 2 << BITS
    y = np.where(np.array(labels, np.int64) > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        return np.zeros(2 * size + 1), 0.0, 0.0 if len(y) == 0 else 4.0 * float(y[0])
    counts = {1.0: np.ones(size), -1.0: np.ones(size)}
    for features, label in zip(x, y, strict=True):
        counts[label][features] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    rows = [(f, scaled(f, ratio)) for f in x]
    part = np.arange(len(rows)) % 5 == 4
    for side in (1.0, -1.0):  # each class is in either part
        if not (part & (y == side)).any() or not (~part & (y == side)).any():
            part[:] = False
    inside = np.flatnonzero(~part)
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = dual_coordinate_descent([rows[i] for i in inside], y[inside], size, weight[inside])
    test = np.flatnonzero(part) if part.any() else inside
    margins = np.array([w[rows[i][0]] @ rows[i][1] + w[-1] for i in test])
    a, b = logistic(margins, y[test])
    return np.concatenate([ratio, w]), a, b


def _score(text: str, ratio: np.ndarray, w: np.ndarray, a: float, b: float) -> float:
    x = _both(text)
    margin = (w[x] @ scaled(x, ratio) if len(x) else 0.0) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_EVERY == 0


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int) -> tuple[np.ndarray, float, float]:
    """Fit on at most sample_rows labelled rows outside the held-out fold; one task fits, the weights come back.

    Rows without key or label are no training rows; a key labelled twice counts once with its larger label, a key of several documents with its smallest text.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    chosen = usable.groupBy(F.col(key).alias("__key")).agg((F.max(label) > 0).cast("int").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)
    # at most sample_rows keys; of a repeated key the smallest text counts, so that one key is one row
    rows = docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")).join(F.broadcast(chosen), "__key")
    rows = rows.groupBy("__key", "__label").agg(F.min("__text").alias("__text"))

    def extract():
        return lambda texts: [[_both(t).astype("<i4").tobytes() for t in texts]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["__key"], r["__x"], r["__label"]) for b in batches for r in b.to_pylist())
        w, a, b = fit([np.frombuffer(x, "<i4").astype(np.int64) for _, x, _ in rows], [y for _, _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([a]), pa.array([b])], names=["w", "a", "b"])

    tune(docs.sparkSession)
    rows = map_rows(rows, ["__text"], [("__x", T.BinaryType())], extract, ["__key", "__label"])
    w, a, b = rows.repartition(1).mapInArrow(run, "w binary, a double, b double").head()
    return np.frombuffer(w, "<f4"), a, b


def classify(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append held_out, score (0 to 1) and predicted to docs; the text alone decides the score.

    Null and empty texts get the score of the bias; an empty table gives an empty table;
    columns with the names of new ones are replaced.
    """
    w, a, b = train(docs, labels, key, text, label, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((w.copy(), a, b))

    def make():
        w, a, b = shared.value
        ratio, weights = w[: 2 << BITS].astype(float), w[2 << BITS :].astype(float)

        def work(texts):
            return [[_score(t or "", ratio, weights, a, b) for t in texts]]

        return work

    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    scored = map_rows(docs, [text], [("score", T.DoubleType())], make, keep)
    return scored.withColumns({"held_out": held_out(key), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})
