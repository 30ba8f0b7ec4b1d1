"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

A linear score over dense text features, with squared loss. Both risks are then quadratic in the weights, so one pass
over all documents gathers everything that training needs: second moments over all texts (the unlabelled set) and over
the trusted positives. The driver gets these few thousand sums, whatever the corpus, and minimises the clamped risk on
them exactly (du Plessis et al., 2015; Kiryo et al., 2017).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# fixed values: where each share's ramp ends; a feature for each
RAMPS = (0.02, 0.1, 0.3, 1.0)
_SIGNS = b"#$%&*|!@^~<>{}[]=+\\/_"
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _CLASS[_i] = 1 if 65 <= _i <= 90 else 2 if 97 <= _i <= 122 else 3 if 48 <= _i <= 57 else 4 if _i in _SIGNS else 5 if _i in b".,;:?'\"()-" else 6 if _i >= 128 else 0
SHARES = 12
WIDTH = SHARES * len(RAMPS) + 7


def describe(text: str | None) -> np.ndarray:
    """The features of one text, each from 0 to 1; null as empty. They see every byte and word, and no id or label."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7, np.int64)
    w = (text or "").split()
    n, letters = max(len(w), 1), max(int(kinds[1] + kinds[2] + kinds[6]), 1)
    seen = Counter(w)
    lines = [x for x in (text or "").split("\n") if x]
    size = max(len(raw), 1)
    pairs = len(set(zip(w, w[1:])))
    x = [
        kinds[1] / letters,
        kinds[3] / size,
        kinds[4] / size,
        kinds[5] / size,
        kinds[6] / size,
        sum(map(eq, w, w[1:])) / n,
        1 - len(seen) / n,
        1 - pairs / max(len(w) - 1, 1),
        max(seen.values(), default=0) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(v for k, v in seen.items() if k[-1:] in "!#$%&*|") / n,
        sum(v for k, v in seen.items() if len(k) > 1 and k.isupper()) / n,
    ]
    ramps = [min(v / r, 1.0) for v in x for r in RAMPS]
    mean = sum(len(k) * v for k, v in seen.items()) / n
    return np.array([*ramps, 1.0, float(not w), min(len(w) / 5, 1), min(len(w) / 50, 1), min(len(w) / 1000, 1), min(mean / 20, 1), min(mean / 6, 1)], np.float32)


@dataclass(frozen=True)
class Model:
    """Weights on the features, the class prior they were fitted with, and slope and offset of the logistic link."""

    weights: tuple[float, ...]
    prior: float
    slope: float
    offset: float


def text_features(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: every row's whole text as features, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([describe(t.as_py()) for t in b.column("text")]) if len(b) else np.zeros((0, WIDTH), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * WIDTH, pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>"), "features")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and second moments over all rows (``u``) and trusted positives (``p``): summed in tasks, then by cell."""

    def run(batches):
        sums = {"u": np.zeros((WIDTH, WIDTH)), "p": np.zeros((WIDTH, WIDTH))}
        many = {"u": 0, "p": 0}
        for b in batches:
            x = b.column("x").combine_chunks() if isinstance(b.column("x"), pa.ChunkedArray) else b.column("x")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)
            good = b.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for k, part in (("u", x), ("p", x[good])):
                sums[k] += part.T @ part
                many[k] += len(part)
        for k in sums:
            values = np.append(sums[k].ravel(), many[k])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(values)), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["k", "i", "v"])

    got = rows.select("x", "good").mapInArrow(run, "k string, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in ("u", "p"):
        flat = np.zeros(WIDTH * WIDTH + 1)
        for r in got:
            if r.k == k:
                flat[r.i] = r.v
        n = max(flat[-1], 1.0)
        second = flat[:-1].reshape(WIDTH, WIDTH) / n
        out[k] = (flat[-1], second[:, SHARES * len(RAMPS)], second)  # the constant's row holds the means
    return out


def minimise(prior: float, u: tuple, p: tuple, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of least non-negative risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) + ridge * |w|^2.

    Starts at the unclamped risk's minimum. While the part for negatives is below zero, steps follow its rise alone.
    """
    _, m_u, g_u = u
    _, m_p, g_p = p
    eye = np.eye(len(m_u))
    w = np.linalg.solve(g_u + ridge * eye, 2 * prior * m_p - m_u)
    rate = 0.5 / np.linalg.norm(g_u + ridge * eye, 2)
    best, least = w, np.inf
    for _ in range(steps):
        minus = (1 + 2 * m_u @ w + w @ g_u @ w) - prior * (1 + 2 * m_p @ w + w @ g_p @ w)
        risk = prior * (1 - 2 * m_p @ w + w @ g_p @ w) + max(0.0, minus) + ridge * w @ w
        if risk < least - 1e-12:
            best, least = w.copy(), risk
        down = 2 * (m_u + g_u @ w) - 2 * prior * (m_p + g_p @ w)
        full = down + 2 * prior * (g_p @ w - m_p) + 2 * ridge * w
        w = w - rate * (full if minus >= 0 else -down)
    return best


def _margin(weights) -> Column:
    return F.expr(f"aggregate(zip_with(x, array({', '.join(f'{float(v)!r}D' for v in weights)}), (a, b) -> a * b), 0D, (s, v) -> s + v)")


def _logistic(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and offset by Newton steps on (margin, label, weight) sums; the labels are smoothed a little."""
    g, y, n = (np.array(c, float) for c in zip(*points, strict=True))
    pos, neg = (n * (y == 1)).sum(), (n * (y == 0)).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * g + b, -30, 30)))
        v = n * np.maximum(q * (1 - q), 1e-9)
        grad = np.array([(n * (q - t) * g).sum() + 1e-3 * a, (n * (q - t)).sum()])
        hess = np.array([[(v * g * g).sum() + 1e-3, (v * g).sum()], [(v * g).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``features(doc_id, x)`` and ``labels(doc_id, quality)`` of rows that are not held out.

    All documents are the unlabelled set; documents labelled 1 are the trusted positives. The class prior is the share
    of 1 among labelled rows, or, where every label is 1, the share that the labelled-or-not score implies (Elkan and
    Noto, 2008). Labelled rows, summed by margin in 400 bins, also set the logistic link. Null labels are none; of
    contradicting labels the mean decides, a tie for 1. With no labels at all every score is a half.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_id")).agg((F.avg("quality") >= 0.5).alias("is_good"))
    rows = features.join(own, features["doc_id"] == own["label_id"], "left").select("x", "is_good")
    sums = _moments(rows.select("x", F.coalesce("is_good", F.lit(False)).alias("good")))
    n_u, n_p = sums["u"][0], sums["p"][0]
    if not n_p:
        return Model((0.0,) * WIDTH, 0.5, 1.0, 0.0)
    negatives = rows.where(~F.col("is_good")).count()
    if negatives:
        prior = n_p / (n_p + negatives)
    else:
        share = min(n_p / max(n_u, 1), 1.0)
        s = np.linalg.solve(sums["u"][2] + 1e-3 * np.eye(WIDTH), share * sums["p"][1])
        prior = float(np.clip(share / max(s @ sums["p"][1], 1e-9), share, 1.0))
    w = minimise(prior, sums["u"], sums["p"])
    if not negatives:
        return Model(tuple(w), prior, 2.0, 0.0)
    bins = rows.where("is_good is not null").select(F.round(F.greatest(F.least(_margin(w), F.lit(4.0)), F.lit(-4.0)) * 50).alias("g"), F.col("is_good").cast("int").alias("y"))
    points = [(r.g / 50, r.y, r.n) for r in bins.groupBy("g", "y").agg(F.count("*").alias("n")).collect()]
    return Model(tuple(w), prior, *_logistic(points))


def score(features: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null doc_id is not held out."""
    s = 1 / (1 + F.exp(-(_margin(model.weights) * model.slope + model.offset)))
    return features.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), s.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on the labels and score every document, repeated rows each for itself; see ``fit`` and ``score``."""
    features = text_features(docs)
    return score(features, fit(features, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, columns unchanged; null doc_ids are kept."""
    bad = classify(docs, labels, threshold).where("predicted = 0").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
