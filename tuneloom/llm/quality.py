"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text: rates of words, signs, repeats
and lines, and hashed shares of its byte pairs. It is learned from preference
pairs, a document of label 1 over one of label 0, by logistic loss on the difference of their
features. A threshold on the strengths, the quantile that the share of label 0 names, becomes
the score 0.3; scores are logistic around it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.common import held_out

#: Labelled rows that are fitted at most (about; drawn by a hash threshold on counted rows), and
#: the preference pairs among them.
SAMPLE = 20_000
PAIRS = 200_000
THRESHOLD = 0.3
_STEPS = 40
_RIDGE = 1e-3
_MARKS = np.zeros(256, np.int8)
_MARKS[[ord(c) for c in "#$%&*|<>{}[]@~^=+\\/_"]] = 1
_ENDS = np.zeros(256, np.int8)
_ENDS[[ord(c) for c in "!?.,;:"]] = 1
#: Pairs of neighbouring bytes are hashed into so many shares, whose weights are learnt.
GRAMS = 64
FEATURES = 21 + GRAMS
#: Preference pairs whose feature differences are held at once while fitting.
_CHUNK = 20_000


def _grams(chars: np.ndarray) -> np.ndarray:
    pairs = chars[:-1].astype(np.uint32) * np.uint32(256) + chars[1:]
    places = pairs * np.uint32(2654435761) >> np.uint32(32 - (GRAMS - 1).bit_length())
    return np.sqrt(np.bincount(places, minlength=GRAMS) / max(1, len(places)))


def features(text: str | None) -> list[float]:
    """Shares and rates of a whole text; a null or empty one has a vector of its own."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [1.0] + [0.0] * (FEATURES - 1)
    n, chars = len(words), np.frombuffer(raw, np.uint8)
    size = len(chars)
    hist = np.bincount(chars, minlength=256)
    counts = Counter(words)
    often = counts.most_common(3)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    marks, upper = int(hist[_MARKS > 0].sum()), int(hist[65:91].sum())
    lower, digits = int(hist[97:123].sum()), int(hist[48:58].sum())
    plain = max(1, upper + lower)
    return [
        0.0, math.log1p(n), marks / n, math.sqrt(marks / n), upper / plain,
        digits / size, int(hist[33]) / n, int(hist[_ENDS > 0].sum()) / n,
        len(counts) / n, (1 - len(counts) / n) * math.log1p(n), repeats / n,
        math.sqrt(repeats / n), 1 - pairs / max(1, n - 1), often[0][1] / n,
        sum(c for _, c in often) / n, float(lengths.mean()), float(lengths.std()),
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / n,
        int((hist[128:]).sum()) / size, float((lengths == 1).mean()),
        *_grams(chars).tolist()]


def fit(rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> dict:
    """Weights by Newton steps on the logistic loss of feature differences, and the threshold."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale == 0] = 1.0
    units = np.clip((rows - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    weights = np.zeros(rows.shape[1])
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        count = min(PAIRS, 20 * len(rows))
        liked, other = rng.choice(good, count), rng.choice(bad, count)
        for _ in range(_STEPS):
            grad = -_RIDGE * weights
            hess = _RIDGE * np.eye(len(weights))
            for at in range(0, count, _CHUNK):
                diff = units[liked[at:at + _CHUNK]] - units[other[at:at + _CHUNK]]
                p = 1 / (1 + np.exp(-np.clip(diff @ weights, -30, 30)))
                grad += diff.T @ (1 - p) / count
                hess += (diff * (p * (1 - p))[:, None]).T @ diff / count
            step = np.linalg.solve(hess, grad)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
    strength = units @ weights
    cut = float(np.quantile(strength, (labels == 0).mean())) if len(labels) else 0.0
    slope = 4.0 / float(strength.std()) if strength.std() > 0 else 1.0
    return {"mean": mean, "scale": scale, "weights": weights, "cut": cut, "slope": slope}


def _score(model: dict, rows: np.ndarray) -> np.ndarray:
    units = np.clip((rows - model["mean"]) / model["scale"], -8, 8)
    far = model["slope"] * (units @ model["weights"] - model["cut"])
    return 1 / (1 + np.exp(-np.clip(far + math.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


def learn(docs: DataFrame, labels: DataFrame, learnt: Column) -> dict:
    """Fit on a bounded sample of the rows that ``learnt`` marks; labels other than 0 and 1,
    null ones and ids with two different labels are left out."""
    marks = (labels.select(F.col("doc_id").alias("_id"), "quality").where("quality IN (0, 1)")
             .groupBy("_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
             .where("low = high").select("_id", F.col("low").alias("label")))
    marks = marks.where(learnt)
    total = marks.count()
    share = min(1.0, SAMPLE / max(1, total))
    marks = marks.where(F.abs(F.xxhash64("_id") % F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    got = (rows.select("doc_id", "label", "text")
           .mapInArrow(extract, "doc_id bigint, label int, features array<double>")
           .toArrow().sort_by([("doc_id", "ascending")]))
    if not got.num_rows:
        return fit(np.zeros((1, FEATURES)), np.ones(1))
    return fit(np.array(got.column("features").to_pylist()), got.column("label").to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; predicted 1 from 0.3 on.

    Labels are learned from rows outside the held-out fold only. Null texts and texts without
    words share one score. Without labels of both kinds every text scores the same. Repeated
    documents stay rows; documents without a label are scored like all others.
    """
    model = learn(docs, labels, ~held_out(F.col("_id"), folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)
            scores = _score(model, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text")
            .mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"))
