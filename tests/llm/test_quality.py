"""Held-out ranking of the pairwise classifier, and rows without text or label."""

import os

import numpy as np
import pytest

from tuneloom.llm import quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, label int, score double, quality int"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def test_pairs_find_the_direction():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(600, 3))
    labels = (rows @ [2.0, -1.0, 0.0] + rng.normal(size=600) * 0.3 > -1).astype(int)
    model = quality.fit(rows, labels)
    scores = quality._score(model, rows)
    assert model["weights"][0] > 0 > model["weights"][1]
    assert ((scores >= 0.3) == labels).mean() > 0.93
    # the threshold is the quantile of the share of label 0
    assert (scores < 0.3).mean() == pytest.approx((labels == 0).mean(), abs=0.01)


@pytest.mark.parametrize("text", [None, "", "  \n", "word", "a b\nc", "x" * 50000, "# $ % |"])
def test_features_are_finite(text):
    found = quality.features(text)
    assert len(found) == quality.FEATURES and np.isfinite(found).all()


def test_byte_pairs_against_a_count():
    text = "Straße # a|b " * 7
    raw, counts = text.encode(), [0] * quality.GRAMS
    for a, b in zip(raw, raw[1:]):
        counts[(a * 256 + b) * 2654435761 % 2 ** 32 >> 26] += 1
    assert quality.features(text)[-quality.GRAMS:] == pytest.approx(
        [(c / (len(raw) - 1)) ** 0.5 for c in counts])


def test_weights_are_the_best_of_the_pair_loss(monkeypatch):
    """Against the loss of all drawn pairs, one by one; in one chunk or many."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(40, 3))
    labels = (rows[:, 0] + rng.normal(size=40) > 0).astype(int)
    model = quality.fit(rows, labels)
    monkeypatch.setattr(quality, "_CHUNK", 7)
    assert quality.fit(rows, labels)["weights"] == pytest.approx(model["weights"])
    units = np.clip((rows - model["mean"]) / model["scale"], -8, 8)
    draw = np.random.default_rng(11)
    liked = draw.choice(np.flatnonzero(labels == 1), 800)
    other = draw.choice(np.flatnonzero(labels == 0), 800)

    def loss(w):
        return sum(np.log1p(np.exp(-(units[a] - units[b]) @ w)) for a, b in zip(liked, other)) / 800 \
            + quality._RIDGE / 2 * (w @ w)

    best = loss(model["weights"])
    for step in np.vstack([np.eye(3), -np.eye(3)]) * 0.02:
        assert loss(model["weights"] + step) > best


def test_scores_against_plain_strengths(spark):
    """Every row's score and prediction worked out again from the learnt weights."""
    from pyspark.sql import functions as F

    docs, labels, rows = tables(spark)
    model = quality.learn(docs, labels, ~quality.held_out(F.col("_id"), 5))
    for r in quality.score_quality(docs, labels).join(
            docs.selectExpr("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id == 3:
            continue  # two texts under one id
        units = [max(-8.0, min(8.0, (x - m) / s)) for x, m, s in zip(
            quality.features(r.text), model["mean"], model["scale"])]
        strength = sum(u * w for u, w in zip(units, model["weights"]))
        far = model["slope"] * (strength - model["cut"]) + np.log(0.3 / 0.7)
        assert r.score == pytest.approx(1 / (1 + np.exp(-max(-60, min(60, far)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3)


def tables(spark):
    rows, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        text = f"plain words number {i} go on and on here" if good else f"### %% {i} $$ | || ## &&"
        rows.append((i, text, 5, 0.5, 1))
        labels.append((i, int(good), 0, "x"))
    rows += [(500, None, 0, 0.0, 0), (501, "", 0, 0.0, 0), (None, "some text", 0, 0.0, 0),
             (3, "plain words number 3 go on", 0, 0.0, 0)]
    labels += [(None, 1, 0, "x"), (900, None, 0, "x"), (5, 0, 1, "x"), (7, 3, 0, "x"), (1, 1, 0, "y")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), rows


def test_scores(spark):
    docs, labels, rows = tables(spark)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(by[i].predicted == int(i % 4 > 0) for i in range(200))
    assert by[500].score == pytest.approx(by[501].score)


def test_nothing_to_learn_from(spark):
    docs, labels, rows = tables(spark)
    got = quality.score_quality(docs, labels.limit(0)).collect()
    assert len({round(r.score, 9) for r in got}) == 1
    assert len(quality.score_quality(docs, labels.where("quality = 1")).collect()) == len(rows)
    assert quality.score_quality(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
def test_held_out_ranking(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = (quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id")
           .select("score", "predicted", "quality").toPandas())
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (got.predicted == got.quality).mean() > 0.95
