"""Base scores by brute force; the model is a distribution and beats the base on unseen text."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tuneloom.llm import lm

DOCS = "doc_id bigint, text string, held int, number string, words int"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)


def corpus(n=300):
    """Words come in fixed pairs, so context tells a lot."""
    rng = random.Random(6)
    pairs = [("red", "apple"), ("blue", "sky"), ("green", "leaf"), ("cold", "ice")]
    return [(i, " ".join(w for _ in range(rng.randint(1, 40)) for w in rng.choice(pairs)))
            for i in range(n)]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def tokens(text):
    return [*(text or "").encode().lower().split(), lm.END.encode()]


def check_base(rows, got):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total = sum(counts.values())
    norm = total + 0.1 * (len(counts) + 1)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total,
                   round(sum(math.log10((counts[x] + 0.1) / norm) for x in tokens(t)), 6))
                  for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


@pytest.mark.parametrize("chunk", [12 << 20, 200])
def test_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    rows = corpus() + [(1000, None), (1001, ""), (1002, "Zebra RED \t\x0b apple"), (None, "red"),
                       (5, "red apple"), (5, "red apple"), (1003, "Ünïcode ÄB äb"),
                       (1004, "cold ice " * 20000)]
    got = lm.score_corpus(make(spark, rows).repartition(3)).collect()
    check_base(rows, got)
    unseen = [r for r in got if r.held_out and (r.doc_id or 0) < 1000]
    assert sum(r.score for r in unseen) > 0.8 * sum(r.base_score for r in unseen)


def test_chunks_do_not_change_scores(spark, monkeypatch):
    df = make(spark, corpus(80))
    one = {r.doc_id: r.score for r in lm.score_corpus(df).collect()}
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    many = {r.doc_id: r.score for r in lm.score_corpus(df).collect()}
    assert one == pytest.approx(many, rel=1e-4)


def test_parts_do_not_change_scores(spark, monkeypatch):
    """Words, counts and tokens taken a few at a time; documents that span several parts."""
    rows = [*corpus(40), (1000, None), (1001, "new " * 30), (1002, "cold ice " * 100)]
    df = make(spark, rows)
    one = {r.doc_id: r for r in lm.score_corpus(df).collect()}
    for name, size in (("_TEXTS", 3), ("_TEXT_BYTES", 500), ("_WORDS", 3), ("_TOKENS", 7),
                       ("_KNOWN", 2), ("_GATHER", 5), ("CHUNK_BYTES", 900)):
        monkeypatch.setattr(lm, name, size)
    got = lm.score_corpus(df).collect()
    check_base(rows, got)
    assert {r.doc_id: r.score for r in got} == pytest.approx(
        {k: r.score for k, r in one.items()}, rel=1e-4)


def test_chunking_takes_bounded_memory():
    """A chunk's texts, words and tokens never stand beside those of the whole batch."""
    rng = np.random.default_rng(7)
    n = 10_000
    words = np.char.mod("%x", (rng.pareto(0.6, (n, 250)) * 9).astype(np.int64) % (1 << 24))
    batch = pa.RecordBatch.from_pydict({
        "number": [*range(n)], "doc_id": [*range(n)], "held": [i % 10 == 0 for i in range(n)],
        "text": [" ".join(w) * 2 for w in words]})
    tracemalloc.start()
    try:
        for chunk in lm._chunks(iter([batch])):
            assert chunk.nbytes < 8 << 20
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_scoring_tasks_grow_with_the_chunks(spark, monkeypatch):
    """No array of all words or counts of a chunk in Spark's rows, and few chunks in a task."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    got = lm.score_corpus(make(spark, corpus(60)).repartition(1), steps=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "array<" not in lm._CHUNK
    assert got.rdd.getNumPartitions() > 10


def test_probabilities_sum_to_one():
    shape = lm.Shape([lm.END, "a", "b", "c"], lm.Sizes.of_tokens(100))
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(shape.n_features, shape.n_classes)).astype(np.float32)
    on = shape.features(np.arange(shape.n_values ** 2))
    assert on.max() < shape.n_features
    assert np.exp(lm.log_softmax(weights, on)).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_what_is_gathered_grows_with_the_corpus():
    sizes = [lm.Sizes.of_tokens(10 ** n) for n in range(3, 14)]
    for less, more in zip(sizes, sizes[1:]):
        assert more.own_contexts > less.own_contexts and more.own_classes > less.own_classes
        assert more.trigrams > less.trigrams and more.hashed_classes >= less.hashed_classes
    assert all(s.hashed_classes & (s.hashed_classes - 1) == 0 for s in sizes)


def test_cells_round_trip_and_add_up():
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, 1 << 40, n), return_counts=True) for n in (1, 50, 400)]
    parts.append(parts[1])
    for keys, counts in parts:
        again = lm._unpacked(lm._packed(keys, counts))
        assert (again[0] == keys).all() and (again[1] == counts).all()
    want = Counter()
    for keys, counts in parts:
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    keys, counts = lm._merge(parts)
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys) > 0).all()


def test_gradients_equal_brute_force(spark, monkeypatch):
    """Statistics, observed and expected counts, and class scores, token by token."""
    monkeypatch.setattr(lm, "_BLOCK", 64)
    monkeypatch.setattr(lm, "_GATHER", 20)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 200)
    rows = corpus(40)
    shape = lm.Shape([lm.END, "red", "apple", "sky"], lm.Sizes(2, 4, 3, 16, 50))
    chunks = make(spark, rows).select(
        lm.F.monotonically_increasing_id().alias("number"), "doc_id",
        lm.held_out(lm.F.col("doc_id"), 10).alias("held"), "text").mapInArrow(lm._chunks, lm._CHUNK)
    stats = lm.stage_table(lm._statistics(chunks, shape), "test-statistics")
    got = Counter()
    for r in stats.collect():
        for k, n in zip(*lm._unpacked(r.cells)):
            assert int(k) not in got
            got[int(k)] = int(n)
    want = Counter()
    for i, text in rows:
        words = [t.decode() for t in tokens(text)]
        classes, values = (x.tolist() for x in shape.of_words(words))
        before = [shape.begin, shape.begin, *values]
        for at, c in enumerate(classes):
            if not held(i):
                want[(before[at] * shape.n_values + before[at + 1]) * shape.n_classes + c] += 1
    assert got == want
    weights = np.random.default_rng(5).normal(size=(shape.n_features, shape.n_classes)).astype("f4")
    observed, expected = np.zeros(weights.shape), np.zeros(weights.shape)
    for key, n in want.items():
        on = shape.features(np.array([key // shape.n_classes]))
        guess = np.exp(lm.log_softmax(weights, on)[0])
        for f in on[0]:
            observed[f, key % shape.n_classes] += n
            expected[f] += n * guess
    for run, whole in ((lm._observed(shape), observed), (lm._expected(shape, weights), expected)):
        assert lm._summed(stats.mapInArrow(run, lm._ROWS), shape) == pytest.approx(whole, rel=1e-3, abs=1e-3)
    monkeypatch.setattr(lm, "_SLICE", 40)
    contexts = np.random.default_rng(6).integers(0, shape.n_values ** 2, 300)
    classes = contexts % shape.n_classes
    logs = lm.log_softmax(weights, shape.features(contexts))[np.arange(300), classes] / np.log(10)
    assert lm._class_logs(shape, weights, classes, contexts) == pytest.approx(logs, abs=1e-4)


def test_nothing(spark):
    assert lm.score_corpus(make(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    row, = lm.score_corpus(make(spark, [(only, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(0)
