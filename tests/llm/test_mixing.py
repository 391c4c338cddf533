"""Targets against a plain resharing loop; totals, limits and reruns of the mix."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tuneloom.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key int"


def reshare(sizes, share=Fraction(3, 2)):
    """Give every source its part; cut what is too much and give that to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + \
        ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 0, None: 40, "é": 7, "Z": 300},
    {"x": 9}, {"a": 0, "b": 0}, {}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()],
                               "source string, docs bigint, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx({s: float(t) for s, t in reshare(sizes).items()})


def test_flight_keeps_totals_and_means():
    rng = random.Random(1)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    chances = [rng.random() for _ in sizes]
    moved = mixing.flight(sizes, chances, random.Random(4))
    assert sum(0 < x < 1 for x in moved) <= 2
    assert sum(moved) == pytest.approx(sum(chances))
    assert sum(m * s for m, s in zip(moved, sizes)) == pytest.approx(
        sum(c * s for c, s in zip(chances, sizes)))
    small = [3, 5, 8, 2, 2]
    runs = [mixing.flight(small, [0.5, 0.3, 0.2, 0.9, 0.6], random.Random(i)) for i in range(4000)]
    assert [sum(r[i] for r in runs) / 4000 for i in range(5)] == pytest.approx(
        [0.5, 0.3, 0.2, 0.9, 0.6], abs=0.04)


def docs(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = 4000 if i == 5 else rng.randint(0, 60)
        source = None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}"
        rows.append((i, None if i % 29 == 1 else "w " * words, "en", source, 0, 1, 2))
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("block, fan", [(2048, 512), (8, 2)])
def test_mix(spark, monkeypatch, block, fan):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN", fan)
    df = docs(spark)
    rows = mixing.mix(df).collect()
    source = {r.doc_id: r.source for r in df.collect()}
    words = {r.doc_id: len((r.text or "").split()) for r in df.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(source)
    sizes, taken = {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == words[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == r.copies * r["size"] + r.part and 0 <= r.part <= r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    target = reshare(sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sum(1 for r in rows if r.part) <= len(sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(again, key=lambda r: r.doc_id) == sorted(rows, key=lambda r: r.doc_id)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5, 0, 0)] * 3
                               + [(None, "a b", "en", "s", 3, 0, 0), (None, None, None, None, 0, 0, 0)],
                               DOCS)
    rows = mixing.mix(df).collect()
    assert len(rows) == 5 and sorted(str(r.doc_id) for r in rows) == ["1", "1", "1", "None", "None"]
    # 11 words times 150 %, all for the only source with words
    assert abs(sum(r.taken for r in rows) - 16.5) <= 0.5


def test_mixed_documents(spark):
    df = docs(spark, 120)
    drawn = {r.doc_id: r.copies + (r.part > 0 and r.part * 2 >= r["size"]) for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    whole = {r.doc_id: r for r in df.collect()}
    rows = out.collect()
    assert all(r == whole[r.doc_id] for r in rows)
    assert {i: sum(r.doc_id == i for r in rows) for i in whole} == drawn
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_rows_equal_in_id_and_text_keep_their_columns(spark):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "de", "y"), (1, "a b c", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = mixing.mixed_documents(df.withColumn("a.b", F.lit(1)), share=2.0)  # all of them twice
    assert out.columns[-1] == "a.b"
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(rows * 2)


def test_rows_that_repeat_often_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    df = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"),
                                  F.lit("s").alias("source"))
    rows = mixing.mix(df).collect()
    assert len(rows) == 5000 and abs(sum(r.taken for r in rows) - 22500) <= 1
