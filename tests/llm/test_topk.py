"""Pivot search against a full comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneloom.llm import topk

SHAPE = "vec_id bigint, embedding array<float>, id int, vector string, score int"


def brute(rows, k, step):
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v is not None
             and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in whole if i % step == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def search(spark, rows, k=5, step=3, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SHAPE).repartition(parts)
    got = topk.top_k(df, F.col("vec_id") % step == 0, k)
    return [tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()]


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6)) * 3
    return [(i, (centres[i % 4] + rng.normal(size=6) * 0.2).tolist()) for i in range(90)]


def test_equals_full_comparison(spark, vectors, monkeypatch):
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 4), ("PART_ROWS", 40), ("PIVOTS", 5)):
        monkeypatch.setattr(topk, name, value)
    got = search(spark, vectors)
    assert len(got) == len(set(got)) and set(got) == brute(vectors, 5, 3)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [0.5, 0.25]) for i in range(12)]
    assert set(search(spark, rows, k=4)) == brute(rows, 4, 3)


def test_unusable_rows_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]),
            (4, [None, 1.0]), (None, [9.0, 9.0]), (5, [1.0, 1.0]), (6, [0.0, -1.0])]
    got = set(search(spark, rows))
    assert got == brute(rows, 5, 3) and {r[2] for r in got} == {0, 5, 6}


def test_repeated_rows(spark):
    got = search(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])])
    assert sorted(got) == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128)]


def test_widths_and_large_numbers(spark):
    got = search(spark, [(0, [1e6, 1.0]), (1, [1e6]), (2, [])])
    assert sorted(got) == [(0, 1, 1, 64_000_000 ** 2), (0, 2, 2, 0)]
    with pytest.raises(Exception, match="64 bits"):
        search(spark, [(0, [1e12]), (1, [1e12])])


def test_nothing(spark):
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0])]) == []
    assert search(spark, [(3, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = rng.integers(-40, 40, (60, 8))
    pivots = rows[:7].astype(float)
    block = topk._Block(topk._pack(list(range(60)), rows.tolist(), pivots))
    assert (topk._bounds(block, block) >= rows @ rows.T).all()
