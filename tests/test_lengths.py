import random

import pytest

from tuneloom.functions.tokens import WordTokenizer
from tuneloom.operators import lengths as L

TOK = WordTokenizer()
COLUMNS = ("record_id bigint, seq bigint, kind string, prompt string, completion string, "
           "text string")


def pair(i, p, c):
    """A pair with ``p`` prompt tokens (template included, 4 words) and ``c`` answer tokens."""
    return (i, i, "pair", " ".join(["w"] * (p - 4)), " ".join(["w"] * c), None)


def text(i, n):
    return (i, i, "text", None, None, " ".join(["w"] * n))


@pytest.mark.parametrize("row, want, eos", [
    (pair(1, 15, 1), None, False),           # max_len - 5
    (pair(1, 16, 1), "prompt_too_long", False),   # max_len - 4
    (pair(1, 10, 10), None, True),           # total = max_len, loses its end marker
    (pair(1, 10, 9), None, False),
    (pair(1, 10, 11), "over_length", False),
    (pair(1, 16, 30), "prompt_too_long", False),  # tested first
    (text(1, 1), "too_short", False), (text(1, 2), None, False), (text(1, 99), None, False),
])
def test_boundaries(spark, row, want, eos):
    r = L.filter_for_training(spark.createDataFrame([row], COLUMNS), TOK, 20).first()
    assert (r["drop_reason"], r["eos_truncated"]) == (want, eos)


def test_stats_and_observation(spark, tmp_path):
    df = spark.createDataFrame([pair(1, 10, 4), pair(2, 18, 1), pair(3, 10, 30), text(4, 1),
                                text(5, 3), pair(6, 10, 10)], COLUMNS)
    flagged = L.filter_for_training(df, TOK, 20)
    want = {"kept": 3, "dropped_prompt_too_long": 1, "dropped_over_length": 2, "total": 6,
            "eos_truncated": 1}
    assert L.filter_stats(flagged).first().asDict() == want
    observed, observation = L.observe_filter(flagged)
    L.kept(observed).write.parquet(str(tmp_path / "kept"))
    assert observation.get == want
    assert L.kept(L.filter_for_training(df, TOK, 20, enabled=False)).count() == 6


def test_counts_are_not_repeated_by_a_pushed_filter(spark):
    df = spark.createDataFrame([pair(1, 10, 4)], COLUMNS)
    kept = L.kept(L.filter_for_training(df, TOK, 20)).select("record_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_count_tokens(spark):
    df = spark.createDataFrame([pair(1, 10, 4), text(2, 7)], COLUMNS)
    assert L.count_tokens(df, TOK).first()[0] == 21
    assert L.count_tokens(df, WordTokenizer(bos_id=1)).first()[0] == 23
    assert L.count_tokens(df.where("false"), TOK).first()[0] == 0


def lengths(spark, values):
    return spark.createDataFrame([(i, i, n) for i, n in enumerate(values)],
                                 "record_id bigint, seq bigint, length int")


def test_packing_stats(spark):
    r = L.packing_stats(lengths(spark, [3, 5, 10, 8]), 10).first()
    assert (r["examples"], r["real_tokens"], r["naive_padded_tokens"], r["packed_tokens"]) == \
        (4, 26, 40, 30)
    assert r["waste_naive_pct"] == pytest.approx(35) and r["speedup_vs_naive"] == 4 / 3
    e = L.packing_stats(lengths(spark, []), 10).first()
    assert (e["waste_naive_pct"], e["waste_packed_pct"], e["speedup_vs_naive"]) == (0, 0, 1)


@pytest.mark.parametrize("values, max_len, size, want", [
    # sorted 2 4 9 | 9: three rows padded to 9 and a tail of one
    ([9, 2, 9, 4], 16, 3, {"examples": 4, "real_tokens": 24, "p50_len": 9, "p90_len": 9,
                           "max_len_seen": 9, "naive_tokens": 36, "bucket_tokens": 36,
                           "pack_tokens": 32, "strategy": "bucket"}),
    # equal rows need no padding, and blocks of 100 hold ten of them
    ([10] * 20, 100, 4, {"examples": 20, "real_tokens": 200, "p50_len": 10, "p90_len": 10,
                         "max_len_seen": 10, "naive_tokens": 200, "bucket_tokens": 200,
                         "pack_tokens": 200, "strategy": "bucket"}),
    # one long row in the only bucket: 8*30 padded tokens against one block of 100
    ([1] * 7 + [30], 100, 8, {"examples": 8, "real_tokens": 37, "p50_len": 1, "p90_len": 30,
                              "max_len_seen": 30, "naive_tokens": 240, "bucket_tokens": 240,
                              "pack_tokens": 100, "strategy": "pack"}),
    # packing would win, but the rows are not short against a block
    ([1] * 5 + [50] * 3, 100, 8, {"examples": 8, "real_tokens": 155, "p50_len": 1, "p90_len": 50,
                                  "naive_tokens": 400, "bucket_tokens": 400, "pack_tokens": 200,
                                  "strategy": "bucket"}),
    ([7], 16, 4, {"examples": 1, "real_tokens": 7, "p50_len": 7, "p90_len": 7, "naive_tokens": 7,
                  "bucket_tokens": 7, "pack_tokens": 16, "strategy": "bucket"}),
])
def test_analysis_by_hand(spark, values, max_len, size, want):
    for rows in (values, values[::-1]):
        got = L.analyze_lengths(lengths(spark, rows), max_len, size).first().asDict()
        assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("seed", range(4))
def test_analysis_invariants(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1, 2, 9, 15, rng.randint(1, 64)]) for _ in range(rng.choice([10, 101, 500]))]
    got = [L.analyze_lengths(lengths(spark, values), 64, size).first() for size in (1, 4, 1000)]
    assert all(r["real_tokens"] == sum(values) for r in got)
    # a bucket of one pads nothing, one bucket of all pads to the longest row
    assert got[0]["bucket_tokens"] == sum(values)
    assert got[2]["bucket_tokens"] == got[2]["naive_tokens"] == max(values) * len(values)
    assert sum(values) <= got[1]["bucket_tokens"] <= got[1]["naive_tokens"]
    assert 0 <= got[1]["pack_tokens"] - sum(values) < 64
    assert got[1]["p50_len"] <= got[1]["p90_len"] <= got[1]["max_len_seen"] == max(values)


def test_analysis_of_nothing(spark):
    r = L.analyze_lengths(lengths(spark, []), 10).first()
    assert (r["strategy"], r["reason"], r["examples"]) == ("bucket", "empty dataset", 0)
