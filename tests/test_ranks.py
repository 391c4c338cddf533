import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tuneloom.operators import ranks as R


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def keys():
    rng = random.Random(1)
    dense = list(range(500))
    sparse = [10 ** 12 + i for i in range(0, 900, 3)] + [-5, 2 ** 62]
    out = dense + sparse
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("partitions, shard_rows", [(1, 8), (3, 100), (8, 1 << 18)])
def test_rank_by_seq(spark, keys, partitions, shard_rows):
    df = spark.createDataFrame([(k,) for k in keys], "seq bigint").repartition(partitions)
    got = {r["seq"]: r["rank"] for r in R.rank_by_seq(df, shard_rows=shard_rows).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("partitions", [1, 8])
def test_rank_by_hash(spark, keys, partitions):
    df = spark.createDataFrame([(k,) for k in keys], "seq bigint").repartition(partitions)
    got = {r["seq"]: r["rank"] for r in R.rank_by_hash(df, "seq", 9).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys, key=lambda k: md5(9, k)))}


@pytest.mark.parametrize("n", [0, 1, 500, 5000])
def test_first_n(spark, keys, n):
    df = spark.createDataFrame([(k,) for k in keys], "seq bigint").repartition(4)
    by_seq = R.first_n_by_seq(df, lambda total: F.lit(n), shard_rows=64).where("in_first")
    assert sorted(r["seq"] for r in by_seq.collect()) == sorted(keys)[:n]
    by_hash = R.first_n_by_hash(df, "seq", 2, lambda total: F.lit(n)).where("in_first")
    assert {r["seq"] for r in by_hash.collect()} == \
        set(sorted(keys, key=lambda k: md5(2, k))[:n])


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("shard_rows", [4, 1 << 18])
def test_prefix_aggregates(spark, inclusive, shard_rows):
    rng = random.Random(3)
    # run 0 holds most rows
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 3), i, rng.randint(-9, 9))
            for i in range(300)]
    df = spark.createDataFrame(rows, "run int, seq bigint, v bigint").repartition(5)
    out = R.prefix_aggregates(df, ["run"], "seq", {
        "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))},
        inclusive, shard_rows)
    got = {(r["run"], r["seq"]): (r["s"], r["lo"], r["hi"]) for r in out.collect()}
    want, seen = {}, {}
    for run, seq, v in rows:
        before = seen.setdefault(run, [])
        if inclusive:
            before.append(v)
        want[run, seq] = (sum(before), min(before), max(before)) if before else (None,) * 3
        if not inclusive:
            before.append(v)
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_seq_of_any_key(spark, partitions):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcxyz") for _ in range(6)) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "k string").repartition(partitions)
    got = {r["k"]: r["seq"] for r in R.dense_seq(df, ["k"]).collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_wide_gaps_are_numbered(spark):
    """Random 64-bit keys must not make a group per row."""
    import random

    from tuneloom.operators import batching, packing, ranks, splits

    rng = random.Random(8)
    keys = sorted({rng.randint(-2 ** 62, 2 ** 62) for _ in range(300)})
    lengths = [rng.choice([1, 3, 3, 7, 10]) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, keys, lengths)),
                               "record_id bigint, seq bigint, length int").repartition(4)
    plain = spark.createDataFrame([(k, i, n) for i, (k, n) in enumerate(zip(keys, lengths))],
                                  "record_id bigint, seq bigint, length int")
    assert not ranks.is_dense(df, "seq") and ranks.is_dense(plain, "seq")
    for layout in (lambda d: batching.bucket_batches(d, 4), lambda d: batching.plain_batches(d, 4),
                   lambda d: packing.block_segments(d, 10), lambda d: splits.head_cap(d, 50)):
        got, want = layout(df).drop("seq"), layout(plain).drop("seq")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    top = ranks.with_shard(ranks.numbered(df, "seq", "at"), "at").select("_block").distinct()
    assert top.count() == 1


def test_null_parts_are_kept(spark):
    from pyspark.sql import functions as F

    from tuneloom.operators.ranks import prefix_aggregates

    df = spark.createDataFrame([(None, i, 1) for i in range(5)] + [("a", i, 2) for i in range(3)],
                               "part string, seq bigint, v int")
    got = prefix_aggregates(df, ["part"], "seq", {"total": ("sum", F.col("v"))}, shard_rows=2)
    assert sorted((str(r.part), r.seq, r.total) for r in got.collect()) == [
        ("None", i, i + 1) for i in range(5)] + [("a", i, 2 * i + 2) for i in range(3)]
