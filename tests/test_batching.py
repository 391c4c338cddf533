import pytest
from pyspark.sql import functions as F

from tuneloom.operators import batching as B


def table(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("partitions, size, shard_rows", [
    (1, 4, 16), (8, 4, 64), (3, 1, 1 << 18), (3, 7, 16), (2, 1000, 16)])
def test_bucket_batches(spark, lengths_table, partitions, size, shard_rows):
    rows, df = lengths_table
    got = B.bucket_batches(df.repartition(partitions), size, shard_rows=shard_rows)
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    want = []
    for i, (rid, _, n) in enumerate(ordered):
        chunk = ordered[i // size * size:(i // size + 1) * size]
        want.append((rid, i // size, i % size, n, max(c[2] for c in chunk)))
    assert table(got, "record_id", "batch_id", "pos_in_batch", "length", "width") == sorted(want)


def test_short_last_batch_survives_the_shuffle(spark):
    df = spark.createDataFrame([(i, i, 5 + i) for i in range(10)],
                               "record_id bigint, seq bigint, length int")
    rows = B.bucket_batches(df, 4, shuffle=True, seed=11).collect()
    members = {}
    for r in rows:
        members.setdefault(r["batch_order"], []).append(r["record_id"])
    assert sorted(members) == [0, 1, 2]
    assert sorted(map(sorted, members.values())) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_batch_order_differs_by_seed_and_repeats(spark, lengths_table):
    _, df = lengths_table
    base = B.bucket_batches(df, 4)

    def order(seed, partitions):
        shuffled = B.shuffle_batches(base.repartition(partitions), seed)
        return [r[0] for r in shuffled.where("pos_in_batch = 0").orderBy("batch_order")
                .select("batch_id").collect()]

    assert order(1, 2) == order(1, 7) != order(2, 2)
    assert sorted(order(1, 2)) == list(range(101))


@pytest.mark.parametrize("shuffle", [False, True])
def test_plain_batches_cover_everything_once(spark, lengths_table, shuffle):
    rows, df = lengths_table
    got = B.plain_batches(df.repartition(3), 8, shuffle, seed=1, shard_rows=32).collect()
    slots = sorted((r["batch_id"], r["pos_in_batch"]) for r in got)
    assert slots == [(i // 8, i % 8) for i in range(len(rows))]
    if not shuffle:
        assert [r["record_id"] for r in sorted(got, key=lambda r: (r["batch_id"], r["pos_in_batch"]))] \
            == [r[0] for r in rows]


def arrays(spark, *lens):
    return spark.createDataFrame(
        [(i, i, list(range(1, n + 1)), [-100] + list(range(2, n + 1)), n)
         for i, n in enumerate(lens)],
        "record_id bigint, seq bigint, input_ids array<int>, labels array<int>, length int")


def test_padding(spark):
    right = B.pad_right(B.plain_batches(arrays(spark, 3, 1, 2), 2), 0).orderBy("seq").collect()
    assert [r["input_ids"] for r in right] == [[1, 2, 3], [1, 0, 0], [1, 2]]
    assert [r["labels"] for r in right] == [[-100, 2, 3], [-100] * 3, [-100, 2]]
    assert [r["attention_mask"] for r in right] == [[1, 1, 1], [1, 0, 0], [1, 1]]
    left = B.pad_left(B.plain_batches(arrays(spark, 3, 1, 9), 3), 0, 4).orderBy("seq").collect()
    assert [r["input_ids"] for r in left] == [[0, 1, 2, 3], [0, 0, 0, 1], [1, 2, 3, 4]]
    assert [r["attention_mask"] for r in left] == [[0, 1, 1, 1], [0, 0, 0, 1], [1] * 4]


@pytest.mark.parametrize("strategy, size, max_len, lens, chosen", [
    ("auto", 8, 1000, [5] * 200 + [30, 31, 32] * 9, "bucket"),
    ("auto", 64, 1000, list(range(1, 64)), "pack"), ("pack", 2, 10, [3, 10, 4, 4], "pack"),
    ("bucket", 2, 10, [3, 1], "bucket"), ("other", 2, 10, [3, 1], "other")])
def test_adaptive(spark, strategy, size, max_len, lens, chosen):
    df = arrays(spark, *lens)
    batches, info = B.adaptive_batches(df, size, max_len, strategy, shuffle=True)
    assert info["strategy"] == chosen
    padded = B.pad_right(batches, 0)
    useful = padded.select(F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)))
    assert useful.first()[0] == sum(lens)
    per_batch = padded.groupBy("batch_id").agg(F.countDistinct(F.size("input_ids")).alias("w"))
    assert per_batch.where("w > 1").count() == 0
    assert B.padded_tokens(batches).first()["useful_tokens"] == sum(lens)
