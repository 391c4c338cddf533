import pytest

from tuneloom.operators import splits as S


def table(spark, n, partitions=3):
    return spark.range(n).withColumnRenamed("id", "seq").repartition(partitions)


def ids(df):
    return sorted(r["seq"] for r in df.collect())


@pytest.mark.parametrize("n, n_val", [(0, 0), (1, 1), (2, 1), (10, 2), (11, 1), (100, 10)])
def test_split_sizes(spark, n, n_val):
    split = S.train_val_split(table(spark, n))
    val, train = ids(split.where("in_val")), ids(split.where("in_train"))
    assert len(val) == n_val and len(train) == (n if n < 2 else n - n_val)
    if n >= 2:
        assert not set(val) & set(train) and sorted(val + train) == list(range(n))
        assert split.where("in_val").select("seq").intersect(
            split.where("in_train").select("seq")).isEmpty()


def test_train_is_never_empty(spark):
    assert S.train_val_split(table(spark, 20), 1.0).where("in_train").count() == 1


def test_choices_do_not_depend_on_partitions(spark):
    one, many = table(spark, 300, 1), table(spark, 300, 9)
    assert ids(S.sample_exact(one, 40, 3)) == ids(S.sample_exact(many, 40, 3))
    assert ids(S.sample_exact(one, 40, 3)) != ids(S.sample_exact(one, 40, 4))
    assert ids(S.train_val_split(one).where("in_val")) == \
        ids(S.train_val_split(many).where("in_val"))


@pytest.mark.parametrize("n", [0, 5, 300, 999])
def test_sample_is_exact(spark, n):
    got = ids(S.sample_exact(table(spark, 300), n))
    assert len(got) == len(set(got)) == min(n, 300)


@pytest.mark.parametrize("cap", [1, 120, 300, 500])
def test_head_cap(spark, cap):
    got = S.head_cap(table(spark, 300), cap, shard_rows=32)
    assert ids(got) == list(range(min(cap, 300)))


def test_head_cap_off_and_refused(spark):
    df = table(spark, 5)
    assert S.head_cap(df, 0) is df and S.head_cap(df, None) is df
    with pytest.raises(ValueError):
        S.head_cap(df, -1)


def test_sampled_rows_are_not_shuffled(spark):
    wide = table(spark, 300).selectExpr("seq", "repeat('x', 50) payload")
    plan = S.sample_exact(wide, 10)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Subquery")[0]
    assert "hashpartitioning(_bin" not in top


def test_shuffle_is_a_permutation(spark):
    got = S.shuffle(table(spark, 200), 1).collect()
    assert sorted(r["position"] for r in got) == list(range(200))
    assert [r["seq"] for r in sorted(got, key=lambda r: r["position"])] != list(range(200))


@pytest.mark.parametrize("n, min_rows, copies", [(3, 3, 1), (3, 4, 2), (3, 25, 16), (5, 0, 1),
                                                 (1, 3000, 4096)])
def test_amplify(spark, n, min_rows, copies):
    out = S.amplify(table(spark, n), min_rows)
    assert out.count() == out.distinct().count() == n * copies
    assert {r["copy"] for r in out.select("copy").distinct().collect()} == set(range(copies))


def test_amplify_refuses_nothing(spark):
    with pytest.raises(ValueError):
        S.amplify(table(spark, 0), 4)
