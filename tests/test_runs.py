import math

import pytest

from tuneloom.operators import models as M
from tuneloom.operators import runs as R

COLUMNS = "run_id int, epoch bigint, iter bigint, kind string, loss double, tokens bigint, ts timestamp"


def log(spark, *rows):
    import datetime as d
    start = d.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(run, ep, it, kind, loss, 10, start + d.timedelta(seconds=it))
         for run, ep, it, kind, loss in rows], COLUMNS)


NAN = float("nan")


def test_best_checkpoint(spark):
    df = log(spark, (1, 0, 1, "val", NAN), (1, 0, 2, "val", 0.5), (1, 0, 3, "val", 0.5),
             (2, 0, 1, "train", 0.1), (3, 0, 1, "val", NAN))
    got = {r["run_id"]: (r["best_val"], r["best_iter"]) for r in R.best_checkpoint(df).collect()}
    assert got == {1: (0.5, 2), 2: (math.inf, -1), 3: (math.inf, -1)}


@pytest.mark.parametrize("shard_rows", [2, 1 << 18])
def test_new_best_flag(spark, shard_rows):
    losses = [NAN, 0.9, 0.9, 0.5, 0.7, NAN, 0.4, 0.4]
    df = log(spark, *[(1, 0, i, "val", x) for i, x in enumerate(losses)], (1, 0, 99, "train", 0.0))
    got = {r["iter"] for r in R.new_best_flag(df, shard_rows).where("is_best").collect()}
    assert got == {1, 3, 6}


@pytest.mark.parametrize("val, train, want", [
    (0.9, 0.5, "healthy"), (1.0, 0.5, "watch"), (1.5, 0.5, "OVERFIT RISK")])
def test_verdict(spark, val, train, want):
    df = log(spark, (1, 0, 4, "train", train), (1, 0, 5, "val", val), (1, 0, 6, "train", train + 9))
    r = R.overfit_verdict(df).first()
    # iterations 4 and 6 are equally near: the earlier one counts
    assert (r["best_iter"], r["train_loss"], r["verdict"]) == (5, train, want)


def test_verdict_edges(spark):
    df = log(spark, (1, 0, 1, "val", 0.2), (2, 0, 1, "train", 0.2),
             (3, 0, 1, "val", NAN), (3, 0, 2, "train", 0.1))
    got = {r["run_id"]: r["verdict"] for r in R.overfit_verdict(df).collect()}
    assert got == {1: "OVERFIT RISK", 3: "OVERFIT RISK"}


def test_resume_point(spark):
    df = spark.createDataFrame([(1, "epoch-9"), (1, "epoch-10"), (1, "tmp"), (2, None), (3, "x")],
                               "run_id int, name string")
    assert {r["run_id"]: r["start_epoch"] for r in R.resume_point(df).collect()} == {
        1: 11, 2: 0, 3: 0}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.resume_point(spark.createDataFrame([(1, "epoch-x")], "run_id int, name string")).collect()


@pytest.mark.parametrize("n, size, epochs, accum, want", [
    (10, 4, 3, 2, dict(batches=3, planned_steps=6, applied_steps=3, iters=9, report_every=1,
                       eval_every=1)),
    (1000, 4, 2, 4, dict(batches=250, planned_steps=126, applied_steps=124, iters=500,
                         report_every=50, eval_every=83)),
    (0, 4, 2, 4, dict(batches=0, planned_steps=0, applied_steps=0, iters=1, report_every=1,
                      eval_every=1))])
def test_training_plan(spark, n, size, epochs, accum, want):
    sizes = spark.createDataFrame([(n, 25)], "n_train bigint, n_val bigint")
    got = R.training_plan(sizes, size, epochs, accum).first().asDict()
    assert {k: got[k] for k in want} == want and got["val_batches"] == 20


def test_epoch_summary_and_running_metrics(spark):
    rows = [(1, e, e * 10 + i, "train", float(i)) for e in range(2) for i in range(5)]
    df = log(spark, *rows, (1, 0, 7, "val", 9.0))
    summary = R.epoch_summary(df).orderBy("epoch").collect()
    assert [(r["mean_loss"], r["tokens"], r["seconds"], r["tokens_per_s"]) for r in summary] == [
        (2.0, 50, 4.0, 12.5)] * 2
    # two steps per epoch, the fifth micro-batch is left over
    got = R.running_training_metrics(df, accum=2, every=1, shard_rows=2).orderBy("step").collect()
    assert [(r["step"], r["epoch"], r["loss"], r["seen_tokens"], r["tokens_per_s"])
            for r in got] == [(1, 0, 0.5, 20, 20.0), (2, 0, 1.5, 40, 40 / 3),
                              (3, 1, 0.5, 20, 20.0), (4, 1, 1.5, 40, 40 / 3)]
    shown = R.running_training_metrics(df, accum=1, every=5).collect()
    assert sorted(r["step"] for r in shown) == [5, 10]
    # no time has passed at the first row of an epoch
    first = R.running_training_metrics(df, accum=1, every=1).where("step = 1").first()
    assert first["tokens_per_s"] == 0.0


def test_speedup(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 5.0), ("b", 3, 0.0), ("b", 4, 7.0)],
                               "bench string, pos int, tokens_per_s double")
    got = {(r["bench"], r["pos"]): r["speedup"] for r in R.speedup_vs_baseline(df).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 2.5, ("b", 3): 1.0, ("b", 4): 1.0}


@pytest.mark.parametrize("name, hf, params, alias", [
    ("phi-3", "microsoft/Phi-3-mini-4k-instruct", 3.8, "phi-3"),
    ("org/Some-70B-13b", "org/Some-70B-13b", 70.0, "Some-70B-13b"),
    ("org/x-0.5b/", "org/x-0.5b/", 0.5, "x-0.5b"), ("a/b-13b", "a/b-13b", 13.0, "b-13b"),
    ("plain", "plain", 1.5, "plain"), ("x-3b", "x-3b", 3.2, "x-3b")])
def test_models(spark, name, hf, params, alias):
    r = M.enrich_models(spark.createDataFrame([(name,)], "name string")).first()
    assert (r["hf"], r["params_b"], r["alias"]) == (hf, params, alias)


def test_clamp(spark):
    configs = spark.createDataFrame(
        [("a", 100, None), ("b", 0, 50), ("c", None, None), ("d", 0, 0)],
        "model string, max_position_embeddings int, n_positions int")
    wishes = spark.createDataFrame([(m, 80) for m in "abcde"], "model string, requested_len int")
    got = {r["model"]: r["context_len"] for r in M.clamp_context(wishes, configs).collect()}
    assert got == {"a": 80, "b": 50, "c": 80, "d": 80, "e": 80}
