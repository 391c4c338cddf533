import json
from pathlib import Path

import pytest
from engines import EchoEngine
from pyspark.sql import functions as F

from tuneloom.constants import Task
from tuneloom.functions.tokens import WordTokenizer
from tuneloom.operators.evalset import build_task
from tuneloom.plans import jobs
from tuneloom.session import CHECKPOINT_KEY, stage_root, stage_table
from tuneloom.sources import manifests as M
from tuneloom.sources import records as R
from tuneloom.sources import writers as W


def write(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    # the second file is larger, so its scan is planned first
    write(tmp_path / "a.jsonl", *[{"text": f"a{i}"} for i in range(5)])
    write(tmp_path / "b.jsonl", *[{"text": f"b{i}" + "x" * 500} for i in range(400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    rows = R.read_sft_jsonl(spark, str(tmp_path)).orderBy("seq").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["seq"] for r in rows] == list(range(405))
    assert [r["text"].rstrip("x") for r in rows] == \
        [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(400)]


def test_blank_lines_are_skipped_and_bad_ones_raise(spark, tmp_path):
    write(tmp_path / "ok.jsonl", {"text": "a"}, "", "   ", {"text": "b"})
    assert R.read_sft_jsonl(spark, str(tmp_path / "ok.jsonl")).count() == 2
    write(tmp_path / "bad.jsonl", {"text": "a"}, "{oops")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        R.read_sft_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_cap_comes_after_the_unusable_rows(spark, tmp_path):
    write(tmp_path / "d.jsonl", {"prompt": "q"}, {"text": "1"}, {"x": 1}, {"text": "2"},
          {"text": "3"})
    got = R.load_records(spark, str(tmp_path / "d.jsonl"), max_examples=2).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["1", "2"]


def test_named_tables_and_splits(spark, tmp_path):
    rows = [(i, f"t{i}", "train" if i % 2 else "test") for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, text string, split string")
    df.createOrReplaceTempView("named")
    got = R.load_records(spark, "named", split="test", seq="id").collect()
    assert sorted(r["text"] for r in got) == ["t0", "t2", "t4"]
    with pytest.raises(ValueError):
        R.load_records(spark, "named")
    by_text = R.load_records(spark, "named", split="test", seq="text").orderBy("seq").collect()
    assert [(r["seq"], r["text"]) for r in by_text] == [(0, "t0"), (1, "t2"), (2, "t4")]
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert R.load_records(spark, str(tmp_path / "t.parquet")).count() == 3


def test_eval_rows(spark, tmp_path):
    write(tmp_path / "t.jsonl", {"prompt": "p", "gold": "g"}, {"prompt": "q", "gold": "h"})
    got = R.read_eval_jsonl(spark, str(tmp_path / "t.jsonl")).orderBy("seq").collect()
    assert [(r["seq"], r["gold"]) for r in got] == [(0, "g"), (1, "h")]
    write(tmp_path / "empty.jsonl")
    with pytest.raises(ValueError, match="is empty"):
        R.read_eval_jsonl(spark, str(tmp_path / "empty.jsonl"))
    write(tmp_path / "blank.jsonl", {"prompt": "p", "gold": "g"}, "")
    with pytest.raises(ValueError, match="blank"):
        R.read_eval_jsonl(spark, str(tmp_path / "blank.jsonl"))


TASK = Task("mood", "src", "train", "test", "text", "{labels}: {text}", labels=("sad", "glad"))


def test_task_files_are_clean(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"x{i}", i % 2) for i in range(20)],
                                 "seq bigint, text string, label int")
    paths = W.write_split_jsonl(build_task(rows, rows, TASK, 5, 7), str(tmp_path), "mood")
    assert {k: v.rsplit("/", 1)[1] for k, v in paths.items()} == {
        "train": "mood_train.jsonl", "test": "mood_test.jsonl"}
    for split, label, n in (("train", "completion", 5), ("test", "gold", 7)):
        docs = [json.loads(r["value"]) for r in spark.read.text(paths[split]).collect()]
        assert len(docs) == n and all(set(d) == {"prompt", label} for d in docs)


def test_manifests_one_document_per_file(spark, tmp_path):
    for name, doc in (("r1", {"base_model": "b", "format": "adapter", "n_train": 9,
                              "overfit_verdict": "watch", "loss_history": {
                                  "train": [[1, 2.0], [2, 1.5]], "val": [[2, 1.7]]}}),
                      ("r2", {"base_model": "c", "quant": "4bit", "created": "2024-01-02T03:04:05"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps(doc, indent=2))
        (tmp_path / name / "adapter_config.json").write_text('{"rank": 8}')
    found = M.read_run_manifests(spark, str(tmp_path), name="run.json")
    found = found.withColumn("model", F.regexp_extract("run_dir", "([^/]*)$", 1))
    points = M.loss_points(found, "model").orderBy("kind", "iter").collect()
    assert [tuple(r) for r in points] == [("r1", "train", 1, 2.0), ("r1", "train", 2, 1.5),
                                          ("r1", "val", 2, 1.7)]
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "model string")
    got = {r["model"]: (r["base_model"], r["quant"]) for r in
           M.manifests_for(runs, found).collect()}
    assert got == {"r1": ("b", None), "r2": ("c", "4bit"), "r3": ("r3", "none")}
    bare = M.manifests_for(runs, found, defaults=False).where("model = 'r3'").first()
    assert bare["base_model"] is None


def test_manifest_variants_in_one_table(spark, tmp_path):
    a = spark.createDataFrame([("b", 3)], "base_model string, n_train bigint")
    b = spark.createDataFrame([("c", "4bit")], "base_model string, quant string")
    both = M.union_manifests(a, b)
    assert both.columns == ["base_model", "n_train", "quant"] and both.count() == 2
    stamped = both.withColumn("created", F.expr("timestamp'2024-05-06 07:08:09'"))
    for _ in range(2):
        M.append_run_manifest(stamped, str(tmp_path / "m"))
    back = M.read_run_manifests(spark, str(tmp_path / "m"), multi_line=False)
    assert back.count() == 4
    assert {r["created"] for r in back.collect()} == {"2024-05-06T07:08:09"}


def test_a_retried_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("a", "base", "2024-01-01"), ("b", None, "2024-01-02")],
                                 "adapter_path string, base_model string, created string")
    later = rows.withColumn("created", F.lit("2024-01-03")).where("base_model = 'base'")
    for df in (rows, rows, later):
        M.append_run_manifest(df, path, once=True)
    back = M.read_run_manifests(spark, path, multi_line=False)
    assert sorted((r.adapter_path, r.created) for r in back.collect()) == [
        ("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-02")]
    last = M.latest_manifests(back).collect()
    assert sorted((r.adapter_path, r.created) for r in last) == [
        ("a", "2024-01-03"), ("b", "2024-01-02")]


def test_nested_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_ROWS", 3)
    preds = spark.createDataFrame(
        [("a", i, f"g{i}", None if i % 2 else "p", f"r{i}") for i in range(10)] + [("b", 7, "g", "p", None)],
        "run_id string, seq bigint, gold string, pred string, raw string").repartition(5)
    summary = spark.createDataFrame([("a", 10), ("b", 1), ("c", 0)], "run_id string, n bigint")
    got = {r.run_id: r for r in W.nested_reports(summary, preds).collect()}
    assert [tuple(p) for p in got["a"].predictions] == [
        (f"g{i}", None if i % 2 else "p", f"r{i}") for i in range(10)]
    assert [tuple(p) for p in got["b"].predictions] == [("g", "p", None)] and got["c"].predictions == []
    with pytest.raises(ValueError, match="run a has 10"):
        W.nested_reports(summary, preds, most=9)
    W.write_eval_report(summary, preds, str(tmp_path / "r"))
    assert len(list((tmp_path / "r" / "predictions" / "run_id=a").glob("*.parquet"))) == 1


def test_a_written_set_opens_at_any_batch(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.range(400).selectExpr("id DIV 4 AS batch_id", "id % 4 AS pos_in_batch", "id AS record_id")
    W.write_batches(rows.repartition(7), path, per_file=10)
    for start, stop in ((0, None), (37, None), (37, 52), (99, 200), (100, None)):
        got = W.read_batches(spark, path, start, stop)
        assert sorted(r.record_id for r in got.collect()) == list(
            range(4 * start, 4 * min(stop or 100, 100)))
    files = {f for f in W.read_batches(spark, path, 37, 52).inputFiles() if "first_batch" in f}
    opened = W.read_batches(spark, path, 37, 52).select(F.col("record_id"), F.input_file_name().alias("f"))
    assert len(files) == 10 and {r.f.split("first_batch=")[1].split("/")[0] for r in opened.collect()} \
        == {"30", "40", "50"}
    one = spark.read.parquet(path + "/first_batch=30/next_batch=40").collect()
    assert [r.record_id for r in one] == list(range(120, 160))  # in order within the file


def test_batches_are_placed_without_sampling(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        runs.add(1)
        yield from batches

    rows = spark.range(0, 40, 1, 1).selectExpr("id AS batch_id", "0L AS pos_in_batch").mapInArrow(
        count, "batch_id bigint, pos_in_batch bigint")
    W.write_batches(rows, str(tmp_path / "b"), per_file=8)
    assert runs.value == 1


def test_prepare_and_write_batches(spark, tmp_path):
    rows = [(i, i, "pair", "w " * (i % 9), "a b c d", None) for i in range(40)]
    records = spark.createDataFrame(rows, "record_id bigint, seq bigint, kind string, "
                                          "prompt string, completion string, text string")
    for strategy in ("auto", "pack", "pad"):
        out = str(tmp_path / strategy)
        infos = jobs.prepare_training(records, WordTokenizer(), out, max_len=32, batch_size=4,
                                      strategy=strategy)
        train, val = (spark.read.parquet(f"{out}/{s}") for s in ("train", "val"))
        widths = train.groupBy("batch_id").agg(F.countDistinct(F.size("input_ids")).alias("w"))
        assert widths.where("w <> 1").isEmpty()
        if strategy == "pack":
            members = {s["record_id"] for df in (train, val) for r in df.collect()
                       for s in r["segments"]}
            assert members == set(range(40))
        else:
            assert (train.count(), val.count()) == (36, 4)
        assert set(infos) == {"train", "val"}
    assert not list(Path(stage_root(spark), "tuneloom").glob("job-*"))


def test_evaluate_a_task_end_to_end(spark, tmp_path):
    write(tmp_path / "t.jsonl", *[{"prompt": f"label_{i % 3} text", "gold": f"label_{i % 2}"}
                                  for i in range(12)])
    summary = jobs.evaluate_task(spark, str(tmp_path / "t.jsonl"), EchoEngine, "m",
                                 str(tmp_path / "report")).first()
    assert (summary["n"], summary["correct"], summary["unparseable"]) == (12, 4, 4)
    assert (summary["tag"], summary["majority_baseline"]) == ("base", 0.5)
    doc = spark.read.json(str(tmp_path / "report/summary")).first()
    assert doc["correct"] == 4 and doc["model"] == "m"
    preds = spark.read.parquet(str(tmp_path / "report/predictions"))
    assert preds.count() == 12 and preds.where("pred is null").count() == 4


def test_staging_uses_the_folder_of_the_session(spark):
    root = spark.conf.get(CHECKPOINT_KEY)
    assert stage_root(spark) == root
    staged = stage_table(spark.range(5), "x")
    assert staged.count() == 5 and all(root in f for f in staged.inputFiles())


def test_parquet_rows_are_numbered_by_position(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    rows = R.with_parquet_seq(spark.read.parquet(path)).collect()
    assert len(rows) == 1000 and all(r["seq"] == r["id"] for r in rows)


def test_many_spans_are_joined_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "_MAX_BROADCAST_SPANS", 0)
    test_parquet_rows_are_numbered_by_position(spark, tmp_path)
