import glob
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tuneloom.functions.tokens import WordTokenizer
from engines import EchoEngine
from tuneloom.operators.runs import new_best_flag
from tuneloom.plans import catalog
from tuneloom.streaming import metrics as S
from tuneloom.streaming import prepare as P
from tuneloom.streaming import requests as Q
from tuneloom.streaming import versions as V
from tuneloom.streaming import sinks
from tuneloom.streaming.sinks import ProgressLog

COLUMNS = ("run_id bigint, epoch bigint, iter bigint, kind string, loss double, tokens bigint, "
           "ts timestamp")


def land(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(run, *losses, first=0, kind="val"):
    import datetime as d
    start = d.datetime(2024, 1, 1)
    return [(run, 0, first + i, kind, x, 10, start + d.timedelta(seconds=first + i))
            for i, x in enumerate(losses)]


def test_new_best_events_across_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        S.stream_new_best_events(source(spark, folder), out, str(tmp_path / "cp"),
                                 str(tmp_path / "state"), shard_rows=2).awaitTermination()

    nan = float("nan")
    land(spark, folder, rows(1, nan, 0.9, 0.5, 0.7) + rows(2, 0.3))
    run()
    land(spark, folder, rows(1, 0.6, 0.4, first=10) + rows(2, 0.3, first=10))
    run()
    # a row of an earlier iteration arrives last
    land(spark, folder, rows(1, 0.1, first=5) + rows(3, 0.8, 0.9, kind="train"))
    run()
    run()
    got = spark.read.parquet(out).orderBy("run_id", "iter").collect()
    assert [(r["run_id"], r["iter"], r["val_loss"], r["late"]) for r in got] == [
        (1, 1, 0.9, False), (1, 2, 0.5, False), (1, 5, 0.1, True), (1, 11, 0.4, False),
        (2, 0, 0.3, False)]


def test_in_order_events_equal_the_batch_flag(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    import random
    rng = random.Random(1)
    every = [(run, [rng.random() for _ in range(30)]) for run in range(3)]
    for cut in range(0, 30, 10):
        land(spark, folder, [r for run, losses in every
                             for r in rows(run, *losses[cut:cut + 10], first=cut)])
        S.stream_new_best_events(source(spark, folder), out, str(tmp_path / "cp"),
                                 str(tmp_path / "state")).awaitTermination()
    live = {(r["run_id"], r["iter"]) for r in spark.read.parquet(out).collect()}
    flagged = new_best_flag(spark.read.parquet(folder)).where("is_best")
    assert live == {(r["run_id"], r["iter"]) for r in flagged.collect()}


def test_views_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for first, losses in ((0, [0.9, 0.5]), (2, [0.6, 0.5]), (4, [0.7])):
        land(spark, folder, rows(1, *losses, first=first) + rows(1, 1.0, first=first + 20,
                                                                 kind="train"))
    out = str(tmp_path / "best")
    S.stream_best_checkpoint(source(spark, folder), out, str(tmp_path / "c1")).awaitTermination()
    schema = S.best_checkpoint_view(source(spark, folder)).schema
    assert len(list((tmp_path / "best").glob("delta-*"))) > 1
    best = S.read_latest(spark, out, schema, ["run_id"]).first()
    assert (best["best_val"], best["best_iter"]) == (0.5, 1)

    out = str(tmp_path / "progress")
    S.stream_progress(source(spark, folder), out, str(tmp_path / "c2")).awaitTermination()
    p = S.read_latest(spark, out, S.progress_view(source(spark, folder)).schema,
                      ["run_id", "epoch"]).first()
    assert (p["mean_loss"], p["tokens"], p["seconds"], p["tokens_per_s"]) == (1.0, 30, 4.0, 7.5)


def test_running_accuracy(spark, tmp_path):
    columns = "run_id string, seq bigint, gold string, pred string"
    for first in (0, 10):
        spark.createDataFrame([("r", first + i, "a", "a" if i % 2 else None) for i in range(10)],
                              columns).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    S.stream_running_accuracy(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    r = S.read_latest(spark, str(tmp_path / "o"), S.accuracy_view(stream).schema,
                      ["run_id"]).first()
    assert (r["n"], r["correct"], r["accuracy"]) == (20, 10, 0.5)


def test_landing_folder_is_prepared_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    tok = WordTokenizer()

    def run():
        raw = P.read_landing(spark, str(folder), files_per_trigger=1)
        P.stream_prepare(raw, tok, 16, out, str(tmp_path / "cp")).awaitTermination()

    for name, first in (("a.json", 0), ("b.json", 10)):
        docs = [{"record_id": first, "instruction": "q", "output": "a b"},
                {"record_id": first + 1, "prompt": "q"},
                {"record_id": first + 2, "text": "one two three"},
                {"record_id": first + 3, "text": "one"}]
        (folder / name).write_text("\n".join(json.dumps(d) for d in docs))
        run()
        run()
    live = {r["record_id"]: (r["input_ids"], r["labels"]) for r in
            spark.read.parquet(out).collect()}
    batch = spark.read.schema(P.read_landing(spark, str(folder)).drop("seq").schema) \
        .json(str(folder)).withColumn("seq", F.col("record_id"))
    assert sorted(live) == [0, 2, 10, 12]
    assert live == {r["record_id"]: (r["input_ids"], r["labels"]) for r in
                    P.prepare_view(batch, tok, 16).collect()}


def test_requests_are_answered_or_rejected(spark, tmp_path):
    columns = "request_id string, route string, body string"
    spark.createDataFrame(
        [("a", "/v1/completions", '{"prompt":"x y z","max_tokens":2}'), ("b", "/other", "{}"),
         ("c", "/v1/chat/completions", "")], columns).write.parquet(str(tmp_path / "in"))
    seen = []
    listener = ProgressLog(lambda name, batch, n, rate: seen.append((batch, n)))
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    Q.stream_score_requests(stream, EchoEngine, "m", str(tmp_path / "out"),
                            str(tmp_path / "rejects"), str(tmp_path / "cp"),
                            created=1).awaitTermination()
    out = {r["request_id"]: json.loads(r["response"]) for r in
           spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["a"]["choices"][0]["text"] == "x y" and set(out) == {"a", "c"}
    assert [r["request_id"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["b"]
    import time
    for _ in range(50):
        if seen:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(n for _, n in seen) >= 3


def test_fifty_batches_leave_few_folders(spark, tmp_path):
    out, best = str(tmp_path / "table"), {}
    schema = "key bigint, best double"
    for batch in range(50):
        rows = [(batch % 7, 50.0 - batch), (100 + batch, 1.0)]
        best |= dict(rows)
        V.write_version(spark.createDataFrame(rows, schema).coalesce(1), out, batch, ["key"], every=4)
        assert len(list((tmp_path / "table").iterdir())) <= 2 + 2 * 4
    shape = spark.createDataFrame([], schema).schema
    now = V.read_versions(spark, out, shape, ["key"])
    assert now.columns == ["key", "best"] and {r.key: r.best for r in now.collect()} == best
    # a delta holds what its batch has touched, not the table
    assert spark.read.parquet(f"{out}/delta-49").count() == 2


def test_torn_and_retried_batches(spark, tmp_path):
    out, schema = str(tmp_path / "table"), "key bigint, best double"
    shape = spark.createDataFrame([], schema).schema

    def write(batch, *rows):
        V.write_version(spark.createDataFrame(list(rows), schema).coalesce(1), out, batch, ["key"],
                        every=2)

    def read(before=None):
        return {r.key: r.best for r in V.read_versions(spark, out, shape, ["key"], before).collect()}

    assert read() == {}
    write(0, (1, 9.0), (2, 9.0))
    write(1, (1, 8.0))
    write(2, (1, 7.0))
    (tmp_path / "table" / "delta-2" / "_SUCCESS").unlink()  # torn
    assert read() == {1: 8.0, 2: 9.0}
    write(2, (1, 7.0))
    write(3, (3, 5.0))
    write(3, (3, 5.0))  # retried after its snapshot
    assert read() == {1: 7.0, 2: 9.0, 3: 5.0} and read(before=3) == {1: 7.0, 2: 9.0}
    (tmp_path / "table" / "snapshot-3" / "_SUCCESS").unlink()
    assert read() == {1: 7.0, 2: 9.0, 3: 5.0}
    write(3, (3, 5.0))
    assert read() == {1: 7.0, 2: 9.0, 3: 5.0}


def test_broken_lines_go_beside_the_stream(spark, tmp_path):
    folder, out, bad = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad")
    folder.mkdir()

    def run():
        P.stream_prepare_lines(P.read_landing_lines(spark, str(folder), 1), WordTokenizer(), 16,
                               out, bad, str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()

    (folder / "a.json").write_text('{"text": "one two"}\n\n{"text": \n{"text": "three four five"}\n[1]\n')
    run()
    (folder / "b.json").write_text('no json\n{"prompt": "q", "output": "a b c d e"}\n{"text": "x y"}\n')
    run()
    run()
    got = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r.seq, r.record_id, len(r.input_ids) > 1) for r in got] == [
        (0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    rejects = spark.read.parquet(bad).orderBy("file", "line").collect()
    assert [(r.file.rsplit("/", 1)[1], r.line, r.value) for r in rejects] == [
        ("a.json", 3, '{"text": '), ("a.json", 5, "[1]"), ("b.json", 1, "no json")]


def test_measures_of_each_batch_and_of_a_retried_one(spark, tmp_path, monkeypatch):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for run in range(3):
        land(spark, folder, rows(run, *[0.5] * (run + 1), 2.0, None))
    measures = [F.count("*").alias("n"), F.count_if(F.col("loss") > 1).alias("high")]
    torn = []
    real = sinks.batch_folder

    def fails_once(path, batch_id):
        if path.endswith("counts") and batch_id == 1 and not torn:
            torn.append(batch_id)
            raise OSError("lost")
        return real(path, batch_id)

    monkeypatch.setattr(sinks, "batch_folder", fails_once)

    def run():
        sinks.write_observed(source(spark, folder), out, out + "-counts", out + "-checkpoint",
                             measures, lambda df: df.where("loss < 1")).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert torn == [1] and spark.read.parquet(out).count() == 6
    seen = spark.read.parquet(out + "-counts").orderBy("batch").collect()
    assert sorted(r["n"] for r in seen) == [3, 4, 5] and [r["high"] for r in seen] == [1, 1, 1]
    assert [r["batch"] for r in seen] == [0, 1, 2]


def test_landed_files_grow_with_the_input(spark, tmp_path, monkeypatch):
    """As many files land as the input has parts, and a micro-batch takes a bounded number."""
    source, root = "/root/testdata/sf0.001", str(tmp_path / "shared")
    spark.read.parquet(f"{source}/documents.parquet").repartition(20).write.parquet(
        str(tmp_path / "documents.parquet"))
    os.symlink(f"{source}/conversations.parquet", tmp_path / "conversations.parquet")
    monkeypatch.setattr(catalog, "MAX_FILES", 5, raising=False)
    monkeypatch.setattr(catalog, "stage_path", lambda spark, name: f"{root}/{name}")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = catalog.stream_observed_filter(spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert got == catalog.filter_stats(spark, source).first()
    assert len(glob.glob(f"{root}/records/*.parquet")) >= 20
    assert len(glob.glob(f"{root}/kept-counts/batch=*")) >= 4
