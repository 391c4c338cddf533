"""The pipeline on planted documents: each stage's decisions take effect."""

import corpus_pipeline
import pytest

EN = "the cat and the dog went over there with that thing while he thought of it again"
DE = "der hund und die katze gehen nicht mit den anderen über eine straße zu ihm nach"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(80):
        base = (EN, DE)[i % 2].split()
        text = " ".join(f"{w}{chr(97 + (i * 7 + k * k) % 26)}{i}" if k % 3 else w
                        for k, w in enumerate(base * 3))
        rows.append((i, text, ("en", "de")[i % 2], f"s{i % 4}"))
    leak = "Which 12 of these very rare green frogs lives near the deep lake in the south of Spain?"
    rows += [(100, rows[3][1], "de", "s1"), (101, rows[3][1] + " x", "de", "s1"),
             (102, "12 34 !!", "en", "s0"), (103, None, None, None), (104, f"Look. {leak}", "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == before.columns
    clean = list(range(80))
    assert [x for x in seen["language"] if x < 100] == clean
    assert not {102, 103} & set(seen["language"])
    assert [x for x in seen["near_duplicates"] if x < 100] == clean
    assert 100 not in seen["near_duplicates"]
    assert 104 in seen["near_duplicates"] and 104 not in seen["decontamination"]
    assert len(seen["sharding"]) == len(seen["mixing"])
    assert {"shard", "slot"} <= set(docs.columns)


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0
        docs = out.select(docs.columns)
