"""Held-out accuracy of the compression classifier, and texts it rejects."""

import os

import pytest
import zlib

from tuneloom.llm import langid

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, score double, held_out int"
EN = "the cat and the dog went over there with that thing while he thought of it"
DE = "der hund und die katze gehen nicht mit den anderen über eine straße zu ihm"


def make(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.0, 1) for r in rows], DOCS)


def corpus(n=60):
    return [(i, f"{(EN, DE)[i % 2]} {i}", ("en", "de")[i % 2]) for i in range(n)]


def test_predictions(spark):
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 + 34 = 46 !!", "de"), (103, "Katze", None),
           (None, DE, None), (104, "die straße " * 30000, "de")]
    rows = corpus() + odd + [(300, EN, "en")] * 2
    got = langid.identify(make(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[None].lang_pred == "de" and by[104].lang_pred == "de"
    assert by[103].lang_pred in ("en", "de")
    assert all(by[i].lang_pred == lang for i, _, lang in corpus())
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode())
                              % 5 == 0) for r in got)


def test_learns_from_the_other_folds_only(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, EN, "en") if i not in held else (i, EN, "xx") for i in range(200)]
    assert {r.lang_pred for r in langid.identify(make(spark, rows)).collect()} == {"en"}


def test_narrow_margins_are_rejected():
    coders = langid.Coders({"a": b"aaa bbb ccc " * 50, "b": b"xxx yyy zzz " * 50})
    assert coders.predict("aaa bbb ccc aaa bbb ccc qqqq", 0.2)[0] == "a"
    assert coders.predict("qwerty uiop", 0.2) == ("und", 0.0)
    assert coders.predict("qwerty uiop")[0] == "a"


def test_nothing(spark):
    df = make(spark, [])
    assert langid.identify(df).count() == 0 and langid.keep_identified(df).count() == 0
    no_lang = make(spark, [(1, EN, None)])
    assert [r.lang_pred for r in langid.identify(no_lang).collect()] == ["und"]


def test_without_a_taught_language_nothing_is_told_apart(spark):
    df = make(spark, [(1, EN, None), (2, "?? 11", None), (3, None, None), (4, "ß", None), (5, "", None)])
    assert sorted(r.doc_id for r in langid.keep_identified(df).collect()) == [1, 4]


def test_kept_documents(spark):
    df = make(spark, corpus() + [(200, "?? 11", "en"), (201, None, "en")])
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.96


A, B = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5
        and zlib.crc32(str(-i).encode()) % 5][:2]  # rows that are learnt from
ODD = [[(A, "qua tro po cha", "xx")], [(A, "", "xx")], [(A, " \n", "xx"), (B, "", "yy")]]


@pytest.mark.parametrize("odd", ODD)
def test_a_rare_label_leaves_the_others_their_dictionaries(spark, odd):
    from pyspark.sql import functions as F

    learnt = langid.learn_model(make(spark, corpus() + odd), F.lit(True))
    plain = langid.learn_model(make(spark, corpus()), F.lit(True))
    assert {k: learnt.dictionaries[k] for k in ("en", "de")} == plain.dictionaries
    assert all(learnt.dictionaries.values()) and len(learnt.dictionaries["en"]) > 100
    got = {r.doc_id: r.lang_pred for r in langid.identify(make(spark, corpus() + odd)).collect()}
    assert all(got[i] == lang for i, _, lang in corpus())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
@pytest.mark.parametrize("odd", ODD)
def test_held_out_accuracy_beside_a_rare_label(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-i, t, k) for i, t, k in odd]
    got = (langid.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
           .where("held_out AND doc_id > 0").join(docs, "doc_id").collect())
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.96


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
def test_the_stage_rejects_an_untaught_language(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 100")
    spanish = F.col("lang") == "es"
    kept = corpus_pipeline.language(spark, docs.withColumn(
        "lang", F.when(~spanish, F.col("lang"))).withColumn("was", F.col("lang")), "")
    before, after = (dict(d.groupBy(spanish.alias("s") if c == "lang" else F.col("was").isNull())
                          .count().collect()) for d, c in ((docs, "lang"), (kept, "was")))
    assert after[False] > 0.97 * before[False]
    assert after.get(True, 0) < 0.2 * before[True]
