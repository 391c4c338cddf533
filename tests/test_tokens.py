import random
import zlib

import pytest
from pyspark.sql import functions as F

from tuneloom.functions import text as X
from tuneloom.functions import tokens as T
from tuneloom.operators.batching import tokenize_records


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def word_id(w):
    return zlib.crc32(w.encode()) & 0x7FFFFFFF


def test_word_tokenizer(spark):
    tok = T.WordTokenizer(bos_id=1)
    ids = [word_id("ab"), word_id("ü"), word_id("ab")]
    assert one(spark, tok.ids(F.col("t")), t=" ab  ü\nab ") == [1, *ids]
    assert one(spark, tok.ids(F.col("t"), specials=False), t=" ab  ü\nab ") == ids
    assert one(spark, tok.count(F.col("t")), t="a b") == 3
    assert one(spark, tok.count(F.col("t"), specials=False), t="") == 0
    assert tok.pad_id == tok.eos_id == 2


def test_byte_tokenizer(spark):
    tok = T.ByteTokenizer()
    text = "aé€\n😀"
    assert one(spark, tok.ids(F.col("t")), t=text) == list(text.encode())
    assert one(spark, tok.count(F.col("t")), t=text) == len(text.encode())
    assert one(spark, tok.ids(F.col("t")), t="") == []


@pytest.mark.parametrize("ids, p, want", [
    ([5, 6, 7], 2, [-100, -100, 7]), ([5, 6], 3, [-100, -100]), ([5], 0, [5]), ([], 2, [])])
def test_mask_prompt(spark, ids, p, want):
    column = T.mask_prompt(F.array(*[F.lit(i) for i in ids]).cast("array<int>"), F.lit(p))
    assert one(spark, column) == want


def test_array_functions(spark):
    ids = F.array(F.lit(4), F.lit(5))
    assert one(spark, T.truncate(T.append_eos(ids, 2), 2)) == [4, 5]
    assert one(spark, T.fill_right(ids, 0, F.lit(4))) == [4, 5, 0, 0]
    assert one(spark, T.fill_left(ids, 0, F.lit(4))) == [0, 0, 4, 5]
    assert one(spark, T.position_ids(F.array(F.lit(2), F.lit(0), F.lit(3)))) == [0, 1, 0, 1, 2]
    assert one(spark, T.cut_completion(ids, F.lit(1))) == [4]
    assert one(spark, T.cut_completion(ids, F.lit(0))) == []


def records(spark):
    return spark.createDataFrame(
        [(1, 1, "pair", "a b", "c d", None), (2, 2, "text", None, None, "a b c"),
         (3, 3, "pair", "a b c d e f", "g h", None)],
        "record_id bigint, seq bigint, kind string, prompt string, completion string, text string")


def test_tokenize_records(spark):
    tok = T.WordTokenizer()
    rows = {r["record_id"]: r for r in tokenize_records(records(spark), tok, 11).collect()}
    head = [word_id(w) for w in "### Instruction: a b ### Response:".split()]
    assert rows[1]["input_ids"] == [*head, word_id("c"), word_id("d"), 2]
    assert rows[1]["labels"] == [-100] * 6 + [word_id("c"), word_id("d"), 2]
    assert rows[2]["input_ids"] == rows[2]["labels"] == [word_id(w) for w in "abc"]
    # the end marker is appended before the cut, so it may be lost
    assert rows[3]["length"] == 11 and rows[3]["labels"][:10] == [-100] * 10
    assert rows[3]["input_ids"][-1] == word_id("g")


def bpe():
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = trainers.BpeTrainer(vocab_size=300, special_tokens=["<s>"],
                                  initial_alphabet=pre_tokenizers.ByteLevel.alphabet())
    tok.train_from_iterator(["the cat sat on the mat", "### Instruction:\n\n### Response:\n"] * 9,
                            trainer)
    return tok


def test_learned_vocabulary_is_shipped_and_loaded_per_task(spark, tmp_path):
    pytest.importorskip("tokenizers")
    trained = bpe()
    trained.save(str(tmp_path / "vocab.json"))
    spark.sparkContext.addFile(str(tmp_path / "vocab.json"))

    def factory():
        from pyspark import SparkFiles
        from tokenizers import Tokenizer
        return Tokenizer.from_file(SparkFiles.get("vocab.json"))

    tok = T.PluginTokenizer(factory, eos_id=0)
    texts = ["the cat", "", "on the mat sat ü", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = {r["t"]: (r["ids"], r["n"]) for r in df.select(
        "t", tok.ids(F.col("t")).alias("ids"), tok.count(F.col("t")).alias("n")).collect()}
    for t in texts[:3]:
        want = trained.encode(t).ids
        assert got[t] == (want, len(want))
    assert got[None] == (None, None)
    # the mask is the prompt's own token count, also where merges cross the border
    rows = tokenize_records(records(spark).where("kind = 'pair'"), tok, 1000).collect()
    for r in rows:
        assert r["labels"].count(-100) == r["prompt_len"] and r["input_ids"][-1] == 0


def test_plugin_callable_and_dict(spark):
    assert T.encode_text(lambda t: {"input_ids": [1, 2]}, "x", True) == [1, 2]
    assert T.encode_text(str.split, "a b", True) == ["a", "b"]


@pytest.mark.parametrize("raw, want", [
    ("Card_Not-Working", "card not working"), ("  a   b\t\n", "a b"), ("_-", ""),
    (" x\x1c　", "x")])
def test_norm_label(spark, raw, want):
    assert one(spark, X.norm_label("t"), t=raw) == want
    assert want == " ".join(raw.lower().replace("_", " ").replace("-", " ").split())


@pytest.mark.parametrize("raw", [" a b  ", "\n x\ny\x1f", "", "   ", "a\n"])
def test_strip(spark, raw):
    assert one(spark, X.strip("t"), t=raw) == raw.strip()


def test_other_text(spark):
    assert one(spark, X.first_present("a", "b"), a="", b="x") == "x"
    assert one(spark, X.preview("t"), t="é" * 100) == "é" * 80
    assert one(spark, X.word_count("t"), t=" a  b\nc ") == 3
    assert one(spark, X.word_count("t"), t="a\u00a0b\u2003c\u3000") == 3
    assert one(spark, X.base_name("t"), t="hub/x-7b//") == "x-7b"
    assert one(spark, X.last_segment("t"), t="hub/x-7b") == "x-7b"
    assert one(spark, X.iso_seconds(F.expr("timestamp'2024-01-02 03:04:05.9'"))) == \
        "2024-01-02T03:04:05"


def test_word_count_is_what_python_splits(spark):
    """Texts of every kind of space beside letters that share its bytes, cut into parts or not."""
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x3100) if chr(c).isspace()] + list("ab¡ąᚁ​‰、日\U0001f642")
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "　", "w" * (1 << 20), " b " * 300_000, None, "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = df.select("i", X.word_count("t").alias("n"))
    assert {r.i: r.n for r in got.collect()} == {
        i: None if t is None else len(t.split()) for i, t in enumerate(texts)}
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
