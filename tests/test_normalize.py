import pytest

from tuneloom.operators.normalize import (coerce_shape, drop_unusable, messages_to_pairs,
                                          normalize_records, render)
from tuneloom.schemas import MESSAGES, SFT_FIELDS, SFT_RAW


def raw(spark, *rows):
    schema = "record_id bigint, seq bigint, " + ", ".join(f"`{f}` string" for f in SFT_FIELDS)
    return spark.createDataFrame(
        [(i, i, *[r.get(f) for f in SFT_FIELDS]) for i, r in enumerate(rows)], schema)


def normalized(spark, row):
    r = normalize_records(raw(spark, row)).first()
    return r["kind"], r["prompt"], r["completion"], r["text"]


@pytest.mark.parametrize("row, want", [
    ({"prompt": "", "instruction": "a", "output": "b"}, ("pair", "a", "b", None)),
    ({"instruction": "q", "input": "c", "output": "o"},
     ("pair", "q\n\nContext:\nc", "o", None)),
    ({"input": "q", "output": "o"}, ("pair", "q", "o", None)),
    ({"prompt": "q", "context": "q", "output": "o"}, ("pair", "q", "o", None)),
    ({"prompt": "q", "context": "", "input": "c", "answer": "o"},
     ("pair", "q\n\nContext:\nc", "o", None)),
    ({"prompt": "0", "completion": "false"}, ("pair", "0", "false", None)),
    ({"prompt": " ", "completion": " "}, ("pair", " ", " ", None)),
    ({"prompt": "q", "text": "t"}, ("text", None, None, "t")),
    ({"content": "t"}, ("text", None, None, "t")),
    ({"prompt": "p", "completion": "c", "text": "t"}, ("pair", "p", "c", None)),
    ({"prompt": "q"}, (None, None, None, None)),
    ({"question": "a", "prompt": "b", "response": "c", "answer": "d"},
     ("pair", "b", "c", None)),
])
def test_shapes(spark, row, want):
    assert normalized(spark, row) == want


def test_unusable_rows_go(spark):
    df = raw(spark, {"prompt": "q"}, {"text": "t"}, {})
    assert [r["record_id"] for r in drop_unusable(normalize_records(df)).collect()] == [1]


def test_missing_columns_and_typed_values(spark):
    df = spark.createDataFrame([(1, 1, 0, False)], "record_id bigint, seq bigint, prompt int, "
                               "completion boolean")
    r = normalize_records(df).first()
    assert (r["kind"], r["prompt"], r["completion"]) == ("pair", "0", "false")


def test_json_text_is_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"prompt": {"z":1}, "completion": 0}\n\n'
                                     '{"prompt": [1,2], "output": true}\n')
    df = spark.read.schema(SFT_RAW).option("mode", "FAILFAST").json(str(tmp_path)).selectExpr(
        "1L record_id", "1L seq", "*")
    got = {(r["prompt"], r["completion"]) for r in normalize_records(df).collect()}
    assert got == {('{"z":1}', "0"), ("[1,2]", "true")}


def chats(spark, *messages):
    df = spark.createDataFrame([(i, i, m) for i, m in enumerate(messages)],
                               "record_id bigint, seq bigint, messages "
                               "array<struct<role:string,content:string>>")
    assert df.schema["messages"].dataType == MESSAGES
    return df


def test_messages_only_by_request(spark):
    df = chats(spark, [("user", "hi"), ("assistant", "yo")],
               [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")],
               [("assistant", "b")], [("user", "c")], [])
    assert drop_unusable(normalize_records(df)).count() == 0
    got = drop_unusable(normalize_records(df, chat=True)).orderBy("record_id").collect()
    assert [(r["kind"], r["prompt"], r["completion"]) for r in got] == [
        ("chat", "### Instruction:\nhi\n\n### Response:\n", "yo"),
        ("chat", "system: s\nuser: a\nassistant:", "b")]
    pairs = messages_to_pairs(df).orderBy("record_id").collect()
    assert [r["completion"] for r in pairs] == ["yo", "b", None, None, None]


def test_render(spark):
    df = normalize_records(raw(spark, {"prompt": "p", "completion": "c"}, {"text": "t"}))
    assert [r["rendered"] for r in render(df).orderBy("record_id").collect()] == [
        "### Instruction:\np\n\n### Response:\nc", "t"]


def test_shape_is_chosen_per_row(spark):
    df = spark.createDataFrame(
        [(1, "p", "c", None, None), (2, "p", None, "t", None), (3, None, None, None, "x")],
        "record_id int, prompt string, completion string, text string, other string")
    got = [(r["shape"], r["text"]) for r in coerce_shape(df).orderBy("record_id").collect()]
    assert got == [("pair", None), ("text", "t"), ("json", '{"other":"x"}')]
