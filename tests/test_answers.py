"""Requests answered from a table of next words."""

import json
import random

from tuneloom.operators import generate as G
from tuneloom.plans.catalog import response_envelope
from tuneloom.streaming.requests import answer_requests

PLAIN = "/v1/completions"


def table(spark, *texts):
    return G.learn_successors(spark.createDataFrame([(t,) for t in texts], "text string"))


def asks(spark, rows):
    return spark.createDataFrame(rows, "request_id string, prompt string, max_tokens int, "
                                       "temperature double")


def said(nexts, prompt, wish):
    """The walk by hand."""
    at, out = next((w for w in reversed((prompt or "").split()) if w in nexts), None), []
    while at in nexts and len(out) < wish:
        at = nexts[at]
        out.append(at)
    return " ".join(out)


def test_most_frequent_next_word(spark):
    got = table(spark, "a b a c a b", "b c", "b c", "a", None, "")
    assert {(r["word"], r["next"]) for r in got.collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    tied = table(spark, "x z x y")  # a tie goes to the smaller word, however often x is there
    assert {(r["word"], r["next"]) for r in tied.collect()} == {("x", "y"), ("z", "x")}


def test_walks_of_any_length(spark):
    """Every wish up to beyond the chain's end, also on a circle."""
    chain = " ".join(f"w{i}" for i in range(20))
    model = table(spark, chain, "p q p")
    nexts = {r["word"]: r["next"] for r in model.collect()}
    rows = [(f"{p}{n}", f"{p} unknown", n, 0.0) for p in ("w0", "w5", "w18", "w19", "q")
            for n in [-1, *range(24), 67]]
    got = {r["request_id"]: r["text"] for r in G.batch_generate(asks(spark, rows), model).collect()}
    assert got == {key: said(nexts, prompt, n) for key, prompt, n, _ in rows}
    assert got["q67"] == "p q " * 33 + "p" and got["w1823"] == "w19" and got["w195"] == ""


def test_as_by_hand_on_random_texts(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randrange(9)))
             for _ in range(60)]
    model = table(spark, *texts)
    nexts = {r["word"]: r["next"] for r in model.collect()}
    # keys repeat or are null, equal rows come twice
    rows = [(rng.choice(["r", "s", None]), rng.choice([*texts, None, "", "?"]), rng.randrange(12), 0.5)
            for _ in range(150)]
    got = G.batch_generate(asks(spark, rows + rows[:20]), model).collect()
    key = lambda r: (r[0] or "-", r[1] or "-", r[1] is None, r[2], r[-1])
    assert sorted(map(tuple, got), key=key) == sorted(
        ((*r, said(nexts, r[1], r[2])) for r in rows + rows[:20]), key=key)


def test_no_wishes_and_no_table(spark):
    assert G.batch_generate(asks(spark, []), table(spark, "a b")).count() == 0
    got = G.batch_generate(asks(spark, [("r", "a", 3, 0.0)]), table(spark, "a")).collect()
    assert [r["text"] for r in got] == [""]


def test_neither_words_nor_prompts_are_cut(spark):
    """More words than a table of 4,096, and the only known one behind 2,048 others."""
    model = table(spark, *[f"u{i} v{i}" for i in range(5000)])
    assert model.count() == 5000
    rows = [("far", "? " * 3000 + "u4999", 4, 0.0), ("early", "u7 " + "? " * 3000, 4, 0.0)]
    got = {r["request_id"]: r["text"] for r in G.batch_generate(asks(spark, rows), model).collect()}
    assert got == {"far": "v4999", "early": "v7"}


def test_documents_hold_what_was_asked_for(spark):
    requests = spark.createDataFrame(
        [("a", PLAIN, '{"prompt":"so a","max_tokens":2}'), ("b", PLAIN, '{"prompt":"a"}'),
         ("c", "/v1/chat/completions", '{"messages":[{"role":"user","content":"b"}],"max_tokens":1}'),
         ("d", "/other", "{}")], "request_id string, route string, body string")
    got = {r["request_id"]: json.loads(r["response"]) for r in
           answer_requests(requests, table(spark, "a b c d"), "m", created=5).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["choices"][0]["text"] == "b c" and got["b"]["choices"][0]["text"] == "b c d"
    assert got["c"]["choices"][0]["message"]["content"] == "c"
    assert got["c"]["usage"] == {"completion_tokens": 1}


def test_query_answers_the_prompts(spark, tmp_path):
    """Answers go on from the prompt with the words of all conversations, as long as asked for."""
    turns = [(1, 0, "user", "one two"), (1, 1, "assistant", "two three"), (1, 2, "user", "hey two"),
             (4, 0, "user", "three four"), (4, 1, "assistant", "nothing"),
             (10, 0, "user", "four one"), (10, 1, "assistant", "so four")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r["request_id"]: (r["answer"], r["completion_tokens"])
           for r in response_envelope(spark, str(tmp_path)).collect()}
    # conversation 1 has a broken body; 4 asks for five words, 10 for eleven and is no chat
    assert got == {"r4": ("one two three four one", 5),
                   "r10": ("one two three four one two three four one two three", None)}
