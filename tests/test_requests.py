import json
import sys

import numpy as np
import pytest
from engines import EchoEngine
from pyspark import cloudpickle

from tuneloom.operators import chat
from tuneloom.operators import generate as G
from tuneloom.operators import requests as Q
from tuneloom.streaming.requests import answer_requests

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def asked(spark, *rows):
    return spark.createDataFrame([(f"r{i}", route, body) for i, (route, body) in enumerate(rows)],
                                 "request_id string, route string, body string")


CHAT, PLAIN = "/v1/chat/completions", "/v1/completions"


def parsed(spark, route, body, **options):
    return Q.parse_requests(asked(spark, (route, body)), **options).first()


@pytest.mark.parametrize("body", ["", None, "{}"])
def test_defaults(spark, body):
    r = parsed(spark, PLAIN, body)
    assert (r["prompt"], r["max_tokens"], r["temperature"], r["stream"]) == ("", 128, 0.7, False)
    assert parsed(spark, CHAT, body)["prompt"] == "\nassistant:"
    assert parsed(spark, CHAT, body, chat_style="plain")["prompt"] == ""


def test_values(spark):
    r = parsed(spark, PLAIN, '{"prompt":"p","max_tokens":"12","temperature":1,"stream":true}')
    assert (r["prompt"], r["max_tokens"], r["temperature"], r["stream"]) == ("p", 12, 1.0, True)
    assert parsed(spark, PLAIN, '{"max_tokens":12.9}')["max_tokens"] == 12


@pytest.mark.parametrize("body", ["{", "[1]x", '{"max_tokens":"x"}', '{"temperature":"hot"}',
                                  '{"messages":"no list"}'])
def test_a_bad_body_fails_alone(spark, body):
    df = Q.parse_requests(asked(spark, (PLAIN, body), (PLAIN, "{}"), ("/v1/models", body)))
    assert [r["request_id"] for r in Q.accepted(df).collect()] == ["r1"]
    assert {(r["request_id"], r["reason"], r["status"]) for r in Q.rejected(df).collect()} == {
        ("r0", "bad request", 400), ("r2", "unknown route", 404)}


@pytest.mark.parametrize("value, stream", [("1", True), ("0", False), ('"x"', True), ("null", False),
                                           ('""', False), ("true", True), ("false", False)])
def test_truthy_stream(spark, value, stream):
    r = parsed(spark, PLAIN, f'{{"stream":{value}}}')
    assert (r["reason"], r["stream"]) == (None, stream)


def test_unknown_routes_are_split_off(spark):
    df = Q.parse_requests(asked(spark, ("/v1/models", "{}"), (PLAIN, "{}"), (None, "{}")))
    assert [r["request_id"] for r in Q.accepted(df).collect()] == ["r1"]
    assert {(r["request_id"], r["status"]) for r in Q.rejected(df).collect()} == {
        ("r0", 404), ("r2", 404)}


def test_chat_styles(spark):
    one, two = [("user", "hi")], [("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame([(1, one), (2, two)],
                               "id int, messages array<struct<role:string,content:string>>")
    plain = [r["rendered"] for r in chat.render_chat(df).orderBy("id").collect()]
    assert plain == ["user: hi", "user: hi\nassistant: yo"]
    instruct = [r["rendered"] for r in chat.render_chat(df, "instruct").orderBy("id").collect()]
    assert instruct == ["### Instruction:\nhi\n\n### Response:\n",
                        "user: hi\nassistant: yo\nassistant:"]
    with pytest.raises(ValueError):
        chat.render_chat(df, "other")


class RecordingEngine(EchoEngine):
    """Answers with its slice's size, wish and temperature, and checks the padding."""

    def generate(self, ids, mask, max_new, temperature):
        assert len(ids) <= 8 and ids.shape == mask.shape
        assert all((np.diff(row) >= 0).all() for row in mask), "padding is on the left"
        return [[self.encode(w)[0] for w in
                 f"{len(ids)} {max_new} {temperature}".split()] for _ in ids]


def test_slices_have_one_temperature_and_at_most_eight_rows(spark):
    rows = [(f"r{i}", "w " * (i % 7), 3 + i % 4, 0.0 if i % 10 else 0.7) for i in range(203)]
    df = spark.createDataFrame(rows, "request_id string, prompt string, max_tokens int, "
                                     "temperature double")
    got = {r["request_id"]: r["text"] for r in
           G.batch_generate(df, RecordingEngine, partitions=1).collect()}
    assert len(got) == 203
    cold = [got[r[0]].split() for r in rows if r[3] == 0.0]
    assert {c[2] for c in cold} == {"0.0"}
    # one partition: full slices but for the rest of each temperature
    assert sum(c[0] == "8" for c in cold) == len(cold) // 8 * 8


@pytest.mark.parametrize("arrow_rows", [5, 10_000])
@pytest.mark.parametrize("partitions", [1, 4])
def test_each_request_gets_its_own_share(spark, partitions, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    rows = [(f"r{i}", f"a{i} b c d", i % 5, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id string, prompt string, max_tokens int, "
                                     "temperature double")
    got = G.batch_generate(df, EchoEngine, partitions=partitions, max_len=3)
    want = {r[0]: " ".join(r[1].split()[:3][:r[2]]) for r in rows}
    assert {r["request_id"]: r["text"] for r in got.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_evaluation_is_greedy_and_short(spark):
    df = spark.createDataFrame([(1, " ".join("abcdefghij"), "a")],
                               "seq bigint, prompt string, gold string")
    r = G.generate_answers(df, EchoEngine).first()
    assert r["raw"] == "a b c d e f g h" and r["gold"] == "a"


def test_documents(spark):
    df = asked(spark, (CHAT, '{"messages":[{"role":"user","content":"a b"}],"max_tokens":4}'),
               (PLAIN, '{"prompt":"x \\"y\\"","max_tokens":9}'))
    got = {r["request_id"]: json.loads(r["response"]) for r in
           answer_requests(df, EchoEngine, "m", created=5).collect()}
    c, p = got["r0"], got["r1"]
    assert c["object"] == "chat.completion" and c["id"].startswith("chatcmpl-")
    assert c["choices"] == [{"index": 0, "finish_reason": "stop", "message": {
        "role": "assistant", "content": "### Instruction: a b"}}]
    assert c["usage"] == {"completion_tokens": 4} and (c["created"], c["model"]) == (5, "m")
    assert p["choices"] == [{"index": 0, "text": 'x "y"', "finish_reason": "stop"}]
    assert p["object"] == "text_completion" and "usage" not in p and len(p["id"]) == 13
    again = answer_requests(df, EchoEngine, "m", created=5).collect()
    assert {json.loads(r["response"])["id"] for r in again} == {c["id"], p["id"]}
