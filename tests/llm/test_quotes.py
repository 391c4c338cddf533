"""Quote links on hand-made conversations; the plan stays native."""

import pytest

from tuneloom.llm import quotes

ROWS = "conv_id bigint, turn bigint, role string, text string, position int, piece string, depth int"


def link(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS).repartition(3)
    return {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}


def test_reply_links(spark):
    got = link(spark, [
        (1, 0, "a", "How is it?\nTell me more.\n\nThanks"),
        (1, 1, "b", "Other start"),
        (1, 4, "c", "On Monday a wrote:\n> how  IS it?\n> Tell me more.\nFine."),
        (1, 5, "a", ">> How is it?\n>> Tell me more.\n> Fine.\nGood."),
        (1, 7, "b", "> never said\nok"),
        (1, 9, "b", "> Tell me more.\nwhy"),
        (2, 0, "a", "> How is it?\nhm"),
        (2, 1, "a", None), (2, 2, "a", ""), (2, 3, "a", "> Thanks")])
    assert {k: v.reply_to for k, v in got.items()} == {
        (1, 0): None, (1, 1): 0, (1, 4): 0, (1, 5): 4, (1, 7): 5, (1, 9): 0,
        (2, 0): None, (2, 1): 0, (2, 2): 1, (2, 3): 2}
    assert [got[1, t].own_text for t in (4, 5, 9)] == ["Fine.", "Good.", "why"]
    assert got[1, 0].own_text == "How is it?\nTell me more.\n\nThanks"
    assert [(got[1, t].quotes, got[1, t].linked) for t in (4, 5, 7)] == [(1, 1), (2, 2), (1, 0)]
    assert [got[1, t].position for t in (0, 1, 4, 5, 7, 9)] == [0, 1, 2, 3, 4, 5]


def test_latest_earlier_original(spark):
    got = link(spark, [(1, 0, "a", "yes"), (1, 1, "b", "yes"), (1, 2, "c", "> yes\nyes"),
                       (1, 3, "d", "> yes"), (1, 4, "e", "yes")])
    assert (got[1, 2].reply_to, got[1, 3].reply_to, got[1, 1].reply_to) == (1, 2, 0)


def test_most_of_the_passage_decides(spark):
    got = link(spark, [(1, 0, "a", "one\ntwo\nthree"), (1, 1, "b", "three\nfour"),
                       (1, 2, "c", "> one\n> two\n> three\nso")])
    assert got[1, 2].reply_to == 0


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, 0, "a", "x", 0, "", 0), (1, None, "a", "> x", 0, "", 0),
                                (1, 0, None, "x", 0, "", 0), (1, 0, None, "x", 0, "", 0),
                                (1, 1, "a", "> x\n" + "y\n" * 30000, 0, "", 0)], ROWS)
    rows = quotes.link_quotes(df).collect()
    assert len(rows) == 5
    assert all(r.position is None and r.reply_to is None for r in rows
               if r.conv_id is None or r.turn is None)
    last = next(r for r in rows if r.turn == 1)
    assert (last.position, last.reply_to, last.linked) == (2, 0, 1)
    assert last.own_text == ("y\n" * 30000).strip()


def test_long_conversations(spark):
    rows = [(10 ** 12, t, "a", f"line {t}" + (f"\n> line {t - 3}" if t >= 3 else "")) for t in range(150)]
    got = link(spark, rows)
    assert all(got[10 ** 12, t].reply_to == (t - 3 if t >= 3 else t - 1 if t else None)
               and got[10 ** 12, t].position == t for t in range(150))


def test_nothing(spark):
    assert link(spark, []) == {}


@pytest.mark.parametrize("word", ["Python", "Arrow", "Pandas"])
def test_plan_is_native(spark, word):
    df = spark.createDataFrame([], ROWS)
    plan = quotes.link_quotes(df)._jdf.queryExecution().toString()
    assert word not in plan
