import random

import pytest

from tuneloom.constants import TASKS, Task
from tuneloom.operators import evalset as E
from tuneloom.operators import scoring as S


def vocabulary(spark, labels):
    return spark.createDataFrame([(x,) for x in labels], "label string")


def matched(spark, answers, labels):
    df = spark.createDataFrame(list(enumerate(answers)), "seq bigint, raw string")
    both = []
    for most in (S.AUTOMATON_LABELS, -1):  # in one pass over the answers, and by a join
        got = S.match_labels(df, vocabulary(spark, labels), automaton_labels=most).collect()
        assert len(got) == len(answers)
        both.append([p for _, p in sorted((r["seq"], r["pred"]) for r in got)])
    assert both[0] == both[1]
    return both[0]


NESTED = ["card not working", "virtual card not working", "top", "joy"]


@pytest.mark.parametrize("answer, label", [
    ("virtual card-not working", "virtual card not working"),   # the longer one covers the other
    ("Card_Not_Working.", "card not working"),                  # case, signs and marks
    ("card   not\tworking", "card not working"),                # runs of white space
    ("joy and top", None),                                      # two labels
    ("virtual card not working or joy", None),
    ("card not working, virtual card not working", "virtual card not working"),
    ("JOYFUL", "joy"),                                          # a part of a word will do
    ("", None), ("nothing", None), (None, None),
    ("é joy" * 50, "joy"),
])
def test_match(spark, answer, label):
    assert matched(spark, [answer, answer], NESTED) == [label, label]


def test_match_without_labels(spark):
    assert matched(spark, ["joy", ""], []) == [None, None]


def test_labels_of_one_normal_form_cancel_each_other(spark):
    labels = ["a_b", "a-b", "b", "c"]
    # "b" is covered by both, "c" stands beside them
    assert matched(spark, ["a b", "b", "a b c", "c"], labels) == [None, "b", "c", "c"]


def test_a_label_without_letters_is_in_every_answer(spark):
    assert matched(spark, ["", "zzz", "joy"], ["_", "joy"]) == ["_", "_", "joy"]


def test_a_large_vocabulary(spark):
    """Numbered labels nest in each other: the answer names the longest number it holds."""
    labels = [f"intent {i}" for i in range(1500)]
    answers = [f"it is Intent-{i}!" for i in (3, 14, 141, 1411, 1499)] + ["intent", "intent 1500"]
    assert matched(spark, answers, labels) == [
        "intent 3", "intent 14", "intent 141", "intent 1411", "intent 1499", None, "intent 150"]


def brute_label(answer, labels):
    norms = {}
    for label in labels:
        norms.setdefault(label.lower().strip(), []).append(label)
    held = [n for n in norms if n in answer.lower().strip()]
    top = [norms[n][0] for n in held if len(norms[n]) == 1
           and not any(n != m and n in m for m in held)]
    return top[0] if len(top) == 1 else None


def test_random_labels_against_every_label(spark):
    rng = random.Random(5)

    def word(most):
        return "".join(rng.choice("abCé") for _ in range(rng.randint(1, most)))

    labels = list({word(5) for _ in range(40)})
    answers = [word(9) for _ in range(150)] + ["ab" * 5000]
    assert matched(spark, answers, labels) == [brute_label(a, labels) for a in answers]


def test_the_automaton_moves_no_row(spark):
    df = spark.createDataFrame([(1, "joy", 5)], "seq bigint, raw string, label int")
    got = S.match_labels(df, vocabulary(spark, ["joy", None]))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["seq", "raw", "label", "pred"] and got.first()["pred"] == "joy"


def test_ambiguous_labels(spark):
    assert [r["norm"] for r in S.ambiguous_labels(vocabulary(
        spark, ["a_b", "a-b", "top", "_"])).collect()] == ["a b"]


def preds(spark):
    rows = [("r", i, "a" if i % 3 else "b", None if i % 5 == 0 else "a") for i in range(1, 121)]
    return rows, spark.createDataFrame(rows, "run_id string, seq bigint, gold string, pred string")


def test_evaluate(spark):
    rows, df = preds(spark)
    r = S.evaluate(df.selectExpr("*", "0.5D s"), seconds="s").first()
    correct = sum(g == p for _, _, g, p in rows)
    assert (r["n"], r["correct"], r["unparseable"]) == (120, correct, 24)
    assert r["accuracy"] == correct / 120 and r["majority_baseline"] == 80 / 120
    assert r["examples_per_s"] == 2.0
    assert S.evaluate(df).first()["seconds"] is None


def test_distribution_keeps_missing_predictions(spark):
    _, df = preds(spark)
    dist = S.prediction_distribution(df)
    assert {r["pred"]: r["n"] for r in dist.collect()} == {None: 24, "a": 96}
    assert S.counter_map(dist, ["run_id"], "pred").first()["counts"] == {"<none>": 24, "a": 96}


@pytest.mark.parametrize("shard_rows", [16, 1 << 18])
def test_running_accuracy(spark, shard_rows):
    rows, df = preds(spark)
    got = {r["i"]: r["accuracy"] for r in
           S.running_accuracy(df.repartition(3), 50, shard_rows).collect()}
    assert got == {i: sum(g == p for _, _, g, p in rows[:i]) / i for i in (50, 100)}


def test_predictions_keep_a_preview(spark):
    df = spark.createDataFrame([("r", 1, "a", None, "x" * 200)],
                               "run_id string, seq int, gold string, pred string, raw string")
    assert len(S.predictions(df).first()["raw"]) == 80


def test_compare_runs(spark):
    df = spark.createDataFrame(
        [("m", "t", "base", 0.2, 0.37), ("m", "t", "fine-tuned", 0.7, 0.37),
         ("n", "t", "base", 0.5, 0.37)],
        "model string, task string, tag string, accuracy double, majority_baseline double")
    got = {r["model"]: r for r in S.compare_runs(df).collect()}
    assert got["m"]["gain"] == pytest.approx(0.5)
    assert got["m"]["base_below_majority"] and not got["m"]["tuned_below_majority"]
    assert got["n"]["tuned"] is None and got["n"]["gain"] is None


def test_empty_is_refused(spark):
    _, df = preds(spark)
    with pytest.raises(ValueError):
        S.require_rows(df.where("false"), "test set")
    with pytest.raises(Exception, match="no rows to score"):
        E.majority_baseline(df.where("false")).collect()


# --- tasks ---------------------------------------------------------------------

LISTED = Task("t", "src", "train", "test", "text", "One of: {labels}.\nText: {text}\nEnd",
              labels=("no", "yes"))
NAMED = Task("t", "src", "train", "test", "text", "{labels}\n{text}", label_text_key="name")


def task_rows(spark):
    return spark.createDataFrame(
        [(i, f" {{labels}} text{i}  \n", i % 2, ["b", "a"][i % 2]) for i in range(30)],
        "seq bigint, text string, label int, name string")


def test_build_task(spark):
    rows = task_rows(spark)
    built = E.build_task(rows, rows, LISTED, n_train=20, n_test=100, seed=1)
    train, test = built.where("split = 'train'").collect(), built.where("split = 'test'").collect()
    assert (len(train), len(test)) == (20, 30)
    first = {r["seq"]: r for r in test}[3]
    assert first["prompt"] == "One of: no, yes.\nText: {labels} text3\nEnd"
    assert (first["gold"], first["completion"]) == ("yes", None)
    assert {r["completion"] for r in train} == {"no", "yes"}


def test_label_column(spark):
    rows = task_rows(spark)
    built = E.build_task(rows, rows, NAMED, n_train=1, n_test=1)
    assert all(r["prompt"].startswith("- a\n- b\n") for r in built.collect())


@pytest.mark.parametrize("label", [-1, 2, None])
def test_label_index_must_exist(spark, label):
    df = spark.createDataFrame([(label,)], "label int")
    with pytest.raises(Exception, match="label index out of range"):
        df.select(E.task_label(df, LISTED)).collect()


def test_vocabulary_and_distribution(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "gold string")
    assert sorted(r["label"] for r in E.label_vocabulary(df).collect()) == ["a", "b"]
    assert {r["label"]: r["n"] for r in E.label_distribution(df).collect()} == {"a": 1, "b": 2}
    r = E.majority_baseline(df).first()
    assert (r["n"], r["majority_n"], r["majority_baseline"]) == (3, 2, 2 / 3)


@pytest.mark.parametrize("name", sorted(TASKS))
def test_task_table(name):
    task = TASKS[name]
    assert task.template.count("{text}") == 1
    assert (task.labels is None) == (task.label_text_key is not None)
