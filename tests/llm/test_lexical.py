"""Ranked search against a plain evaluation of the formula for every pair."""

import math
import random
import re
from collections import Counter

import pytest

from tuneloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain(docs, items, top=20):
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            n = sum(c.values())
            m = 100 - 25 + 25 * n * n_docs // total
            score = 0
            for t in cut(text):
                if c[t]:
                    df = sum(1 for _, other in held if other[t])
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs],
                              "doc_id bigint, text string, n bigint, `a.b` string").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, term string")
    out = lexical.search(d, i, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed, chars", [(1, 1 << 18), (2, 300)])
def test_random_texts(spark, seed, chars):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ÄPFEL", "äpfel", "7", "a1b", "x_y", "nord", "süd", "日本"]
    text = lambda most: " ".join(rng.choices(words + [f"w{k}" for k in range(30)],
                                             k=rng.randrange(most)))
    docs = [(i, text(60)) for i in range(90)]
    docs += [(200 + i, docs[i % 7][1]) for i in range(30)]
    items = [(i, text(25)) for i in range(15)]
    assert run(spark, docs, items, item_chars=chars) == plain(docs, items)


def test_nulls_empties_repeats(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (None, "red fox"), (5, "red fox"), (5, "red fox"),
            (4, "red fox"), (6, "blue " * 3000 + "cat"), (7, "blue")]
    items = [(1, "red red red"), (2, None), (3, "--"), (4, "blue cat"), (4, "blue cat"), (None, "fox")]
    assert run(spark, docs, items) == plain(docs, [*items[:4], items[5]])


def test_top_cuts_ties_by_id(spark):
    docs = [(i, "same words here") for i in range(50)] + [(99, "other")] * 60
    found = run(spark, docs, [(1, "here")], top=3)
    assert [r[2] for r in found] == [0, 1, 2]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []


def test_plan_shares_sets_of_terms():
    items = [b"a b c d", b"a b c e", b"x a b c", b"b b b q", b"b b b r", b"long " + b" ".join(
        b"u%d" % i for i in range(1000))]
    plan = lexical.Plan(items)
    made = {i: {i: 1} for i in range(len(plan.term))}
    for i, (a, b) in enumerate(plan.sums, len(plan.term)):
        made[i] = dict(Counter(made[a]) + Counter(made[b]))
    for text, parts in zip(items, plan.parts):
        total = Counter()
        for part in parts:
            for unit, n in made[part].items():
                total[plan.term[unit]] += n << plan.shift[unit][0]
        assert total == Counter(plan.vocabulary[t] for t in lexical.terms(text))
    assert len(plan.parts[0]) == len(plan.parts[1]) == len(plan.parts[2]) == 2
    assert sum(map(len, plan.parts)) < sum(len(set(lexical.terms(t))) for t in items)
