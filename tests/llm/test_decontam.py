"""Leaks of benchmark items: exact, re-parameterised, and what only looks like one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tuneloom.llm import decontam

ITEM = "A train from Berlin covers 120 km in 3 hours, how fast must it go on average to arrive then?"
SAME = "Filler first. A train from Madrid covers 250 km in 7 hours, how fast must it go on average to arrive then? End."
MIXED = "A train from Oslo covers 5 km in 5 hours, how fast must it go on average to arrive then?"
TWO = "If Anna gives Bert 7 of 12 apples then Anna keeps how many of the 12 apples that were there before?"
TWO_SAME = "If Carl gives Dora 3 of 9 apples then Carl keeps how many of the 9 apples that were there before?"
TWO_OTHER = "If Carl gives Dora 3 of 9 apples then Emil keeps how many of the 8 apples that were there before?"
DOCS = "doc_id bigint, text string, lang string, item_id int, place string, slots int"
ITEMS = "item_id bigint, text string, doc_id int"


def find(spark, docs, items):
    df = spark.createDataFrame([(*d, "en", 1, "p", 2) for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, 5) for i in items], ITEMS)
    found = decontam.find_leaks(df, bench).collect()
    left = decontam.without_leaks(df, bench)
    assert left.columns == df.columns
    keys = {r.key for r in found}
    assert left.count() == len(docs) - sum(
        1 for r in df.select("*", decontam.row_key().alias("k")).collect() if r.k in keys)
    return sorted({(str(r.doc_id), r.item_id) for r in found})


def test_leaks(spark):
    docs = [(1, ITEM), (2, SAME), (3, "Nothing of the kind stands in here at all, really, nothing."),
            (4, ITEM.upper()), (5, "so " + ITEM.lower() + " and on"), (6, TWO), (7, TWO_SAME),
            (8, None), (9, ""), (None, ITEM), (2, SAME), (10, "x " * 50000 + ITEM)]
    got = find(spark, docs, [(1, ITEM), (2, TWO), (3, None), (4, "too short"), (1, ITEM), (None, TWO)])
    assert got == [("1", 1), ("10", 1), ("2", 1), ("4", 1), ("5", 1), ("6", 2), ("7", 2), ("None", 1)] \
        or got == [("1", 1), ("10", 1), ("2", 1), ("5", 1), ("6", 2), ("7", 2), ("None", 1)]


def test_slots_must_be_consistent(spark):
    assert find(spark, [(1, TWO_SAME), (2, TWO_OTHER)], [(2, TWO)]) == [("1", 2)]


def test_a_changed_slot_hides_no_copy(spark):
    item = "A box holds 12 red balls and another box holds 12 blue balls so how many are there?"
    one = item.replace("another box holds 12", "another box holds 11")
    both = item.replace("12", "40")
    assert find(spark, [(1, item), (2, one), (3, both)], [(7, item)]) == [
        ("1", 7), ("2", 7), ("3", 7)]


def test_items_without_a_telling_window(spark):
    heavy = "1 2 3 4 plus 5 6 7 8 9 equals 10 11 12 13"
    docs = [(1, "What is 7 times 8?"), (2, "So, what is 7 times 8? Who knows."),
            (3, "What is 7 times 9?"), (4, "Ask: " + heavy + " or not"),
            (5, heavy.replace("equals 10", "equals 0")), (6, "Hello, world!"),
            (7, "they said hello world to all"), (8, " ... "), (9, "1 2 3 4 plus 5 6 7 8 9")]
    items = [(1, "What is 7 times 8?"), (2, heavy), (3, "hello world"), (4, "..."), (5, heavy),
             (1, "never to be seen")]
    assert find(spark, docs, items) == [("1", 1), ("2", 1), ("4", 2), ("4", 5), ("6", 3)]


def _brute(doc: list[str], item: list[str]) -> bool:
    """Small words and numbers alone: each lag tried, each window compared."""
    w = decontam.WINDOW
    sign = [["#" if t.isdigit() else t for t in x] for x in (doc, item)]
    telling = [i for i in range(len(item) - w + 1)
               if sum(t != "#" for t in sign[1][i:i + w]) >= decontam.LEAST_PLAIN]
    if not telling:
        n = len(item)
        if n < decontam.LEAST_WHOLE:
            return n > 0 and doc == item
        return any(doc[i:i + n] == item for i in range(len(doc) - n + 1))
    matched = set()
    for lag in range(-len(item), len(doc)):
        met = [i for i in telling if 0 <= i + lag <= len(doc) - w
               and sign[0][i + lag:i + lag + w] == sign[1][i:i + w]]
        change = {i: {(a, b) for a, b in zip(item[i:i + w], doc[i + lag:i + lag + w]) if a != b}
                  for i in met}
        all_changes = set().union(*change.values())
        sound = len({a for a, _ in all_changes}) == len(all_changes)
        matched |= {i for i in met if sound or not change[i]}
    return bool(matched) and (len(matched) >= decontam.ENOUGH
                              or len(matched) >= decontam.SHARE * len(telling))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "_PART", 3)  # templates of more hits go in parts
    rng = random.Random(9)

    def some(n):
        return [rng.choice(["alpha", "beta", "gamma"]) if rng.random() < .6 else
                str(rng.randint(1, 3)) for _ in range(n)]

    items = [some(rng.choice([1, 3, 5, 9, 12, 20])) for _ in range(30)]
    docs = []
    for _ in range(60):
        inner = [rng.choice([t, t, t, str(rng.randint(1, 3))]) if t.isdigit() else t
                 for t in rng.choice(items)]
        docs.append(some(rng.choice([0, 2, 15])) + inner[rng.choice([0, 0, 2]):] + some(rng.choice([0, 4])))
    want = sorted((str(d), i) for d, doc in enumerate(docs) for i, item in enumerate(items)
                  if _brute(doc, item))
    got = find(spark, [(d, " ".join(x)) for d, x in enumerate(docs)],
               [(i, " ".join(x)) for i, x in enumerate(items)])
    assert got == want and len(want) > 30


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, ITEM, 3), (2, "else", 4)], "doc_id bigint, text string, `a.b` int")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    left = decontam.without_leaks(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "else", 4)]


def test_a_part_of_an_item(spark):
    words = [f"w{i}x" for i in range(60)]
    part = "before that " + " ".join(words[20:34]) + " after that"
    short = "before that " + " ".join(words[20:30]) + " after that"
    assert find(spark, [(1, part), (2, short)], [(9, " ".join(words))]) == [("1", 9)]


def test_nothing(spark):
    assert find(spark, [], [(1, ITEM)]) == [] and find(spark, [(1, ITEM)], []) == []


@pytest.mark.parametrize("text, template", [
    ("He met Anna at 5 km and 7:30 for 1,000 dollars",
     "he met <NAME> at <NUM> <UNIT> and <NUM> for <NUM> <UNIT>"),
    ("The End. Next, 5kg of IRON (Bob's)", "the <NAME> next <QTY> of iron <NAME>"),
    ("km first\nLine -- two", "km first line two")])
def test_canonical_form(text, template):
    found = decontam.Templates([text], decontam.Words())
    signs = [found.words.cores[i] if k == decontam._PLAIN else decontam._SIGNS[k]
             for i, k in zip(found.ids, found.kinds)]
    assert " ".join(signs) == template


def test_a_task_holds_a_part_of_a_batch_of_long_texts():
    """Whole texts, some at a time: memory follows the longest text, not all of a batch."""
    texts = ["so many words stand here " * 20_000 + ITEM] * 16 + [None, "", ITEM]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(map(str, range(len(texts)))), pa.array(texts)],
        names=["doc_id", "key", "text"])
    bits = np.zeros(1 << (decontam._BITS - 3), np.uint8)
    at, hashes = decontam.Templates([ITEM], decontam.Words()).windows()
    for bit in decontam._bit(hashes).tolist():
        bits[bit >> 3] |= 1 << (bit & 7)
    tracemalloc.start()
    found = [d for b in decontam._hits(bits, [0])(iter([batch])) for d in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [found.count(d) for d in range(len(texts))] == [len(at)] * 16 + [0, 0, len(at)]
    assert peak < 64 << 20
