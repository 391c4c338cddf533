"""Near copies against a comparison of all pairs."""

import random

import corpus_pipeline
import pytest

from tuneloom.llm import copies, overlap, simhash

DOCS = "doc_id bigint, text string, id int, h string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(left, right):
    return bool(left) and 5 * len(left & right) >= 4 * len(left | right)


def first_of_groups(rows):
    """The smallest id of everything that hangs together by near copies."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if root[j] < root[i] and near(sets[i], sets[j]):
                    root[i], changed = root[j], True
    return sorted(i for i in sets if root[i] == i)


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("short", [32, 2])
def test_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(overlap, "SHORT", short)
    rng = random.Random(3)
    bases = [" ".join(f"w{rng.randrange(4000)}" for _ in range(n)) for n in (30, 90, 200)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, edited(rng, bases[i % 3], rng.randrange(7))) for i in range(60)]
    rows += [(100 + i, f"{passage} {' '.join(f'q{rng.randrange(9999)}' for _ in range(30))}")
             for i in range(12)]
    rows += [(200, None), (201, ""), (202, "two words"), (203, "Two  WORDS"), (204, "a b c d e")]
    kept = copies.without_copies(make(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "h"]
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) < len(rows) and sorted(ids) == first_of_groups(rows)


def test_ids_that_repeat_or_miss(spark):
    text = " ".join(f"w{i}" for i in range(50))
    kept = copies.without_copies(make(spark, [(None, text), (4, text + " x"), (4, text), (9, "z")]))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 9]
    assert copies.without_copies(make(spark, [])).count() == 0


def test_stage_finds_copies_beyond_three_bits(spark, tmp_path):
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(60))
    far = next(t for t in (edited(rng, base, 1) for _ in range(200))
               if (simhash.fingerprint(t) ^ simhash.fingerprint(base)).bit_count() > 3)
    docs = spark.createDataFrame([(100, base, "s"), (101, far, "s"), (102, base[:80], "s")],
                                 "doc_id bigint, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [100, 102]


def test_stage_removes_the_planted_copy(spark, tmp_path):
    """Document 101 of test_pipeline: a text of the corpus with a word more."""
    text = " ".join(f"{w}{k % 7}x" for k, w in enumerate("der hund und die katze gehen".split() * 8))
    docs = spark.createDataFrame([(3, text, "s"), (101, text + " x", "s")],
                                 "doc_id bigint, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [3]
