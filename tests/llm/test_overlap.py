"""The similarity join against a comparison of all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from tuneloom.llm import overlap


def shingles(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def plain(docs, width=4, least=Fraction(17, 20)):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * least.denominator >= len(a | b) * least.numerator:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return sorted(((d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(
        zip(docs, sets))), key=str)


def run(spark, docs, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs],
                                  "doc_id bigint, text string, n int, `h.x` string").repartition(3)
    out = overlap.near_classes(frame, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()),
                  key=str)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits if words else 0):
        at = rng.randrange(max(1, len(words)))
        words[at:at + 1] = rng.choice([[f"e{rng.randrange(10 ** 6)}"], [], [*words[at:at + 1], "x"]])
    return " ".join(words)


def corpus(seed):
    """Chains and groups of near copies, common passages, short texts, chance shingles."""
    rng = random.Random(seed)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 40, 90, 300]))]
        if rng.random() < 0.4:
            words += passage.split()
        text = " ".join(words)
        for _ in range(rng.choice([1, 2, 5, 20])):
            rows.append(text)
            text = edited(rng, text, rng.choice([0, 1, 1, 2, 3]))
    hot = " ".join(f"h{rng.randrange(10 ** 6)}" for _ in range(80))
    rows += [edited(rng, hot, rng.randrange(3)) for _ in range(60)]
    rows += [f"{passage} {i}" for i in range(10)]
    rows += [" ".join(rng.choices("a b c".split(), k=rng.randrange(1, 12))) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, cell", [(1, 1 << 20), (2, 1 << 20), (3, 900)])
def test_all_pairs(spark, seed, cell):
    docs = corpus(seed)
    assert run(spark, docs, cell=cell) == plain(docs)


def test_other_width_and_share(spark):
    docs = corpus(4)
    assert run(spark, docs, width=5, least=Fraction(4, 5)) == plain(docs, 5, Fraction(4, 5))


def test_nulls_empties_repeats(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (None, "One two three"), (9, "one  two\nthree"),
            (9, "one  two\nthree"), (8, "one two"), (7, "one two three"), (None, "only null"),
            (5, "ÄPFEL und Birnen"), (6, "äpfel und birnen"), (4, "x " * 5000), (10, "x " * 6000)]
    assert run(spark, docs) == plain(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_divide_skip_finds_all_links():
    rng = random.Random(5)
    for _ in range(30):
        base = [rng.sample(range(400), rng.randrange(1, 80)) for _ in range(6)]
        sets = []
        for _ in range(40):
            own = set(rng.choice(base))
            for _ in range(rng.randrange(6)):
                own.add(rng.randrange(400)) if rng.random() < 0.5 or len(own) < 2 else own.pop()
            sets.append(np.array(sorted(own)))
        sets.sort(key=len, reverse=True)
        asks = np.array([rng.random() < 0.6 for _ in sets])
        offered = np.array([rng.random() < 0.7 for _ in sets])
        links = overlap.divide_skip(sets, asks, overlap.LEAST, offered)
        want = [(i, j) for i in range(40) for j in range(i) if (asks[i] or asks[j]) and (
            offered[i] or offered[j]) and 20 * len(set(sets[i]) & set(sets[j])) >= 17 * len(
                set(sets[i]) | set(sets[j]))]
        assert set(links) <= set(want)
        assert classes(40, links) == classes(40, want)


def classes(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(label)]
