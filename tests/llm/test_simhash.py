"""Fingerprints and components against a comparison of all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tuneloom.llm import simhash
from tuneloom.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ")
             .replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or \
        ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest index reachable, by flooding."""
    seen = {}
    for start in range(len(prints)):
        if start in seen:
            continue
        open_ = [start]
        while open_:
            i = open_.pop()
            if i not in seen:
                seen[i] = start
                open_ += [j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3]
    return seen


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c", "Ä Äb ÄB c d",
                                  "x y z w q r", "the cat " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(simhash, "_STEP", 7)
    text = " ".join(str(i * i % 97) for i in range(100))
    assert simhash.fingerprint(text) == slow_print(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.integers(0, 31))
def test_words_one_bit_apart_share_an_anchor(word, bit):
    _, mine = simhash.anchors(np.array([word], np.uint64))
    _, other = simhash.anchors(np.array([word ^ 1 << bit], np.uint64))
    assert len(mine) <= 17 and set(mine.tolist()) & set(other.tolist())
    assert all((int(a) ^ word).bit_count() <= 2 for a in mine)


def near_prints(n, seed=5):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        value = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            value ^= 1 << rng.randrange(64)
        out.append(value)
    return sorted(set(out))


@pytest.mark.parametrize("chunk", [4096, 4])
def test_links_keep_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    prints = near_prints(160)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(3)
    links = [(r.a & 2 ** 64 - 1, r.b & 2 ** 64 - 1) for r in simhash.link_fingerprints(df).collect()]
    assert all(0 < (a ^ b).bit_count() for a, b in links)
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in links:
        a, b = sorted((root(at[a]), root(at[b])))
        parent[b] = a
    want = components(prints)
    assert {i: root(i) for i in range(len(prints))} == want


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + edges[:9] + [(None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 180)}
    assert connected_components(df.limit(0)).count() == 0


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base), (3, base.upper()), (9, base + " more"), (4, "something else entirely here"),
            (5, None), (6, ""), (8, " \t"), (None, base), (7, base), (12, "fully different words go")]
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [slow_print(t) for _, t in rows]
    ids = [i for i, _ in rows]
    found = components(prints)
    want = sorted((str(ids[i]), f"{p:016x}", min(x for j, x in enumerate(ids)
                  if found[j] == found[i] and x is not None)) for i, p in enumerate(prints))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_representatives(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, None), (None, ""), (2, "x y z q")]
    df = make(spark, rows).withColumn("root", df_lit("r")).withColumn("fp", df_lit("f"))
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    assert simhash.keep_representatives(df.limit(0)).count() == 0


def df_lit(value):
    from pyspark.sql import functions as F
    return F.lit(value)
