"""Differencing: balance, whole groups, gapless slots, and the same result level by level."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tuneloom.llm import shards

DOCS = "doc_id bigint, text string, shard int, slot string, size int"


def test_two_way_differencing_by_hand():
    # 8,7,6,5,4: 8-7, 6-5 leave 1 and 1 with 4; 4-1, 3-1 leave 2: 14 against 16
    sets = shards.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    loads = sorted(sum([8, 7, 6, 5, 4][i] for i, p in s if p == 0) for s in sets)
    assert loads == [14, 16]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=3, max_size=3), max_size=30))
def test_every_load_is_placed_once(parts):
    sets = shards.difference(parts)
    held = sorted(x for s in sets for x in s)
    assert held == [(i, p) for i in range(len(parts)) for p in range(3)]
    if parts:  # opposite orders never add a spread
        loads = [sum(parts[i][p] for i, p in s) for s in sets]
        assert max(loads) - min(loads) <= max(max(x) - min(x) for x in parts)


@pytest.mark.parametrize("bundles", [128, 12])
def test_balance(spark, monkeypatch, bundles):
    monkeypatch.setattr(shards, "BUNDLES", bundles)
    rng = random.Random(3)
    rows = [(f"g{i}", int(rng.paretovariate(1.2) * 100)) for i in range(700)]
    df = spark.createDataFrame(rows, "grp string, bytes bigint").repartition(5)
    got = shards.balance(df, 5).collect()
    assert sorted((r.grp, r.bytes) for r in got) == sorted(rows)
    loads = [sum(r.bytes for r in got if r.shard == s) for s in range(5)]
    assert max(loads) - min(loads) <= 2000 // bundles
    again = shards.balance(df.repartition(2), 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_a_group_larger_than_a_shard_stands_alone(spark):
    rows = [("hot", 60_000)] + [(f"g{i}", 100 + i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "grp string, bytes bigint").repartition(4)
    got = shards.balance(df, 5).collect()
    loads = {s: sum(r.bytes for r in got if r.shard == s) for s in range(5)}
    alone = next(r.shard for r in got if r.grp == "hot")
    assert loads.pop(alone) == 60_000
    assert max(loads.values()) - min(loads.values()) <= 20


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLOT_ROWS", 3)
    texts = ["alpha", "béta", "", None, "alpha", "alpha", "gamma " * 40, None, "delta"] * 6
    rows = [(i if i % 7 else None, f"{t}{i % 4}" if t and i % 2 else t, 9, "x", 1)
            for i, t in enumerate(texts)] + [(3, "same", 1, "x", 1)] * 4
    df = spark.createDataFrame(rows, DOCS)
    got = shards.shard_rows(df).collect()
    assert sorted((str(r.doc_id), r["size"], str(r.text_crc32)) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 8, str(None if t is None else zlib.crc32(t.encode())))
        for i, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert 0 <= s < 24
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(
            r.shard == s for r in got)))
    assert all(len({r.shard for r in got if r.grp == g}) == 1 for g in {r.grp for r in got})
    full = shards.sharded_documents(df)
    assert full.columns == ["doc_id", "text", "size", "shard", "slot"]
    placed = {(r.shard, r.slot): (r.doc_id, r["size"]) for r in got}
    found = full.collect()
    assert len(found) == len(rows) and all(
        placed[r.shard, r.slot] == (r.doc_id, len((r.text or "").encode()) + 8) for r in found)


def test_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert shards.shard_rows(df).count() == 0 and shards.sharded_documents(df).count() == 0


def test_rows_equal_in_id_and_text_keep_their_columns(spark):
    rows = [(1, "a b c", "en"), (1, "a b c", "de"), (1, "a b c", "de"), (2, "z", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `la.ng` string")
    out = shards.sharded_documents(df)
    assert out.columns == ["doc_id", "text", "la.ng", "shard", "slot"]
    found = out.collect()
    assert sorted(tuple(r)[:3] for r in found) == sorted(rows)
    assert len({(r.shard, r.slot) for r in found}) == 4


def test_rows_that_repeat_often_are_split(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLOT_ROWS", 50)
    df = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"),
                                  F.lit(None).cast("string").alias("text"))
    rows = shards.shard_rows(df).collect()
    assert len({r.shard for r in rows}) == 1  # one group
    assert sorted(r.slot for r in rows) == list(range(3000))
