"""Shards of near-equal bytes for groups that must stay together, by Karmarkar-Karp differencing.

A partial partition is a tuple of as many loads as there are shards. The two partial partitions
of largest spread are combined in opposite orders, the largest load of one with the smallest of
the other, until one is left.

Groups that are large against a shard are differenced one by one, and there are few of them:
less than ``BUNDLES`` a shard. All others are drawn by hash into as many bundles, which are
differenced as one group each. So whatever the number of groups, at most twice ``BUNDLES`` loads
a shard are combined, a group that fills a shard alone leaves the rest evenly to the others,
and rows only take a hash and a look-up in a table of that fixed size.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.common import block_of, blocks_for, named, row_hash, row_key, text_key
from tuneloom.session import stage_table

SHARDS = 24
#: Bundles of small groups per shard; a larger group than one of them stands alone.
BUNDLES = 128
#: Rows of a shard that one task numbers.
SLOT_ROWS = 4096


def difference(parts: list[list[int]]) -> list[list[tuple[int, int]]]:
    """Combine partial partitions; for every shard what it holds, as (part, place in the part).

    Ties go to the part that came first. Shards are in falling order of load.
    """
    if not parts:
        return []
    tick = count()
    heap = []
    for i, loads in enumerate(parts):
        rows = sorted(((load, (i, p)) for p, load in enumerate(loads)), key=lambda r: (-r[0], r[1]))
        heap.append((rows[-1][0] - rows[0][0], next(tick), rows))
    heapq.heapify(heap)
    while len(heap) > 1:
        rows = heapq.heappop(heap)[2]
        other = heapq.heappop(heap)[2]
        both = [(a + b, (x, y)) for (a, x), (b, y) in zip(rows, reversed(other), strict=True)]
        both.sort(key=lambda r: -r[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], next(tick), both))
    return [_leaves(tree) for _, tree in heap[0][2]]


def _leaves(tree: tuple) -> list[tuple[int, int]]:
    found, open_ = [], [tree]
    while open_:
        a, b = open_.pop()
        if isinstance(a, int):
            found.append((a, b))
        else:
            open_ += [a, b]
    return found


def _differenced(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "item"], ascending=[False, True]).reset_index(drop=True)
        loads = [[int(x)] + [0] * (shards - 1) for x in rows["bytes"]]
        place = [0] * len(rows)
        for shard, held in enumerate(difference(loads)):
            for i, p in held:
                if p == 0:
                    place[i] = shard
        return rows.assign(shard=place)[["item", "shard"]]
    return run


def balance(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``grp, bytes, shard`` for groups (``grp`` unique, ``bytes``) of any number."""
    bundles = shards * BUNDLES
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes").cast("decimal(38,0)") * bundles > F.lit(total).cast("decimal(38,0)")
    items = groups.select("grp", "bytes", F.when(large, F.concat(F.lit("g"), "grp")).otherwise(
        F.concat(F.lit("b"), block_of(bundles, "grp").cast("string"))).alias("item"))
    loads = items.groupBy("item").agg(F.sum("bytes").alias("bytes"))
    placed = stage_table(
        loads.groupBy(F.lit(0).alias("all")).applyInPandas(
            _differenced(shards), "item string, shard int"), "differenced")
    # at most twice the bundles
    return items.join(F.broadcast(placed), "item").select("grp", "bytes", "shard")


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, key, hash, grp, size, text_crc32, shard, slot`` of every row, groups being equal
    texts and ``hash`` that of the whole row.

    ``size`` is the bytes of the text plus 8; a null text has none and no crc, and all null
    texts are one group. Slots number the rows of a shard from 0 without gaps, by hash block,
    id, text and the hash of the whole row; every row has its own slot, repeated rows too. An
    empty table gives an empty result.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id", row_key().alias("key"), text_key(text).alias("grp"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), row_hash(docs).alias("hash"),
        F.monotonically_increasing_id().alias("number"))
    rows = stage_table(rows, "sizes")
    groups = stage_table(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "groups")
    placed = stage_table(balance(groups, shards).select("grp", "shard"), "shards")
    subs = blocks_for(rows.count(), shards * SLOT_ROWS)
    # what repeats more often than a block may hold is spread over blocks
    often = stage_table(rows.groupBy("key").agg(F.count("*").alias("times"))
                        .where(F.col("times") > SLOT_ROWS), "repeated")
    spread = F.pmod("number", F.ceil(F.col("times") / SLOT_ROWS))
    found = (rows.join(placed, "grp").join(often, "key", "left")
             .withColumn("sub", F.when(F.col("times").isNull(), block_of(subs, "key")).otherwise(
                 F.pmod(F.xxhash64("key", spread), F.lit(subs))))
             .drop("times"))
    found = stage_table(found, "sharded")
    before = (Window.partitionBy("shard").orderBy("sub")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = stage_table(
        found.groupBy("shard", "sub").agg(F.count("*").alias("n"))
        .select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
        "slots")
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(
        "doc_id", "key", "hash", "number"))
    return (found.withColumn("at", within).join(starts, ["shard", "sub"])
            .withColumn("slot", (F.col("start") + F.col("at") - 1).cast("bigint"))
            .select("doc_id", "key", "hash", "grp", "size", "text_crc32", "shard", "slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of the documents with its ``shard`` and ``slot``; a table's own columns of these
    names go."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    slots = shard_rows(docs, shards).select("key", "hash", "shard", "slot")
    rows = docs.select(F.struct(*map(named, kept)).alias("row"), row_key().alias("key"),
                       row_hash(docs).alias("hash")).dropDuplicates(["key", "hash"])
    # rows of one key and hash are the same in all columns, and take its slots in any order
    return rows.join(slots, ["key", "hash"]).select("row.*", "shard", "slot")
