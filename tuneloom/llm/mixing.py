"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target, in words, over its size gives the rate at which each of its documents is
taken. The whole part of the rate is taken of every document; the fraction is an inclusion
probability. The flight phase moves these probabilities, three documents at a time, along the
null space of the balancing constraints (words and documents): the expected totals stay as
they are and one probability at least becomes 0 or 1. It runs block by block, each of a
bounded number of rows that depends on the ids only, and leaves two open documents a block;
these are gathered into blocks again until one block a source is left. The landing drops the
constraint on documents: the last two move along the words alone, and the last document is
taken in part, so that the words taken meet the target to a word.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm import common
from tuneloom.llm.common import row_hash, row_key, whole_row, word_count
from tuneloom.operators.ranks import dense_seq
from tuneloom.session import stage_table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 2048
#: Blocks whose open documents meet in the next round.
FAN = 512
#: Rows of a repeated row that are made at once.
_USES = 1 << 16
_EPS = 1e-9
_OPEN = ("source_no bigint, block bigint, blocks bigint, key string, hash bigint, number bigint, "
         "size bigint, source_size bigint, target double, whole bigint, chance double")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source, source_no, docs, source_size, target`` of a table ``source, docs, source_size``.

    Sources take the weights in turn, by code point, null last. They share ``share`` of all
    words by weight; a target stops at ``most`` times its source's size, and what is over is
    shared again among the others until none is above. Every round is one aggregate over the
    sources, which stay distributed.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_no") % len(weights) + 1).cast("int"))
    known = dense_seq(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"],
                      "source_no").drop("_last")
    known = stage_table(known.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(known.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        open_, taken = known.agg(F.sum(F.when(~full, F.col("weight"))),
                                 F.sum(F.when(full, cap))).first()
        below = (total - (taken or 0.0)) / open_ if open_ else level
        if below == level:
            break
        level = below
    return known.withColumn("target", F.least(cap, F.col("weight") * F.lit(level))).drop("weight")


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Move the open chances until at most two of them are between 0 and 1.

    A step takes three documents and a direction u with sum(u) = 0 and sum(u * size) = 0; how
    far it goes either way is drawn so that no chance changes on average.
    """
    chances, live, nxt = list(chances), [], 0
    while True:
        while len(live) < 3 and nxt < len(chances):
            if _EPS < chances[nxt] < 1 - _EPS:
                live.append(nxt)
            else:
                chances[nxt] = float(round(chances[nxt]))
            nxt += 1
        if len(live) < 3:
            return chances
        a, b, c = live
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1, -1, 0)
        live = _move(chances, live, u, rng)


def _move(chances: list[float], live: list[int], u: tuple, rng: random.Random) -> list[int]:
    """One step along u or against it; what is still open afterwards."""
    ahead = min((1 - chances[i]) / x if x > 0 else chances[i] / -x
                for i, x in zip(live, u, strict=True) if x)
    back = min(chances[i] / x if x > 0 else (1 - chances[i]) / -x
               for i, x in zip(live, u, strict=True) if x)
    step = ahead if rng.random() * (ahead + back) < back else -back
    for i, x in zip(live, u, strict=True):
        chances[i] += step * x
        if chances[i] < _EPS:
            chances[i] = 0.0
        elif chances[i] > 1 - _EPS:
            chances[i] = 1.0
    return [i for i in live if 0 < chances[i] < 1]


def landing(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Move the last open chances along the words alone, until one is left at most."""
    chances = list(chances)
    live = [i for i, x in enumerate(chances) if _EPS < x < 1 - _EPS]
    while len(live) > 1:
        a, b = live[:2]
        live = _move(chances, [a, b], (sizes[b], -sizes[a]), rng) + live[2:]
    return chances


def _flown(seed: int, land: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "key", "hash", "number"]).reset_index(drop=True)
        first = rows.iloc[0]
        rng = random.Random(f"{seed}:{first.source_no}:{first.blocks}:{first.block}")
        sizes = [int(x) for x in rows["size"]]
        moved = flight(sizes, rows["chance"].tolist(), rng)
        rows["chance"] = landing(sizes, moved, rng) if land else moved
        return rows.drop(columns="order")
    return run


def _round(rows: DataFrame, seed: int, land: bool) -> DataFrame:
    ordered = rows.withColumn("order", F.xxhash64(F.lit(seed), "key"))
    return ordered.groupBy("source_no", "block").applyInPandas(_flown(seed, land), _OPEN)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST, seed: int = 7) -> DataFrame:
    """What the mix takes of every document: ``doc_id, key, size, source_size, target, copies,
    part, taken``; ``copies`` whole copies and the first ``part`` words of another one.

    Documents are told apart by id and whole text (``key``) and the other columns, so the result
    does not depend on how the table is partitioned, and reruns agree. Null texts and texts
    without words have size 0 and are never taken; a null source is a source. Repeated rows are
    drawn one by one, in blocks like all others. An empty table gives an empty result.
    """
    rows = docs.select(row_key().alias("key"), row_hash(docs).alias("hash"),
                       F.monotonically_increasing_id().alias("number"),
                       word_count(F.col("text")).alias("size"), "source")
    return _mixed(stage_table(rows, "sizes"), weights, share, most, seed).select(
        F.expr("try_cast(substring_index(key, ':', 1) AS bigint)").alias("doc_id"),
        "key", "size", "source_size", "target", "copies", "part", "taken")


def _mixed(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
           most: float = MOST, seed: int = 7) -> DataFrame:
    """The mix of a staged table ``key, hash, number, size, source``; ``number`` is unique."""
    sizes = rows.groupBy("source").agg(F.count("*").alias("docs"),
                                       F.sum("size").alias("source_size"))
    targets = source_targets(stage_table(sizes, "source-sizes"), weights, share, most)
    targets = stage_table(targets.withColumnRenamed("source", "_source"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("docs") / F.lit(BLOCK))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    often = stage_table(rows.groupBy("key", "source_no").agg(F.count("*").alias("times"))
                        .where(F.col("times") > BLOCK), "repeated")
    rows = (rows.withColumn("blocks", blocks)
            .join(often, ["key", "source_no"], "left")
            # what repeats more often than a block may hold is spread over blocks
            .withColumn("block", F.pmod(F.when(F.col("times").isNull(), F.xxhash64("key")).otherwise(
                F.xxhash64("key", F.pmod("number", F.ceil(F.col("times") / BLOCK)))),
                F.col("blocks")))
            .withColumn("whole", F.floor(rate))
            .withColumn("chance", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0)))
    most_blocks = targets.agg(F.max(F.ceil(F.col("docs") / F.lit(BLOCK)))).first()[0] or 1
    open_ = rows.select([c.split()[0] for c in _OPEN.split(", ")])
    done = []
    while True:
        last = most_blocks == 1
        flown = stage_table(_round(open_, seed, last), "flight")
        if last:
            done.append(flown)
            break
        between = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.where(~between))
        open_ = (flown.where(between)
                 .withColumn("block", F.floor(F.col("block") / F.lit(FAN)))
                 .withColumn("blocks", F.ceil(F.col("blocks") / F.lit(FAN))))
        most_blocks = -(-most_blocks // FAN)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = F.col("whole") + F.floor("chance")
    part = F.when(F.col("chance") < 1, F.round(F.col("chance") * F.col("size"))
                  ).otherwise(0).cast("bigint")
    return (every.withColumn("copies", copies).withColumn("part", part)
            .withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
            .select("key", "hash", "size", "source_size", "target", "copies", "part", "taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, as often as it takes them, with all their columns.

    Texts stay whole: the one document a source that the mix takes in part comes once more if
    half of its words or more are taken, so a source's words are within one of its documents
    of the target. Rows are drawn and repeated one by one, whatever they have in common.
    """
    rows = docs.select(row_key().alias("key"), row_hash(docs).alias("hash"),
                       F.monotonically_increasing_id().alias("number"),
                       word_count(F.col("text")).alias("size"), "source")
    drawn = common.staged(docs.sparkSession, "drawn", lambda: _uses(rows, options))
    # rows of one key and hash are the same in all columns, and share what is drawn of them
    full = docs.select(whole_row(docs).alias("row"), row_key().alias("key"),
                       row_hash(docs).alias("hash")).dropDuplicates(["key", "hash"])
    more = F.least(F.col("uses") - _USES * F.col("part"), F.lit(_USES)).cast("int")
    return (full.join(drawn, ["key", "hash"])
            .withColumn("part", F.explode(F.expr(f"sequence(0L, (uses - 1) div {_USES})")))
            .withColumn("use", F.explode(F.array_repeat(F.lit(0), more))).select("row.*"))


def _uses(rows: DataFrame, options: dict) -> DataFrame:
    """How often the mix takes the rows of a key and hash, the one taken in part rounded."""
    part = F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return (_mixed(stage_table(rows, "sizes"), **options).groupBy("key", "hash")
            .agg(F.sum(F.col("copies") + part).cast("bigint").alias("uses")).where("uses > 0"))
