"""Prefix trie of conversations, by hashing blocks of a fixed number of turns.

A node of the trie is a distinct sequence of first turns; its members are the conversations
that begin with it. Conversations are grouped by the digests of successive blocks of ``BLOCK``
turns first. A prefix digest is a sum of hashes of (place, turn), so those of all block ends
come from one running sum over the blocks, and not from a step per turn. Conversations with the
same digests up to a block's end are one row from there on, of which the smallest member stands
for all. Where all that share a block's beginning share the whole block, its turns have the
members of the block. Only where siblings diverge inside a block are their turns compared: one
representative a sibling, each with its number of members.

What a node knows of its subtree is gathered by pointer jumping: in round k every node hands what
it has gathered to its ancestor 2^k turns up, so a trie of depth d takes log2(d) rounds.

One conversation may hold any share of the turns: turns are numbered over all conversations at
once, and running sums go over shards of these numbers. Hot nodes are met with aggregates only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.operators.ranks import dense_seq, prefix_aggregates
from tuneloom.session import stage_table

#: Turns of a block.
BLOCK = 4
#: Conversations of an id range whose ids are joined to one text at once.
_ENDS = 512
_PARTS = ["p0", "p1", "p2", "p3"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_hash, chars`` of every turn, staged; places count from 0.

    Turns are ordered by ``turn``, null first; of equal ones, by the hash of role and text. Null
    roles and texts are empty. Rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
        .alias("turn_hash"), F.char_length(text).cast("bigint").alias("chars"))
    rows = stage_table(dense_seq(rows, ["conv_id", "turn", "turn_hash"], "seq"), "turns")
    first = stage_table(rows.groupBy("conv_id").agg(F.min("seq").alias("first")), "first-turns")
    return rows.join(first, "conv_id").select(
        "conv_id", (F.col("seq") - F.col("first")).alias("pos"), "turn_hash", "chars")


def rebuilt(turns: DataFrame, share: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their hundred does.

    Conversation c gets the first h turns of c - c % ``share`` and its own ones after its first
    h, h being the unsigned crc32 of its decimal id modulo ``most``. Returns all ``conv_id`` and
    the turns.
    """
    turns = stage_table(turns, "numbered")
    convs = stage_table(turns.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % share).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")), "convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    plan = stage_table(convs.join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("of_base", F.lit(0)))), "plan")
    # a base has less than 2 * share followers, and each takes a few turns
    begun = (plan.where("taken > 0").select("conv_id", "base", "taken")
             .join(turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base"), "base")
             .where("pos < taken").select("conv_id", "pos", "turn_hash", "chars"))
    kept = (turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"),
                    "turn_hash", "chars"))
    return plan.select("conv_id"), begun.unionByName(kept)


def _parts() -> list[Column]:
    """The hash of a turn at its place, in four summands; their sums over turns do not overflow."""
    hashed = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "turn_hash").cast("binary"))
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("bigint").alias(p)
            for i, p in enumerate(_PARTS)]


def _key(depth: Column, parts: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), *[p.cast("string") for p in parts])
                 .cast("binary"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of a key, which come in order; no key is held as a whole."""
    schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        done = []
        for own, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(),
                              strict=True):
            if own != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])],
                                         schema=schema)


def _ends(last: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes (``key``) at which conversations (``conv_id``) end."""
    pieces = (last.withColumn("part", F.shiftright("conv_id", _ENDS.bit_length() - 1))
              .groupBy("key", "part")  # _ENDS ids at most
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
                   .alias("piece")))
    return (pieces.repartition("key").sortWithinPartitions("key", "part").select("key", "piece")
            .mapInArrow(_streamed, "key string, ends_sha256 string"))


def _summed(nodes: DataFrame, depth: int) -> DataFrame:
    """``key`` with the sums of ``leaf`` and ``saved`` over every node's subtree."""
    held = stage_table(nodes.select("key", F.col("parent").alias("up"), "leaf", "saved"), "sums")
    step = 1
    while step <= depth:
        given = held.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(
            F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
        above = held.select(F.col("key").alias("up"), F.col("up").alias("next"))
        held = stage_table(
            held.join(given, "key", "left").join(above, "up", "left").select(
                "key", F.col("next").alias("up"),
                (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "sums")
        step *= 2
    return held.select("key", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``convs`` has all conversations (``conv_id``, unique), those without turns too; ``turns``
    has ``conv_id, pos, turn_hash, chars``, places being 0, 1, 2 … in each conversation. No
    conversations give no nodes, not even a root.
    """
    turns = stage_table(turns.select("conv_id", "pos", "chars", *_parts()), "hashed")
    turns = turns.withColumn("block", F.expr(f"pos div {block}"))
    sums = turns.groupBy("conv_id", "block").agg(
        F.count("*").alias("size"), *[F.sum(p).alias(p) for p in _PARTS])
    sums = stage_table(dense_seq(sums, ["conv_id", "block"], "seq"), "block-sums")
    run = prefix_aggregates(sums.withColumnsRenamed({p: f"own_{p}" for p in _PARTS}), ["conv_id"],
                            "seq", {p: ("sum", F.col(f"own_{p}")) for p in _PARTS})
    start = [F.col(p) - F.col(f"own_{p}") for p in _PARTS]
    ends = stage_table(run.select(
        "conv_id", "block", "size",
        _key(F.col("block") * block, start).alias("start"),
        _key(F.col("block") * block + F.col("size"), [F.col(p) for p in _PARTS]).alias("end"),
        *[s.alias(f"s{i}") for i, s in enumerate(start)]), "block-ends")
    # conversations that are the same up to a block's end, the smallest for all
    same = stage_table(ends.groupBy("block", "start", "end").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.first(f"s{i}").alias(f"s{i}") for i in range(4)]), "siblings")
    split = same.groupBy("start").agg(F.count("*").alias("siblings"))
    within = (Window.partitionBy("conv_id", "block").orderBy("pos")
              .rowsBetween(Window.unboundedPreceding, 0))  # a block's turns
    after = [F.sum(p).over(within) + F.col(f"s{i}") for i, p in enumerate(_PARTS)]
    steps = (turns.join(same.join(split, "start"), ["conv_id", "block"])
             .select("siblings", "conv_id", "n_convs", "chars", "start", "pos",
                     (F.col("pos") + 1).alias("depth"),
                     *[a.alias(f"a{i}") for i, a in enumerate(after)], *_PARTS))
    parts = [F.col(f"a{i}") for i in range(4)]
    before = [F.col(f"a{i}") - F.col(p) for i, p in enumerate(_PARTS)]
    steps = stage_table(steps.select(
        "siblings", "conv_id", "n_convs", "chars", "depth", _key(F.col("depth"), parts).alias("key"),
        _key(F.col("pos"), before).alias("parent")), "steps")
    shape = ["key", "parent", "depth", "conv_id", "n_convs", "chars"]
    alone = steps.where("siblings = 1").select(shape)
    refined = steps.where("siblings > 1").groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.first("chars").alias("chars")).select(shape)
    zero = _key(F.lit(0), [F.lit(0)] * 4)
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
            .where("n_convs > 0").select(
                zero.alias("key"), F.lit(None).cast("string").alias("parent"),
                F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs",
                F.lit(0).cast("bigint").alias("chars")))
    nodes = stage_table(reduce(DataFrame.unionByName, [alone, refined, root]), "nodes")
    children = stage_table(nodes.where(F.col("parent").isNotNull()).groupBy(
        F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    nodes = stage_table(
        nodes.join(children, "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    last = ends.groupBy("conv_id").agg(F.max_by("end", "block").alias("key"))
    last = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("key", zero).alias("key"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (nodes.join(_summed(nodes, depth), "key").join(_ends(last), "key", "left")
            .join(above, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations; see ``trie`` and ``rebuilt``.

    Repeated rows of a conversation are turns of their own. Other columns are not looked at.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    return trie(convs, turns, block)
