"""Exact next-fit packing of token sequences into blocks, as a distributed job.

Next-fit looks sequential, but its only state is the fill of the open block. So
each shard of consecutive rows is a function from the fill on entry to the fill
on exit and the number of breaks in between. That function is piecewise simple:
the entry fill only decides where the first break falls. Pass 1 computes it per
shard, shard functions are composed in two levels (groups of shards, then the
groups) to get each shard's true entry state, and pass 2 folds every shard from
that state. Only ``(seq, length)`` goes through Python.

Rows of ``max_len`` are blocks of their own and leave the open block alone.
Blocks are numbered in the order a one-pass loop would emit them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.constants import IGNORE_LABEL
from tuneloom.functions.tokens import position_ids
from tuneloom.operators.ranks import SHARD_ROWS, dense_seq, is_dense, with_shard
from tuneloom.session import stage_table

_GROUP_BITS = 8

# A shard function is a list of pieces over the entry fill e. On the piece that
# starts at ``lo``: exit fill = slope * e + base, breaks = breaks.
_FN_SCHEMA = ("lo array<int>, slope array<int>, base array<int>, breaks array<bigint>, "
              "n_full bigint")
_STATE_SCHEMA = "fill int, first_block bigint, first_emit bigint, is_last boolean"
_PLACE_SCHEMA = ("seq bigint, block bigint, offset int, emit bigint, is_full boolean, "
                 "is_marker boolean")


def _next_break(prefix: np.ndarray, max_len: int) -> np.ndarray:
    """For a block opened at row j, the row that no longer fits (n = none)."""
    return np.searchsorted(prefix, prefix[:-1] + max_len, side="right") - 1


def _shard_function(lengths: np.ndarray, max_len: int) -> dict:
    open_rows = lengths[lengths < max_len].astype(np.int64)
    n_full = int(len(lengths) - len(open_rows))
    prefix = np.concatenate([[0], np.cumsum(open_rows)])
    n, total = len(open_rows), int(prefix[-1])
    # last break reached from a break at j, and how many there are, by pointer doubling
    hop = np.append(_next_break(prefix, max_len), n)
    count = (hop < n).astype(np.int64)
    hop = np.where(hop < n, hop, np.arange(n + 1))
    while True:
        further = count[hop]
        if not further.any():
            break
        count, hop = count + further, hop[hop]
    # entry fills at which the first break moves to an earlier row
    reach = prefix[1:][prefix[1:] <= max_len]
    starts = np.unique(np.concatenate([[0], max_len + 1 - reach]))
    starts = starts[starts <= max_len]
    first = np.searchsorted(prefix, max_len - starts, side="right") - 1
    broken = first < n
    at = np.minimum(first, n)
    exit_fill = total - prefix[hop[at]]
    return {"lo": starts, "slope": np.where(broken, 0, 1),
            "base": np.where(broken, exit_fill, total),
            "breaks": np.where(broken, count[at] + 1, 0), "n_full": n_full}


def _apply(fn: dict, fill: int) -> tuple[int, int]:
    i = int(np.searchsorted(fn["lo"], fill, side="right")) - 1
    return int(fn["slope"][i]) * fill + int(fn["base"][i]), int(fn["breaks"][i])


def _compose(f: dict, g: dict, max_len: int) -> dict:
    """First f, then g."""
    pieces: list[tuple[int, int, int, int]] = []
    bounds = [*f["lo"][1:], max_len + 1]
    for lo, hi, slope, base, breaks in zip(f["lo"], bounds, f["slope"], f["base"], f["breaks"]):
        lo, hi, base, breaks = int(lo), int(hi), int(base), int(breaks)
        if slope == 0:
            fill, more = _apply(g, base)
            pieces.append((lo, 0, fill, breaks + more))
            continue
        # the entry fill passes through: take g's pieces, shifted by what f adds
        inner = [int(x) - base for x in g["lo"] if lo < int(x) - base < hi]
        for start in [lo, *inner]:
            j = int(np.searchsorted(g["lo"], start + base, side="right")) - 1
            g_slope = int(g["slope"][j])
            pieces.append((start, g_slope, int(g["base"][j]) + g_slope * base,
                           breaks + int(g["breaks"][j])))
    merged = [p for i, p in enumerate(pieces) if i == 0 or p[1:] != pieces[i - 1][1:]]
    lo, slope, base, breaks = (np.array(x, dtype=np.int64) for x in zip(*merged))
    return {"lo": lo, "slope": slope, "base": base, "breaks": breaks,
            "n_full": int(f["n_full"]) + int(g["n_full"])}


def _function_row(fn: dict) -> dict:
    return {k: ([int(x) for x in v] if k != "n_full" else int(v)) for k, v in fn.items()}


def _functions(pdf: pd.DataFrame) -> list[dict]:
    return pdf[["lo", "slope", "base", "breaks", "n_full"]].to_dict("records")


def _walk(pdf: pd.DataFrame, fill: int, block: int, emit: int, is_last: bool) -> pd.DataFrame:
    """Entry state of every function in ``pdf`` (in order), from the state before the first."""
    rows = []
    for i, fn in enumerate(_functions(pdf)):
        rows.append((fill, block, emit, is_last and i == len(pdf) - 1))
        fill, breaks = _apply(fn, fill)
        block, emit = block + breaks, emit + breaks + int(fn["n_full"])
    return pd.DataFrame(rows, columns=["fill", "first_block", "first_emit", "is_last"])


def _place_rows(seq: np.ndarray, lengths: np.ndarray, max_len: int, state: dict) -> pd.DataFrame:
    """Fold one shard from its entry state."""
    order = np.argsort(seq, kind="stable")
    seq, lengths = seq[order], lengths[order].astype(np.int64)
    is_full = lengths >= max_len
    open_rows = lengths[~is_full]
    prefix = np.concatenate([[0], np.cumsum(open_rows)])
    n = len(open_rows)
    nxt = _next_break(prefix, max_len)
    fill = int(state["fill"])
    breaks = []
    at = int(np.searchsorted(prefix, max_len - fill, side="right")) - 1
    while at < n:
        breaks.append(at)
        at = int(nxt[at])
    breaks_at = np.array(breaks, dtype=np.int64)
    rows = np.arange(n)
    local = np.searchsorted(breaks_at, rows, side="right")
    opened_at = np.concatenate([[0], breaks_at]).astype(np.int64)[local]
    offset = prefix[rows] - prefix[opened_at] + np.where(local == 0, fill, 0)
    block = int(state["first_block"]) + local

    # emission number of a full row, or of the break caused by a row
    position = np.flatnonzero(~is_full)
    caused = np.zeros(len(seq), dtype=bool)
    caused[position[breaks_at]] = True
    emitted = is_full | caused
    emit = int(state["first_emit"]) + np.cumsum(emitted) - emitted

    # keys without a partner are spread: negative and different for every row
    full = pd.DataFrame({"seq": seq[is_full], "block": -1 - seq[is_full], "offset": 0,
                         "emit": emit[is_full], "is_full": True, "is_marker": False})
    placed = pd.DataFrame({"seq": seq[~is_full], "block": block, "offset": offset,
                           "emit": -1, "is_full": False, "is_marker": False})
    closed = pd.DataFrame({"seq": -1, "block": int(state["first_block"]) + np.arange(len(breaks)),
                           "offset": 0, "emit": emit[caused], "is_full": False,
                           "is_marker": True})
    parts = [full, placed, closed]
    if state["is_last"]:
        parts.append(pd.DataFrame({
            "seq": [-1], "block": [int(state["first_block"]) + len(breaks)], "offset": [0],
            "emit": [int(state["first_emit"]) + int(emitted.sum())],
            "is_full": [False], "is_marker": [True]}))
    out = pd.concat([p for p in parts if len(p)], ignore_index=True)
    return out.astype({"seq": "int64", "block": "int64", "offset": "int32", "emit": "int64",
                       "is_full": bool, "is_marker": bool})


def pack_sequences(df: DataFrame, max_len: int = 1024,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Place every row of ``(seq, length)``.

    Output: ``seq, block, offset, emit, is_full, is_marker``. A full row carries
    its own block number in ``emit``. Other rows carry the ordinal of their
    block; a marker row per block carries the block number. Rows without tokens
    add nothing to any block and are left out.
    """
    def shard_functions(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("seq", kind="stable")
        fn = _shard_function(ordered["length"].to_numpy(), max_len)
        shard = int(pdf["_shard"].iloc[0])
        return pd.DataFrame([{"_group": shard >> _GROUP_BITS, "_shard": shard,
                              **_function_row(fn)}])

    def group_functions(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = _functions(pdf.sort_values("_shard"))
        fn = ordered[0]
        for g in ordered[1:]:
            fn = _compose(fn, g, max_len)
        return pd.DataFrame([{"_group": int(pdf["_group"].iloc[0]), "_one": 0,
                              **_function_row(fn)}])

    def group_states(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("_group").reset_index(drop=True)
        states = _walk(ordered, 0, 0, 0, True)
        states.insert(0, "_group", ordered["_group"])
        return states

    def shard_states(fns: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        ordered = fns.sort_values("_shard").reset_index(drop=True)
        e = entry.iloc[0]
        states = _walk(ordered, int(e["fill"]), int(e["first_block"]), int(e["first_emit"]),
                       bool(e["is_last"]))
        states.insert(0, "_shard", ordered["_shard"])
        return states

    def place(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return _place_rows(rows["seq"].to_numpy(), rows["length"].to_numpy(), max_len,
                           entry.iloc[0].to_dict())

    narrow = df.select("seq", "length").where(F.col("length") > 0)
    if not is_dense(narrow, "seq", shard_rows):  # pack by place, then name the rows again
        places = stage_table(dense_seq(narrow, ["seq"], "_place"), "places")
        packed = pack_sequences(places.select(F.col("_place").alias("seq"), "length"), max_len,
                                shard_rows)
        names = places.select("_place", F.col("seq").alias("_name"))
        return (packed.join(names, F.col("seq") == F.col("_place"), "left")
                .withColumn("seq", F.coalesce("_name", "seq")).drop("_place", "_name"))
    rows = with_shard(narrow, "seq", shard_rows).select("seq", "length", "_shard")
    # both passes group the same rows the same way, so they share one shuffle
    fns = rows.groupBy("_shard").applyInPandas(
        shard_functions, f"_group bigint, _shard bigint, {_FN_SCHEMA}")
    # at most 2^_GROUP_BITS shards per group, and one function per group at the top:
    # rows / (shard_rows * 2^_GROUP_BITS) small rows in all
    groups = (fns.groupBy("_group").applyInPandas(
        group_functions, f"_group bigint, _one int, {_FN_SCHEMA}")
        .groupBy("_one").applyInPandas(group_states, f"_group bigint, {_STATE_SCHEMA}"))
    entries = fns.groupBy("_group").cogroup(groups.groupBy("_group")).applyInPandas(
        shard_states, f"_shard bigint, {_STATE_SCHEMA}")
    return rows.groupBy("_shard").cogroup(entries.groupBy("_shard")).applyInPandas(
        place, _PLACE_SCHEMA)


def _staged_placement(df: DataFrame, max_len: int, shard_rows: int) -> DataFrame:
    """The placement is read several times, so the narrow table is written once."""
    return stage_table(pack_sequences(df, max_len, shard_rows), "placement")


def block_segments(df: DataFrame, max_len: int = 1024,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per example: ``block_id, record_id, seq, offset, len``, without token arrays."""
    placed = _staged_placement(df, max_len, shard_rows)
    rows = placed.where(~F.col("is_marker")).join(
        df.select("seq", "record_id", F.col("length").alias("len")), "seq")
    numbers = placed.where(F.col("is_marker")).select("block", F.col("emit").alias("_number"))
    # full rows know their number and match no marker
    return (rows.join(numbers, "block", "left")
            .select(F.when(F.col("is_full"), F.col("emit")).otherwise(F.col("_number"))
                    .alias("block_id"), "record_id", "seq", "offset", "len"))


def packed_blocks(df: DataFrame, max_len: int = 1024, mask_boundaries: bool = False,
                  shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Dense blocks: ``block_id, input_ids, labels, position_ids, segments``.

    ``df`` has ``record_id, seq, input_ids, labels, length`` and is read three
    times, so it should be a stored table. With ``mask_boundaries`` the first
    label of every example but the first is ignored, so no example is predicted
    from its neighbour.
    """
    placed = _staged_placement(df, max_len, shard_rows)
    part = F.struct("offset", "record_id", F.col("length").alias("len"), "input_ids", "labels")

    def rows(full: bool) -> DataFrame:
        # either side moves its own token arrays only
        fits = F.col("length") >= max_len if full else F.col("length") < max_len
        mine = placed.where((F.col("is_full") == full) & ~F.col("is_marker"))
        return mine.join(df.where(fits).select("seq", "record_id", "length", "input_ids",
                                               "labels"), "seq")

    shared = rows(full=False).select("block", F.lit(None).cast("bigint").alias("emit"),
                                     part.alias("part"))
    marks = placed.where(F.col("is_marker")).select(
        "block", "emit", F.lit(None).cast(shared.schema["part"].dataType).alias("part"))
    # a block holds at most max_len examples, since each has a token
    grouped = (shared.unionByName(marks).groupBy("block")
               .agg(F.max("emit").alias("block_id"),
                    F.array_sort(F.collect_list("part")).alias("parts"))
               .where(F.size("parts") > 0).select("block_id", "parts"))
    whole = rows(full=True).select(F.col("emit").alias("block_id"),
                                   F.array(part).alias("parts"))

    def example_labels(p: Column) -> Column:
        if not mask_boundaries:
            return p["labels"]
        first = F.array(F.lit(IGNORE_LABEL))
        return F.when(p["offset"] > 0, F.concat(first, F.slice(p["labels"], 2, max_len))) \
            .otherwise(p["labels"])

    return grouped.unionByName(whole).select(
        "block_id",
        F.flatten(F.transform("parts", lambda p: p["input_ids"])).alias("input_ids"),
        F.flatten(F.transform("parts", example_labels)).alias("labels"),
        position_ids(F.transform("parts", lambda p: p["len"])).alias("position_ids"),
        F.transform("parts", lambda p: F.struct(
            p["record_id"].alias("record_id"), p["offset"].cast("int").alias("offset"),
            p["len"].alias("len"))).alias("segments"))


def packing_info(blocks: DataFrame, max_len: int = 1024) -> DataFrame:
    """Real block count next to the lower bound that the layout choice uses."""
    used = F.coalesce(F.sum(F.size("input_ids")), F.lit(0))
    return blocks.agg(F.count("*").alias("actual_blocks"),
                      F.ceil(used / max_len).cast("bigint").alias("estimated_blocks"),
                      used.cast("bigint").alias("used_tokens"))
