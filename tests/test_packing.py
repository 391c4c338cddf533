import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tuneloom.operators import packing as P


def check_layout(blocks, lens, max_len):
    """What next-fit in row order means, told by the blocks alone."""
    assert sorted(r for b in blocks for r in b) == list(range(len(lens)))
    fills = [sum(lens[r] for r in b) for b in blocks]
    assert all(b == sorted(b) for b in blocks)
    assert all(fill <= max_len or len(b) == 1 for b, fill in zip(blocks, fills))
    # rows of full length stand alone; the others fill block after block, in order
    mixed = [(b, fill) for b, fill in zip(blocks, fills) if lens[b[0]] < max_len]
    assert [r for b, _ in mixed for r in b] == [r for r, n in enumerate(lens) if n < max_len]
    assert all(fill + lens[after[0]] > max_len for (_, fill), (after, _) in zip(mixed, mixed[1:]))
    # a block is numbered when it closes: a full row at once, others by the row that did not fit
    closes = [b[0] if lens[b[0]] >= max_len else next(
        (c[0] for c, _ in mixed if c[0] > b[0]), len(lens)) for b in blocks]
    assert closes == sorted(closes)


lengths_and_size = st.integers(2, 40).flatmap(lambda m: st.tuples(
    st.just(m), st.lists(st.integers(1, m), min_size=1, max_size=60), st.integers(1, 9)))


@settings(max_examples=400, deadline=None)
@given(lengths_and_size)
def test_shard_functions_compose(case):
    max_len, lens, shard = case
    parts = [np.array(lens[i:i + shard]) for i in range(0, len(lens), shard)]
    fns = [P._shard_function(p, max_len) for p in parts]
    whole = fns[0]
    for g in fns[1:]:
        whole = P._compose(whole, g, max_len)
    direct = P._shard_function(np.array(lens), max_len)
    for entry in range(max_len + 1):
        fill, breaks = P._apply(whole, entry)
        assert (fill, breaks) == P._apply(direct, entry)
        assert 0 <= fill <= max_len and breaks <= sum(n < max_len for n in lens)
        if breaks == 0:  # nothing was closed, so all short rows are in the open block
            assert fill == entry + sum(n for n in lens if n < max_len)
    assert whole["n_full"] == direct["n_full"] == sum(n >= max_len for n in lens)
    assert len(whole["lo"]) <= max_len + 1


def rows(spark, lens, first=0, step=1):
    data = [(100 + i, first + i * step, [7] * n, [7] * n, n) for i, n in enumerate(lens)]
    return spark.createDataFrame(data, "record_id bigint, seq bigint, input_ids array<int>, "
                                       "labels array<int>, length int")


def packed(df, max_len, **options):
    blocks = P.packed_blocks(df, max_len, **options).orderBy("block_id").collect()
    assert [b["block_id"] for b in blocks] == list(range(len(blocks)))
    return blocks


def layout(blocks):
    return [[s["record_id"] - 100 for s in b["segments"]] for b in blocks]


def test_emission_order_and_positions(spark):
    blocks = packed(rows(spark, [3, 10, 4, 4]), 10)
    assert layout(blocks) == [[1], [0, 2], [3]]
    assert blocks[1]["position_ids"] == [0, 1, 2, 0, 1, 2, 3]
    assert [(s["offset"], s["len"]) for s in blocks[1]["segments"]] == [(0, 3), (3, 4)]


@pytest.mark.parametrize("shard_rows, partitions", [(2, 1), (8, 3), (16, 8), (1 << 18, 4)])
def test_next_fit_for_any_partitioning(spark, shard_rows, partitions):
    rng = random.Random(5)
    lens = [rng.choice([1, 2, 7, 7, 7, 19, 31, 32]) for _ in range(700)]
    df = rows(spark, lens, first=-40, step=3).repartition(partitions)
    check_layout(layout(packed(df, 32, shard_rows=shard_rows)), lens, 32)


def test_many_shard_groups(spark):
    lens = [random.Random(i).randint(1, 9) for i in range(1500)]
    check_layout(layout(packed(rows(spark, lens), 16, shard_rows=1)), lens, 16)


@pytest.mark.parametrize("lens, blocks", [
    ([10], [[0]]), ([10, 10, 10], [[0], [1], [2]]), ([1], [[0]]), ([0, 0], []), ([], []),
    ([0, 4, 0, 10, 7], [[3], [1], [4]]), ([5, 5, 1], [[0, 1], [2]]), ([6, 5, 4], [[0], [1, 2]])])
def test_small_inputs(spark, lens, blocks):
    assert layout(packed(rows(spark, lens), 10)) == blocks


def test_boundary_masking_is_optional(spark):
    df = rows(spark, [2, 3])
    assert packed(df, 10)[0]["labels"] == [7] * 5
    assert packed(df, 10, mask_boundaries=True)[0]["labels"] == [7, 7, -100, 7, 7]


def test_info_counts_real_blocks(spark):
    df = rows(spark, [6, 6, 6])
    info = P.packing_info(P.packed_blocks(df, 10), 10).first()
    assert (info["actual_blocks"], info["estimated_blocks"], info["used_tokens"]) == (3, 2, 18)
    segments = P.block_segments(df, 10).orderBy("seq").collect()
    assert [(s["block_id"], s["offset"], s["len"]) for s in segments] == [
        (0, 0, 6), (1, 0, 6), (2, 0, 6)]
