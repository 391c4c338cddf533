"""Near-duplicates by SimHash fingerprints, linked through an anchor-point covering.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most 3 bits
differ in at most 1 bit of some half. The anchors of a half are the words of a covering code:
the perfect Hamming code on 31 bits, the 32nd bit taken as it is. Every half lies within
covering radius 1 of an anchor, so when each fingerprint is replicated to every anchor within
radius plus threshold, 1 + 1 = 2 bits (17 anchors at most), any two linked fingerprints meet
at the anchor next to one of them. Only fingerprints at the same anchor are compared, and
over all 64 bits.

Equal fingerprints are folded before, so that copies cost nothing. Anchors with many different
fingerprints are dealt out as pairs of chunks. A task reports the links that join what it has
not joined yet, never all pairs, and connected components follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.common import row_hash, row_key, staged, whole_row
from tuneloom.llm.components import connected_components
from tuneloom.session import stage_table

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Fingerprints of an anchor that one task compares; larger anchors are cut into chunks.
CHUNK = 4096
_STEP = 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashed word shingles of a whole text, A-Z in lower case.

    Null and texts without words give 0; one or two words make a single shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, shingles, _STEP):
        part = words[start:start + _STEP + SHINGLE - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) \
            if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(_hash, joined), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(prints.view(np.int64))],
            names=[*(n for n in batch.schema.names if n != "text"), "fp"])


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within 2 bits of 32-bit words, as (row of the word, anchor)."""
    low = (words & np.uint64(0x7FFFFFFF)).astype(np.int64)
    top = (words >> np.uint64(31)).astype(np.int64) << 31
    syndrome = np.zeros(len(words), np.int64)
    for position in range(1, 32):
        syndrome ^= np.where(low >> (position - 1) & 1, position, 0)
    bit = np.concatenate([[0], 1 << np.arange(31)]).astype(np.int64)
    nearest, rows = low ^ bit[syndrome], np.arange(len(words))
    found = [(rows, nearest | top), (rows, nearest | (top ^ (1 << 31)))]
    for i in range(1, 32):  # flip two bits whose positions cancel the syndrome
        j = syndrome ^ i
        at = np.flatnonzero((syndrome != 0) & (j > i))
        found.append((at, low[at] ^ bit[i] ^ bit[j[at]] | top[at]))
    return np.concatenate([r for r, _ in found]), np.concatenate([a for _, a in found])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for half in (0, 1):
            words = prints >> np.uint64(32) if half else prints & np.uint64(0xFFFFFFFF)
            rows, found = anchors(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found | half << 32), pa.array(prints[rows].view(np.int64))],
                names=["anchor", "fp"])


class _Joined:
    """Which rows of a batch are joined already."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self._root(a), self._root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def _links(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal group, as a star around the first row of what is joined.

    Rows are sorted by group. Row i is compared with row i + 1, i + 2 … of its group, all
    rows at once; rows that are joined already need no link.
    """
    ends = np.searchsorted(group, group, side="right")
    joined, rows, step = _Joined(len(group)), np.arange(len(group)), 1
    roots = joined.parent
    while len(rows := rows[rows + step < ends[rows]]):
        other = rows + step
        open_ = roots[rows] != roots[other]
        a, b = rows[open_], other[open_]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= THRESHOLD
        if near.any():
            joined.join(a[near], b[near])
            roots = joined.roots()
        step += 1
    at = np.flatnonzero(roots != np.arange(len(group)))
    return prints[roots[at]], prints[at]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (anchor, pair); the last run of a batch waits for the next."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        anchor, pair, prints = rows
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1])])
        a, b = _links(np.cumsum(new), prints.view(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    kept = [np.empty(0, np.int64)] * 3
    for batch in batches:
        kept = [np.concatenate([k, batch.column(c).to_numpy(zero_copy_only=False)])
                for k, c in zip(kept, ("anchor", "pair", "fp"), strict=True)]
        if not len(kept[0]):
            continue
        same = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
        cut = len(same) - int(same.sum())
        if cut:
            yield linked([k[:cut] for k in kept])
            kept = [k[cut:] for k in kept]
    if len(kept[0]):
        yield linked(kept)


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, distinct) within 3 bits."""
    replicas = prints.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint")
    large = stage_table(replicas.groupBy("anchor").agg(F.count("*").alias("n"))
                        .where(F.col("n") > CHUNK), "large-anchors")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK // 2))
    own = F.pmod(F.xxhash64("fp"), chunks)
    other = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), chunks - 1))
    dealt = (replicas.join(large, "anchor", "left")
             .withColumn("other", F.explode(other))
             .select("anchor", "fp", F.coalesce(
                 F.least(own, "other") * chunks + F.greatest(own, "other"),
                 F.lit(0)).alias("pair")))
    return (dealt.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair", "fp")
            .mapInArrow(_compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints link at 3 or fewer differing bits; ``component_id`` is the smallest id that
    can be reached. Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows stay rows. Null ids are never the smallest; a component of null ids only has
    a null one. An empty table gives an empty result.
    """
    return _with_roots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
                       ).select("doc_id", "fingerprint", "component_id")


def _with_roots(rows: DataFrame) -> DataFrame:
    """Every row but its text, with ``fingerprint, root, component_id``."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    marked = stage_table(rows.mapInArrow(_fingerprints, f"{shape}, fp bigint"), "fingerprints")
    prints = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(link_fingerprints(prints))
    placed = stage_table(
        prints.join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = stage_table(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage_table(placed.join(least, "root").select("fp", "root", "component_id"), "named")
    return (marked.join(named, "fp")
            .withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay: of every component the row with its ``component_id``.

    Where that id repeats, the smallest text among its rows stays, once; of rows equal in id and
    text, the one whose whole row has the least hash. All columns are kept.
    """
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    best = staged(docs.sparkSession, "representatives", lambda: (
        _with_roots(rows).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min("key").alias("_key")).select("_key")))
    full = docs.select(whole_row(docs).alias("row"), row_hash(docs).alias("hash"),
                       row_key().alias("_key"))
    return (full.join(best, "_key", "left_semi").groupBy("_key")
            .agg(F.min_by("row", "hash").alias("row")).select("row.*"))
