"""Similarity join of shingle sets by T-occurrence search.

Two sets are linked when their Jaccard similarity is ``least`` or more; then they share
T = ceil(least * n) or more shingles, n being the size of either. Documents with equal sets are
one class, and classes are what is joined.

Where two sets may meet: take of each set the n - T + t shingles of least hash, t being a
sixteenth of n. Two linked sets share t shingles there or more (the smaller t). A set of which
fewer are shared with anybody is linked with nothing and leaves. Of the inverted lists of these
shingles the short ones are merged: pairs are counted, and kept if they meet often enough,
whatever the long ones hold. A set with so many long lists that it could be met in these alone
is tied to the first of its kind in each of its long lists instead. What hangs together by
pairs and ties, sizes apart by more than the similarity allows not being tied, is a cell: all
links lie within cells. Common passages do not grow cells, as they are long lists.

In a cell, which holds whole sets, DivideSkip finds the links: for every set the short ones of
its inverted lists are merged, those that occur often enough are looked up in the long lists by
binary search, and sets that reach the overlap are linked. Sets that are connected already are
not searched for again. A cell beyond ``CELL`` shingles is cut into chunks: each chunk is joined
in itself and with a few pivots; what is then still apart from the largest part of the cell is
joined with all its chunks. So a large group of near copies costs as many comparisons as it has
members, and no pair of sets is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.components import connected_components
from tuneloom.llm.shingles import Shingles, bit_set, bit_table
from tuneloom.session import stage_table

SHINGLE = 4
LEAST = Fraction(17, 20)
#: Sets that a short inverted list holds at most.
SHORT = 32
#: Shingles of the sets that a task joins at once; larger cells are cut into chunks.
CELL = 1 << 20
#: Sets of a chunked cell that meet all of its chunks at first.
PIVOTS = 16
_STEP = 256


def needed(n: np.ndarray | int, least: Fraction):
    """Shingles that a set of n shares with any it is linked to."""
    return -(-least.numerator * n // least.denominator)


def shared_prefix(n: int, least: Fraction) -> tuple[int, int, int]:
    """Length of a set's prefix, shared shingles in it, and the least that a partner may ask for."""
    need = needed(n, least)
    return n - need + n // 16 + 1, n // 16 + 1, need // 16 + 1


def _marked(width: int, least: Fraction):
    """Size, digest and prefix of every text's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            for start in range(0, whole.num_rows, _STEP):
                batch = whole.slice(start, _STEP)
                found = [shingles.of(t) for t in batch.column("text").to_pylist()]
                digest = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
                prefix = [f[:shared_prefix(len(f), least)[0]].view(np.int64) if len(f) else f.view(
                    np.int64) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"),
                     pa.array([len(f) for f in found], pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "n", "digest", "prefix"])
    return run


def _sets(width: int, wanted: np.ndarray):
    """Digests and sets of the texts whose hash is in a bit table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            h = whole.column("h").to_numpy().view(np.uint64)
            whole = whole.filter(pa.array(bit_set(wanted, h)))
            for start in range(0, whole.num_rows, _STEP):
                batch = whole.slice(start, _STEP)
                found = [shingles.of(t) for t in batch.column("text").to_pylist()]
                digest = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()),
                     pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
                    names=["digest", "tokens"])
    return run


class _Joined:
    """Union of places; the smaller place is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.root(a), self.root(b)))
        if a == b:
            return False
        self.parent[b] = a
        self.label[self.label == b] = a
        return True


def divide_skip(sets: list[np.ndarray], asks: np.ndarray, least: Fraction,
                offered: np.ndarray) -> list[tuple[int, int]]:
    """Links (place, earlier place) that connect all linked sets; ``sets`` by falling size.

    Of two sets that are compared one at least ``asks`` and one is ``offered``. Sets that are
    linked by such comparisons, directly or by way of others, are connected by what is returned.
    """
    size = np.array([len(s) for s in sets])
    place = np.repeat(np.arange(len(sets)), size)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    held = place[order]  # the inverted lists, one after the other
    starts = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])
    ends = np.concatenate([[0], np.cumsum(size)])
    joined, links = _Joined(len(sets)), []
    for q in range(len(sets)):
        n = int(size[q])
        need = int(needed(n, least))
        own = token[ends[q]:ends[q + 1]]
        lists = np.stack([starts[own], starts[own + 1]])
        lists = lists[:, lists[1] - lists[0] > 1]
        if lists.shape[1] < need:
            continue
        lists = lists[:, np.argsort(lists[1] - lists[0], kind="stable")]
        longest = int(lists[1, -1] - lists[0, -1])
        long = min(need - 1, int(need / (0.0085 * np.log2(longest) + 1)))
        short = lists.shape[1] - long
        merged = np.sort(np.concatenate([held[a:b] for a, b in lists[:, :short].T]), kind="stable")
        edge = np.flatnonzero(np.diff(merged, prepend=-1))
        found, count = merged[edge], np.diff(edge, append=len(merged))
        # earlier sets are larger; n of the larger must not be beyond what n allows
        open_ = ((found < q) & (count >= need - long) & (joined.label[found] != joined.label[q])
                 & (asks[found] | asks[q]) & (offered[found] | offered[q])
                 & (size[found] * least.numerator <= n * least.denominator))
        found, count = found[open_], count[open_]
        for a, b in lists[:, short:].T:
            if not len(found):
                break
            at = np.searchsorted(held[a:b], found)
            count += held[a:b][np.minimum(at, b - a - 1)] == found
        up, down = least.numerator, least.denominator
        linked = found[count * down >= (n + size[found] - count) * up]
        for p in linked.tolist():
            if joined.join(q, p):
                links.append((q, p))
    return links


def _cells(least: Fraction):
    """Links of cells; rows come cell by cell, the last cell of a batch waits for the next."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (-len(r[2]), r[1]))
        ids = [r[1] for r in rows]
        found = divide_skip([r[2] for r in rows], np.array([r[3] for r in rows]), least,
                            np.array([r[4] for r in rows]))
        return [(ids[a], ids[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            tokens = batch.column("tokens")
            flat, ends = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            out = []
            for i, (cell, id_, asks, offered) in enumerate(zip(
                    *(batch.column(c).to_pylist() for c in ("cell", "id", "asks", "offered")),
                    strict=True)):
                if kept and kept[0][0] != cell:
                    out += linked(kept)
                    kept = []
                kept.append((cell, id_, flat[ends[i]:ends[i + 1]].copy(), asks, offered))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
        if kept and (out := linked(kept)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
    return run


def _joined_cells(dealt: DataFrame, least: Fraction) -> DataFrame:
    return (dealt.repartition("cell").sortWithinPartitions("cell")
            .select("cell", "id", "tokens", "asks", "offered")
            .mapInArrow(_cells(least), "a bigint, b bigint"))


def _band(n: str, least: Fraction) -> Column:
    """Sizes of linked sets are in the same band or in bands next to each other."""
    width = float(-np.log(float(least) * 0.99))
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(width))


def _cells_of(classes: DataFrame, least: Fraction) -> DataFrame:
    """``cell, id``: cells (a number each) outside of which no class is linked; a class may be in
    two. ``classes``: id, n, prefix."""
    tokens = classes.select("id", F.explode("prefix").alias("token"))
    shared = stage_table(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"),
                         "shared-shingles")
    asked = F.expr(f"(n * {least.numerator} + {least.denominator - 1}) div {least.denominator} "
                   "div 16 + 1")
    met = tokens.join(shared, "token").groupBy("id").agg(
        F.collect_list(F.when(F.col("c") <= SHORT, F.col("token"))).alias("short"),
        F.collect_list(F.when(F.col("c") > SHORT, F.col("token"))).alias("long"))
    met = (met.join(classes.select("id", "n"), "id")
           .withColumn("least", asked).withColumn("most", F.expr("n div 16 + 1"))
           .where(F.size("short") + F.size("long") >= F.col("least"))
           .withColumn("band", _band("n", least)))
    met = stage_table(met, "lists")
    short = met.select("id", "n", "band", "most", F.size("long").alias("longs"),
                       F.explode("short").alias("token"))
    other = short.toDF(*(c if c == "token" else f"{c}_" for c in short.columns))
    pairs = (short.join(other, "token").where("id < id_").where(
        f"least(n, n_) * {least.denominator} >= greatest(n, n_) * {least.numerator}")
        .select(F.col("id").alias("a"), F.col("id_").alias("b"),
                F.greatest("band", "band_").alias("window"),
                (F.least("most", "most_") - F.least("longs", "longs_")).alias("asked"))
        .groupBy("a", "b", "window", "asked").agg(F.count("*").alias("c"))
        .where("c >= asked").select("window", "a", "b"))
    heavy = (met.where(F.size("long") >= F.col("least"))
             .select("id", F.explode(F.array("band", F.col("band") + 1)).alias("window"), "long"))
    heavy = heavy.select("id", "window", F.explode("long").alias("token"))
    first = heavy.groupBy("window", "token").agg(F.min("id").alias("b"))
    ties = (heavy.join(first, ["window", "token"]).where("id > b")
            .select("window", F.col("id").alias("a"), "b").distinct())
    node = "{} * 256 + pmod(window, 256)"
    edges = stage_table(pairs.unionByName(ties).selectExpr(
        f"{node.format('a')} AS a", f"{node.format('b')} AS b"), "ties")
    roots = connected_components(edges)
    cells = roots.select(F.col("root").alias("cell"), F.col("node")).unionByName(
        roots.select(F.col("root").alias("cell"), F.col("root").alias("node")).distinct())
    return cells.select("cell", F.expr("node div 256").alias("id"))


def _linked(cells: DataFrame, classes: DataFrame, sets: DataFrame, least: Fraction,
            cell: int) -> DataFrame:
    """Edges ``a, b`` that connect all linked sets: ``cells`` has cell and id, ``classes`` id, n
    and digest, ``sets`` digest and tokens."""
    cells = stage_table(cells.join(classes.select("id", "n", "digest"), "id"), "members")
    sizes = stage_table(cells.groupBy(F.col("cell").alias("root")).agg(
        F.ceil(F.sum("n") / F.lit(cell)).alias("chunks")), "cells")
    every = [F.lit(True).alias("asks"), F.lit(True).alias("offered")]
    members = sets.join(cells.drop("n"), "digest").drop("digest")
    if sizes.where("chunks > 1").isEmpty():
        return _joined_cells(members.select("cell", "id", "tokens", *every), least)
    dealt = stage_table(
        members.join(sizes.withColumnRenamed("root", "cell"), "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
        .withColumn("pivot", F.lit(False)), "dealt")
    ranked = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(1), "id"), "id")
    pivots = stage_table(
        dealt.where("chunks > 1").select("cell", "id")
        .withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= PIVOTS)
        .select("cell", "id"), "pivots")
    met = (dealt.where("chunks > 1").join(pivots, ["cell", "id"], "left_semi")
           .withColumn("own", F.col("chunk"))
           .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
           .where("chunk <> own").drop("own"))
    name = F.concat_ws(":", "cell", "chunk").alias("cell")
    first = stage_table(_joined_cells(dealt.unionByName(met).select(
        name, "id", "tokens", *every), least), "links")
    roots = connected_components(first)
    labels = (dealt.where("chunks > 1").drop("pivot")
              .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
              .withColumn("root", F.coalesce("root", "id")))
    labels = stage_table(labels, "labelled")
    parts = labels.groupBy("cell", "root").agg(F.count("*").alias("c"))
    main = stage_table(parts.groupBy("cell").agg(
        F.max_by("root", F.struct("c", "root")).alias("main")), "main-parts")
    apart = labels.join(main, "cell").withColumn("apart", F.col("root") != F.col("main"))
    blocks = stage_table(apart.where("apart").groupBy("cell").agg(
        F.ceil(F.sum(F.size("tokens")) / F.lit(cell)).alias("blocks")), "apart")
    apart = apart.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), "blocks"))
    spread = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    asking = apart.where("apart").select(
        "cell", "id", "tokens", F.explode(spread).alias("other"), "block", F.col("chunk"))
    asking = asking.select(
        F.concat_ws(":", "cell", "other", "block").alias("cell"), "id", "tokens",
        F.lit(True).alias("asks"), (F.col("other") == F.col("chunk")).alias("offered"))
    offered = apart.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.col("blocks") - 1)))
    offered = offered.where(~(F.col("apart") & (F.col("at") == F.col("block")))).select(
        F.concat_ws(":", "cell", "chunk", "at").alias("cell"), "id", "tokens",
        F.lit(False).alias("asks"), F.lit(True).alias("offered"))
    second = _joined_cells(asking.unionByName(offered), least)
    return first.unionByName(second)


def near_classes(docs: DataFrame, width: int = SHINGLE, least: Fraction = LEAST,
                 cell: int = CELL) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, root`` of every row.

    ``h`` is a hash of id and whole text, ``root`` tells components apart (null: no words). Rows are linked when their sets of ``width``-word
    shingles, A-Z in lower case, have a similarity of ``least`` or more; fewer words are a
    single shingle. ``component_id`` is the smallest id that can be reached; null ids are never
    the smallest, and a component of null ids only has a null one. Null texts and texts without
    words have no shingles and are linked with nothing. Repeated rows stay rows, and are linked
    with each other as equal texts are. An empty table gives an empty result.
    """
    doc = F.col("doc_id").cast("bigint")
    rows = docs.select(doc.alias("doc_id"), F.xxhash64(doc, "text").alias("h"), "text")
    marked = stage_table(rows.mapInArrow(
        _marked(width, least),
        "doc_id bigint, h bigint, n bigint, digest binary, prefix array<bigint>"), "marked")
    named = marked.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.min("h").alias("h"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"))  # equal digests have equal sets
    classes = stage_table(named.withColumn("id", F.monotonically_increasing_id()), "classes")
    cells = stage_table(_cells_of(classes.select("id", "n", "prefix"), least), "cells")
    # the text of one row stands for its class; a bit too many in the table costs time only
    standing = classes.join(cells.select("id").distinct(), "id", "left_semi")
    bits = bit_table(standing.select(F.col("h").alias("token")))
    sets = stage_table(rows.select("h", "text").mapInArrow(
        _sets(width, bits), "digest binary, tokens array<bigint>").dropDuplicates(["digest"]), "sets")
    links = stage_table(_linked(cells, classes, sets, least, cell), "links")
    roots = connected_components(links)
    placed = stage_table(
        classes.select("id", "digest", "least_id").join(
            roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .select("digest", "least_id", F.coalesce("root", "id").alias("root")), "roots")
    reached = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stage_table(placed.join(reached, "root").select(
        "digest", "component_id", "root"), "named")
    full = marked.select("doc_id", "h", F.col("n").alias("n_shingles"), "digest")
    return (full.where("n_shingles > 0").join(named, "digest").unionByName(
        full.where("n_shingles = 0").withColumns(
            {"component_id": F.col("doc_id"), "root": F.lit(None).cast("bigint")}))
            .select("doc_id", "h", "n_shingles", "component_id", "root"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE,
                    least: Fraction = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see ``near_classes``."""
    return near_classes(docs, width, least).select("doc_id", "n_shingles", "component_id")
