"""Ranked lexical search for many queries at once, by common-subexpression evaluation.

The score of a document for an item is a sum over the item's terms. Items share terms, and sets
of terms. From the items a sharing plan is mined: the pair of summands that most items have in
common becomes a summand of its own, again and again, until no pair is left that two items
share. So every shared set of terms is one node, the sum of two smaller ones, and items are sums
of nodes: a graph in which every partial sum is made once.

The documents are read twice. The first pass cuts the whole texts into terms and writes a narrow
table: length, and the frequencies of the terms that items have. The second evaluates the graph
for a batch of documents at a time, one accumulator of the batch per node, and keeps the best
documents of each item. A task reports those only, so what is shuffled follows the items.

Items are taken in blocks of bounded size; every block is a pass over all documents.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.common import block_of, blocks_for
from tuneloom.session import stage_table

TOP = 20
#: Characters of the items that are planned, and looked up in every task, at once.
ITEM_CHARS = 1 << 18
#: Accumulators, nodes times documents, that a task holds at once.
CELLS = 1 << 22
#: Units of an item among which shared pairs are looked for.
PAIRED = 128
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
               else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_SPLIT).split()


class Plan:
    """The sharing graph of a block of items.

    The first nodes are units: a term, or 2, 4, 8 … times a term, of which an item takes those
    that make up how often it holds the term. Every later node is the sum of two earlier ones
    (``sums``), and ``parts`` has the nodes whose sum is an item's score.
    """

    def __init__(self, items: list[bytes | None]):
        counted = [Counter(terms(t)) for t in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        bags = [{(self.vocabulary[t], bit) for t, n in c.items()
                 for bit in range(n.bit_length()) if n >> bit & 1} for c in counted]
        units = sorted(set().union(*bags))
        place = {unit: i for i, unit in enumerate(units)}
        self.term = np.array([t for t, _ in units], np.int64)
        self.shift = np.array([[bit] for _, bit in units], np.int64).reshape(-1, 1)
        self.sums: list[tuple[int, int]] = []
        # pairs are looked for within parts of a long item only, so that there are not too many
        bags = [{place[unit]: place[unit] % max(1, len(bag) // PAIRED) for unit in bag}
                for bag in bags]
        self._share(bags)
        self.parts = [sorted(bag) for bag in bags]

    def _share(self, bags: list[dict[int, int]]) -> None:
        """Replace pairs of summands by their sum; a bag has the summands of an item by part."""
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, bag in enumerate(bags):
            split = defaultdict(list)
            for unit in sorted(bag):
                split[bag[unit]].append(unit)
            for units in split.values():
                for pair in combinations(units, 2):
                    where[pair].add(i)
        heap = [(-len(held), pair) for pair, held in where.items() if len(held) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            held = where[pair]
            if len(held) < -count:  # some of its items have used a summand otherwise
                if len(held) > 1:
                    heapq.heappush(heap, (-len(held), pair))
                continue
            node = len(self.term) + len(self.sums)
            self.sums.append(pair)
            fresh = set()
            for i in sorted(held):
                bag = bags[i]
                part = bag.pop(pair[0])
                bag.pop(pair[1])
                for other in [unit for unit, own in bag.items() if own == part]:
                    for gone in pair:
                        where[min(gone, other), max(gone, other)].discard(i)
                    where[other, node].add(i)
                    fresh.add((other, node))
                bag[node] = part
            where[pair] = set()
            for new in sorted(fresh):
                if len(where[new]) > 1:
                    heapq.heappush(heap, (-len(where[new]), new))

    @property
    def size(self) -> int:
        return len(self.term) + len(self.sums)

    def scores(self, summands: np.ndarray) -> np.ndarray:
        """Scores, a row per item, from what each term (a row) adds to each document."""
        base = len(self.term)
        nodes = np.empty((self.size, summands.shape[1]), np.int64)
        np.left_shift(summands[self.term], self.shift, out=nodes[:base])
        for i, (a, b) in enumerate(self.sums):
            np.add(nodes[a], nodes[b], out=nodes[base + i])
        out = np.zeros((len(self.parts), summands.shape[1]), np.int64)
        for row, parts in zip(out, self.parts, strict=True):
            for node in parts:
                row += nodes[node]
        return out


class _Best:
    """The best documents of every item: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items
        self.least = np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        full = self.least[:, None]
        hit = (scores >= full) & (scores > 0)
        for i in np.flatnonzero(hit.any(axis=1)):
            at = np.flatnonzero(hit[i])
            s, d, n = (np.concatenate(x) for x in zip(
                self.held[i], (scores[i, at], ids[at], null[at]), strict=True))
            order = np.lexsort((d, n, -s))[:self.top]
            self.held[i] = s[order], d[order], n[order]
            if len(order) == self.top:
                self.least[i] = s[order[-1]]

    def rows(self, names: list[int | None]) -> pa.RecordBatch:
        item = [name for name, held in zip(names, self.held, strict=True) for _ in held[0]]
        score, doc, null = (np.concatenate(x) for x in zip(*self.held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(doc, mask=null), pa.array(score)],
            names=["item_id", "doc_id", "score"])


def _frequencies(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, nodes, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                found = sorted((vocabulary[t], n) for t, n in Counter(words).items()
                               if t in vocabulary)
                lengths.append(len(words))
                nodes.append([t for t, _ in found])
                counts.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()),
                 pa.array(nodes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tf"])
    return run


def _ranked(plan: Plan, weights: np.ndarray, n_docs: int, all_terms: int,
            names: list[int | None], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(names), top)
        step = max(1, CELLS // plan.size)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                n = batch.column("n").to_numpy()
                m = 100 - 25 + 25 * n * n_docs // max(1, all_terms)
                held = batch.column("terms").flatten().to_numpy()
                tf = batch.column("tf").flatten().to_numpy()
                size = np.diff(batch.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), size)
                summands = np.zeros((len(weights), len(n)), np.int64)
                summands[held, doc] = weights[held] * (1_000_000_000 * tf // (
                    1000 * tf + 12 * m[doc]))
                ids = batch.column("doc_id")
                best.add(plan.scores(summands), ids.fill_null(0).to_numpy(),
                         ids.is_null().to_numpy(zero_copy_only=False))
        yield best.rows(names)
    return run


def _block(docs: DataFrame, names: list[int | None], texts: list[bytes | None],
           top: int) -> DataFrame:
    plan = Plan(texts)
    spark = docs.sparkSession
    counted = stage_table(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.col("text").cast("binary").alias("text"))
        .mapInArrow(_frequencies(plan.vocabulary),
                    "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"), "frequencies")
    n_docs, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = F.col("df").cast("double")
    # as many rows as the block has terms
    weighed = (counted.select(F.explode("terms").alias("term")).groupBy("term")
               .agg(F.count("*").alias("df"))
               .select("term", F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))
                       .cast("bigint").alias("w"))).toArrow()
    weights = np.zeros(len(plan.vocabulary), np.int64)
    weights[weighed.column("term").to_numpy()] = weighed.column("w").to_numpy()
    if not n_docs or not plan.vocabulary:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    return counted.mapInArrow(_ranked(plan, weights, n_docs, all_terms, names, top),
                              "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP,
           item_chars: int = ITEM_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every item, best first.

    Whole texts count, whatever their length. Null and term-less documents are found by nothing,
    items without terms find nothing, and scores of 0 are no results. Every row of ``docs`` is a
    document; rows that repeat are ranked one after the other, and null ids come after all
    others of equal score. An item's row that repeats its id and text is one item; rows with an
    equal id and other texts are ranked apart, under that id. Empty tables give an empty result.
    Other columns are not looked at.
    """
    asked = stage_table(items.select(F.col("item_id").cast("bigint").alias("item_id"),
                                     F.col("text").cast("binary").alias("text")).distinct(),
                        "items")
    chars = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    blocks = blocks_for(chars, item_chars)
    found = None
    for block in range(blocks):
        rows = (asked.where(block_of(blocks, "item_id", "text") == block)
                .orderBy("item_id", "text").collect())
        if not rows:
            continue
        # items of one id are told apart by their place
        one = _block(docs, list(range(len(rows))), [r["text"] for r in rows], top)
        named = docs.sparkSession.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)], "item bigint, item_id bigint")
        one = (one.withColumnRenamed("item_id", "item").withColumn("block", F.lit(block))
               .join(F.broadcast(named), "item"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("block", "item").orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))
