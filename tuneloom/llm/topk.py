"""Exact top-k inner-product search by elimination over a pivot table.

For vectors q, x and any pivot p the triangle inequality gives
``|q - x| >= |d(q, p) - d(x, p)|``; the largest such bound over many pivots bounds the
score from above: ``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2``. Candidates are taken in
falling order of this bound until it is below the k-th best score so far; the rest cannot
enter the result.

The pivot table (a row's distances to all pivots) is computed once per row, where the row
lies, and packed with the vectors into blocks of ``BLOCK`` rows. Queries are packed into
blocks as well, and every candidate block meets every query block once: what is shuffled are
whole blocks, and what a task holds is one pair of them. Per task only k rows for a query
remain, which one window merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.common import block_of, blocks_for
from tuneloom.session import stage_table

PIVOTS = 48
#: Pivots are chosen among so many rows, a bounded sample in hash order.
PIVOT_SAMPLE = 4096
BLOCK = 2048
QUERY_BLOCK = 512
#: Candidate rows that one task holds against a query block, block after block.
PART_ROWS = 1 << 15
#: float32 distances are off by less than this share of their size.
SLACK = 1e-6
_CANDIDATES = "ids binary, vectors binary, width bigint, norms binary, dists binary, top double"
_QUERIES = "block bigint, " + _CANDIDATES
_FOUND = "query_id bigint, query bigint, vec_id bigint, score bigint"


def integer_vector(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null unless all components are finite numbers."""
    usable = F.forall(embedding, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(usable, whole)


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other, out of a bounded sample of the rows."""
    found = [r.vector for r in vectors.select("id", "vector").orderBy(F.xxhash64("id"), "vector")
             .limit(PIVOT_SAMPLE).collect()]
    if not found:
        return np.zeros((0, 0))
    rows = _matrix(found)
    chosen, nearest = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    return rows[chosen]


def _matrix(vectors: list) -> np.ndarray:
    """Rows of equal width; a shorter vector continues with zeros."""
    width = max([0, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _widen(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def _pack(ids: list, vectors: list, pivots: np.ndarray) -> dict:
    rows = _matrix(vectors)
    width = max(rows.shape[1], pivots.shape[1])
    wide, far = _widen(rows, width), _widen(pivots, width)
    norms = (rows ** 2).sum(axis=1)
    dists = np.sqrt(np.maximum(0, norms[:, None] + (far ** 2).sum(axis=1) - 2 * wide @ far.T))
    return {"ids": np.asarray(ids, "<i8").tobytes(),
            "vectors": np.asarray([[int(x) for x in v] + [0] * (rows.shape[1] - len(v))
                                   for v in vectors], "<i8").tobytes(),
            "width": rows.shape[1], "norms": norms.astype("<f8").tobytes(),
            "dists": dists.T.astype("<f4").tobytes(),
            "top": float(np.abs(rows).max(initial=0))}


class _Block:
    """An unpacked block; vectors as the narrowest floats that keep all scores exact."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.whole = np.frombuffer(row["vectors"], "<i8").reshape(len(self.ids), row["width"])
        self.norms = np.frombuffer(row["norms"], "<f8")
        self.dists = np.frombuffer(row["dists"], "<f4").reshape(-1, len(self.ids))
        self.top = row["top"]
        self._as: dict = {}

    def vectors(self, kind: type, width: int) -> np.ndarray:
        if (kind, width) not in self._as:
            self._as = {(kind, width): _widen(self.whole, width).astype(kind)}
        return self._as[kind, width]


def _exact_kind(q: _Block, x: _Block, width: int) -> type:
    """A number type in which no score of the two blocks can be rounded."""
    most = q.top * x.top * max(1, width)
    for limit, kind in ((2 ** 24, np.float32), (2 ** 53, np.float64), (2 ** 62, np.int64)):
        if most < limit:
            return kind
    raise ValueError("scores do not fit into 64 bits")


def _bounds(q: _Block, x: _Block) -> np.ndarray:
    """Upper bounds of all scores of a query block against a candidate block."""
    low = np.zeros((len(q.ids), len(x.ids)), np.float32)
    for of_q, of_x in zip(q.dists, x.dists, strict=True):
        np.maximum(low, np.abs(of_q[:, None] - of_x[None, :]), out=low)
    # the tables are rounded: take that off the bound
    reach = SLACK * (q.dists.max(axis=0, initial=0)[:, None] + x.dists.max(axis=0, initial=0))
    low = np.maximum(0, low - reach)
    both = q.norms[:, None] + x.norms
    return (both - low.astype(np.float64) ** 2) / 2 + SLACK * both


def _up_to(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)


def _search(q: _Block, x: _Block, k: int, best: list) -> None:
    """Improve ``best``, per query the k best (score, id), by the candidates of one block."""
    width = max(q.whole.shape[1], x.whole.shape[1])
    kind = _exact_kind(q, x, width)
    mine, theirs, bounds = q.vectors(kind, width), x.vectors(kind, width), _bounds(q, x)
    for i, query in enumerate(mine):
        scores, ids = best[i]
        bound = bounds[i]
        least = scores[-1] if len(scores) == k else -np.inf
        left = np.flatnonzero(bound >= least)
        left = left[np.argsort(-bound[left], kind="stable")]
        at, step = 0, 8 * k
        while at < len(left) and (len(scores) < k or bound[left[at]] >= scores[-1]):
            take = left[at:at + step]
            at, step = at + step, step * 4
            if len(scores) == k:  # the bound falls: what is below the k-th best stays out
                take = take[bound[take] >= scores[-1]]
            take = take[x.ids[take] != q.ids[i]]
            got = theirs[take] @ query
            if len(scores) == k:
                near = got >= scores[-1]
                got, take = got[near], take[near]
            got = np.concatenate([scores, got.astype(np.int64)])
            own = np.concatenate([ids, x.ids[take]])
            order = np.lexsort((own, -got))[:k]
            scores, ids = got[order], own[order]
        best[i] = (scores, ids)


def top_k(rows: DataFrame, queries: Column, k: int, scale: float = 64.0,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest integer inner product for every row that ``queries`` marks.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller id. ``queries`` is a
    condition on the id column. Rows with a null id, a null vector or a component that is null
    or not finite take no part; of vectors of unequal width the shorter one continues with
    zeros. A query does not meet rows with its own id. Repeated candidates each take a rank;
    repeated queries are answered once. No rows or no queries give an empty result. Scores that
    could pass 64 bits raise an error.
    """
    clean = (rows.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("bigint").alias("id"),
                     integer_vector(F.col(vector_col), scale).alias("vector"),
                     F.coalesce(queries, F.lit(False)).alias("asks"))
             .where("vector IS NOT NULL"))
    clean = stage_table(clean, "vectors")
    pivots = choose_pivots(clean)
    asking = clean.where("asks").select("id", "vector").distinct()
    n_blocks = blocks_for(asking.count(), QUERY_BLOCK)
    parts = blocks_for(clean.count(), PART_ROWS)

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= BLOCK:
                yield pa.RecordBatch.from_pylist([_pack(ids[:BLOCK], vectors[:BLOCK], pivots)])
                ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(ids, vectors, pivots)])

    def pack_queries(group: pa.Table) -> pa.Table:
        ids, vectors = group.column("id").to_pylist(), group.column("vector").to_pylist()
        block = group.column("block")[0].as_py()
        return pa.Table.from_pylist([{"block": block} | _pack(ids, vectors, pivots)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, best = None, None, []

        def found() -> pa.RecordBatch:
            n = [len(scores) for scores, _ in best]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(asked.ids, n)),
                pa.array(np.repeat(np.arange(len(n)), n) + (current << 32)),
                pa.array(np.concatenate([ids for _, ids in best])),
                pa.array(np.concatenate([scores for scores, _ in best]).astype(np.int64))],
                names=["query_id", "query", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current:
                    if current is not None:
                        yield found()
                    current = row["block"]
                    asked = _Block({key[2:]: v for key, v in row.items() if key[:2] == "q_"})
                    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked.ids]
                _search(asked, _Block(row), k, best)
        if current is not None:
            yield found()

    table = clean.select("id", "vector").mapInArrow(pack_rows, _CANDIDATES)
    packed = (asking.withColumn("block", block_of(n_blocks, "id", "vector"))
              .groupBy("block").applyInArrow(pack_queries, _QUERIES))
    sides = packed.select("block", _up_to(parts, "part"),
                          *[F.col(c).alias(f"q_{c}") for c in packed.columns if c != "block"])
    pairs = (table.withColumn("part", block_of(parts, "ids"))
             .select("*", _up_to(n_blocks, "block")).join(sides, ["block", "part"])
             .sortWithinPartitions("block", "part"))
    partial = pairs.drop("part").mapInArrow(search, _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
