"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the context, times its share of the class.
The class softmax is log-linear in features of the two tokens before: the last one (bigram),
the one before it (skip) and both together (trigram, hashed). The most frequent words are
classes and context values of their own, all others share hashed ones. How many of each there
are, and how many rows the trigrams hash to, grows with the fifth root of the training tokens
(``Sizes``), so what is gathered from a corpus grows with it. Unknown words are one type, with
the probability that Good and Turing give to unseen words.

One pass over the texts makes chunks of a bounded number of bytes: a chunk holds its distinct
words and its tokens as numbers into them, all as packed bytes, so that a chunk is a short row
for Spark and only the Python task that works on it holds it at length. Everything after works
on chunks:

* word counts: the distinct words of all chunks, summed by word (and joined back, so that no
  task ever holds the vocabulary; counts go to a chunk in packed pieces);
* the statistics of the model, class counts by context, over all training tokens: sparse cells
  in blocks of contexts, on which gradient steps run; each task gives the gradient of its
  blocks, and gradients are summed by feature before the driver gets them;
* scoring: a task gets a few chunks, each after the counts of its words, and takes the softmax
  of the contexts that the chunk holds, a bounded number at a time, and a bounded number of
  tokens at a time for the sums by document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.common import blocks_for, held_out
from tuneloom.session import stage_table

CHUNK_BYTES = 8 << 20
STEPS, RATE, PRIOR = 12, 0.5, 20.0
#: Cells of a softmax that are worked on at once, and of a block of statistics.
_SLICE, _BLOCK = 1 << 20, 1 << 20
#: Distinct cells of statistics that a task gathers before it gives them away.
_GATHER = 1 << 20
#: Texts and bytes taken from a batch at a time (one text at least), words given away at a time,
#: tokens whose scores are summed at a time, counts that a task gathers before it packs them.
_TEXTS, _TEXT_BYTES, _WORDS, _TOKENS, _KNOWN = 256, 1 << 20, 1 << 15, 1 << 18, 1 << 19
#: Chunks that a scoring task gets on average, up to a number of tasks.
_PER_TASK, _TASKS = 2, 1 << 15
#: Stands for the end of a text among the words; no word holds a blank.
END = " "
#: ``words`` are the UTF-8 bytes of all distinct words, most frequent first; ``counts`` their
#: lengths and their counts in training texts.
_CHUNK = ("chunk bigint, doc_ids binary, held binary, lengths binary, tokens binary, "
          "words binary, counts binary")
_BINARY = ("doc_ids", "held", "lengths", "tokens", "codes")


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END.encode()]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress better."""
    planes = np.ascontiguousarray(numbers.astype("<i4").reshape(-1).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _numbers(squeezed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(squeezed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4")[:, 0]


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded size, each text whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        most = _TEXT_BYTES + (ends[start - 1] if start else 0)
        stop = min(start + _TEXTS, max(start + 1, int(np.searchsorted(ends, most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack documents; a chunk ends after the document that fills it."""
    def start():
        return defaultdict(count().__next__), [], [], [], 0

    def close() -> pa.RecordBatch:
        flags = np.array(held, bool)
        lengths = np.array([len(t) for t in tokens], np.int64)
        every = np.concatenate(tokens)
        order = np.argsort(-np.bincount(every, minlength=len(vocabulary)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        every = rank[every]
        learnt = np.bincount(every[np.repeat(~flags, lengths)], minlength=len(order))
        words = [*vocabulary]
        words = [words[i] for i in order.tolist()]
        values = [pa.array(ids, pa.int64()).fill_null(0).to_numpy().tobytes()
                  + np.array([i is None for i in ids], bool).tobytes(), flags.tobytes(),
                  lengths.tobytes(), _squeezed(every),
                  zstandard.ZstdCompressor(level=3).compress(b"".join(words)),
                  _squeezed(np.stack([[len(w) for w in words], learnt]))]
        return pa.RecordBatch.from_arrays(
            [pa.array([first], pa.int64()), *(pa.array([v], pa.binary()) for v in values)],
            names=["chunk", "doc_ids", "held", "lengths", "tokens", "words", "counts"])

    vocabulary, ids, held, tokens, size = start()
    first = None
    for whole in batches:
        for batch in _steps(whole):
            for number, doc, out, text in zip(*(batch.column(c).to_pylist()
                                                for c in ("number", "doc_id", "held", "text")),
                                              strict=True):
                first = number if first is None else first
                words = _tokens(text)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32,
                                          len(words)))
                ids.append(doc)
                held.append(out)
                size += len(text or "") + 1
                if size >= CHUNK_BYTES:
                    yield close()
                    vocabulary, ids, held, tokens, size = start()
                    first = None
    if ids:
        yield close()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: those of a batch are never all Python's at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _words(row: dict) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct words of a chunk and their counts in training texts."""
    lengths, counts = _numbers(row["counts"]).reshape(2, -1)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends),
                                       pa.py_buffer(zstandard.decompress(row["words"]))), counts


def _uses(chunks: DataFrame) -> DataFrame:
    """``chunk, at, word, n``: a row for every distinct word of a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = _words(row)
            for start in range(0, len(words), _WORDS):
                part = words.slice(start, _WORDS)
                at = np.arange(start, start + len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), row["chunk"], np.int64)), pa.array(at), part,
                     pa.array(counts[at].astype(np.int64))], names=["chunk", "at", "word", "n"])

    return chunks.select("chunk", "words", "counts").mapInArrow(
        run, "chunk bigint, at int, word string, n bigint")


class _Chunk:
    def __init__(self, row: dict):
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        n = len(self.lengths)
        self.ids = np.frombuffer(row["doc_ids"], np.int64, n)
        self.no_id = np.frombuffer(row["doc_ids"], bool, n, 8 * n)
        self.held = np.frombuffer(row["held"], bool)
        self.tokens = _numbers(row["tokens"])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)


@dataclass(frozen=True)
class Sizes:
    """Words with a context value or class of their own, hashed ones, rows of trigrams."""

    own_contexts: int
    hashed_contexts: int
    own_classes: int
    hashed_classes: int  # a power of two, so that signed and unsigned hashes agree
    trigrams: int

    @staticmethod
    def of_tokens(tokens: int) -> Sizes:
        own = max(8, round(3 * tokens ** 0.2))
        return Sizes(own, max(4, own // 9), 3 * own, 1 << max(4, (own // 2).bit_length()),
                     32 * own)


class Shape:
    """How words become classes and context values."""

    def __init__(self, frequent: list[str], sizes: Sizes):
        own = [w for w in frequent if w != END]
        self.sizes = sizes
        self.classes = {w: 1 + i for i, w in enumerate(own[:sizes.own_classes])} | {END: 0}
        self.contexts = {w: i for i, w in enumerate(own[:sizes.own_contexts])}
        self.hashed = len(self.classes)
        self.n_classes = self.hashed + sizes.hashed_classes
        self.begin = len(self.contexts) + sizes.hashed_contexts
        self.n_values = self.begin + 1

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some, few = self.sizes.hashed_classes, self.sizes.hashed_contexts
        mixed = [xxhash.xxh64_intdigest(w, 42) for w in words]
        classes = [self.classes.get(w, self.hashed + h % some)
                   for w, h in zip(words, mixed, strict=True)]
        values = [self.contexts.get(w, len(self.contexts) + h // some % few)
                  for w, h in zip(words, mixed, strict=True)]
        return np.array(classes, np.int32), np.array(values, np.int32)

    def of_chunk(self, chunk: _Chunk, classes: np.ndarray,
                 values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and context of every token, from those of the chunk's words."""
        value = values[chunk.tokens]
        begin = np.array([self.begin], np.int32)
        one = np.concatenate([begin, value[:-1]])
        two = np.concatenate([begin, begin, value[:-2]])[:len(value)]
        one[chunk.starts] = self.begin
        two[chunk.starts] = self.begin
        second = chunk.starts[chunk.lengths > 1] + 1
        two[second] = self.begin
        return classes[chunk.tokens], two * self.n_values + one

    def features(self, contexts: np.ndarray) -> np.ndarray:
        """Rows of the weights that a context switches on: bias, bigram, skip, trigram."""
        two, one = contexts // self.n_values, contexts % self.n_values
        hashed = (contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                  >> np.uint64(40)) % np.uint64(self.sizes.trigrams)
        return np.stack([np.zeros_like(one), 1 + one, 1 + self.n_values + two,
                         1 + 2 * self.n_values + hashed.astype(np.int64)], axis=1)

    @property
    def n_features(self) -> int:
        return 1 + 2 * self.n_values + self.sizes.trigrams

    def slices(self, n: int) -> Iterator[slice]:
        """Contexts of a bounded number of cells at a time."""
        step = max(1, _SLICE // self.n_classes)
        return (slice(i, min(i + step, n)) for i in range(0, n, step))


def log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    logits = weights[features[:, 0]]
    for j in range(1, features.shape[1]):
        logits += weights[features[:, j]]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse cells added up: sorted keys and their counts."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    if len(parts) == 1 or not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted keys, and counts, by byte planes."""
    both = np.stack([np.diff(keys, prepend=0), counts]).astype("<i8")
    return zstandard.compress(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes())


def _unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(cells), np.uint8).reshape(2, 8, -1)
    both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return np.cumsum(both[0]), both[1]


_CELLS = "block bigint, cells binary"


def _cells(blocks: list[int], cells: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.binary())],
                                      names=["block", "cells"])


def _statistics(chunks: DataFrame, shape: Shape) -> DataFrame:
    """``block, cells``: counts over all training tokens, keyed by context and class.

    All cells of a context are in one block, a row, which holds some 2^20 cells at most.
    """
    blocks = max(8, shape.n_values ** 2 * shape.n_classes // _BLOCK)

    def give(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = keys // shape.n_classes % blocks
        for b in np.unique(block).tolist():
            yield _cells([b], [_packed(keys[block == b], counts[block == b])])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for row in _rows(batches):
            chunk = _Chunk(row)
            classes, contexts = shape.of_chunk(chunk, *shape.of_words(_words(row)[0].to_pylist()))
            learnt = np.repeat(~chunk.held, chunk.lengths)
            keys = contexts[learnt].astype(np.int64) * shape.n_classes + classes[learnt]
            parts = [_merge([*parts, np.unique(keys, return_counts=True)])]
            if len(parts[0][0]) > _GATHER:
                yield from give(*parts.pop())
        if parts:
            yield from give(*parts[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for block, cells in zip(*batch.to_pydict().values(), strict=True):
                if block != at and parts:
                    yield _cells([at], [_packed(*parts[0])])
                    parts = []
                at = block
                parts = [_merge([*parts, _unpacked(cells)])]
        if parts:
            yield _cells([at], [_packed(*parts[0])])

    return (chunks.drop("chunk").mapInArrow(gather, _CELLS).repartition(blocks, "block")
            .sortWithinPartitions("block").mapInArrow(add, _CELLS))


_ROWS = "feature bigint, value array<float>"


def _by_feature(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values.any(axis=1))
    flat = pa.array(values[at].ravel())
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * values.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(at), pa.ListArray.from_arrays(ends, flat)],
                                      names=["feature", "value"])


def _summed(rows: DataFrame, shape: Shape) -> np.ndarray:
    """Rows by feature, added up in tasks; the driver gets one row a feature."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("value").flatten().to_numpy().reshape(-1, shape.n_classes)
            for feature, value in zip(batch.column("feature").to_pylist(), values, strict=True):
                total[feature] = total[feature] + value if feature in total else value
        if total:
            flat = pa.array(np.concatenate(list(total.values())))
            ends = pa.array(np.arange(len(total) + 1, dtype=np.int32) * shape.n_classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.ListArray.from_arrays(ends, flat)],
                names=["feature", "value"])

    got = rows.repartition(8, "feature").mapInArrow(add, _ROWS).toArrow()
    whole = np.zeros((shape.n_features, shape.n_classes), np.float32)
    if got.num_rows:
        value = got.column("value").combine_chunks().flatten().to_numpy()
        whole[got.column("feature").to_numpy()] = value.reshape(-1, shape.n_classes)
    return whole


def _observed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.n_features * shape.n_classes)
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                keys, counts = _unpacked(cells)
                on = shape.features(keys // shape.n_classes)
                for j in range(on.shape[1]):
                    total += np.bincount(on[:, j] * shape.n_classes + keys % shape.n_classes,
                                         counts, len(total))
        yield _by_feature(total.astype(np.float32).reshape(shape.n_features, shape.n_classes))
    return run


def _expected(shape: Shape, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(weights)
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                keys, counts = _unpacked(cells)
                first = np.flatnonzero(np.diff(keys // shape.n_classes, prepend=-1))
                contexts = keys[first] // shape.n_classes
                tokens = np.add.reduceat(counts, first).astype(np.float32)
                for part in shape.slices(len(contexts)):
                    on = shape.features(contexts[part])
                    guess = np.exp(log_softmax(weights, on)) * tokens[part, None]
                    for j in range(on.shape[1]):
                        order = np.argsort(on[:, j], kind="stable")
                        rows = on[order, j]
                        starts = np.flatnonzero(np.diff(rows, prepend=-1))
                        total[rows[starts]] += np.add.reduceat(guess[order], starts, axis=0)
        yield _by_feature(total)
    return run


def train(statistics: DataFrame, shape: Shape, steps: int = STEPS) -> np.ndarray:
    """Weights by distributed gradient steps: tasks give gradients of their contexts, which are
    summed by feature; each weight moves by its gradient over its expected count plus a prior.
    """
    rows = stage_table(statistics, "statistics")
    observed = _summed(rows.mapInArrow(_observed(shape), _ROWS), shape)
    weights = np.zeros_like(observed)
    base = observed[0].astype(np.float64) + 0.1  # the bias is on in all contexts
    weights[0] = np.log(base / base.sum())
    for _ in range(steps):
        expected = _summed(rows.mapInArrow(_expected(shape, weights), _ROWS), shape)
        weights += RATE * (observed - expected) / (np.maximum(observed, expected) + PRIOR)
    return weights


def score_corpus(docs: DataFrame, folds: int = 10, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    Trained on whole texts outside the held-out fold. A null text is an empty one: one end
    token. ``base_score`` is the add-0.1 unigram log10 probability, ``score`` that of the model;
    without training tokens both are that of the unseen word. Repeated rows stay rows.
    """
    out = held_out(F.col("doc_id"), folds)
    chunks = stage_table(
        docs.select(F.monotonically_increasing_id().alias("number"), "doc_id",
                    out.alias("held"), "text").mapInArrow(_chunks, _CHUNK), "chunks")
    uses = _uses(chunks)
    counts = stage_table(uses.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct, once = counts.agg(F.sum("c"), F.count("*"),
                                       F.count(F.when(F.col("c") == 1, 1))).first()
    total = total or 0
    sizes = Sizes.of_tokens(total)
    frequent = [r.word for r in counts.orderBy(F.desc("c"), "word")
                .limit(sizes.own_classes + 1).collect()]
    shape = Shape(frequent, sizes)
    weights = train(_statistics(chunks, shape), shape, steps) if total else None
    hashed = (F.pmod(F.xxhash64("word"), F.lit(sizes.hashed_classes)))
    own = F.col("word").isin(list(shape.classes))
    mass = {r.h: r.m for r in counts.where(~own).groupBy(hashed.alias("h"))
            .agg(F.sum(F.col("c") + 0.1).alias("m")).collect()}
    masses = np.array([mass.get(h, 0.0) for h in range(sizes.hashed_classes)])
    known = uses.select("chunk", "at", "word").join(counts, "word").select("chunk", "at", "c")
    model = {"total": total, "distinct": distinct, "once": once, "weights": weights,
             "shape": shape, "masses": masses}
    tasks = min(blocks_for(chunks.count(), _PER_TASK), _TASKS)
    return (known.mapInArrow(_pieces, _PIECE)
            .unionByName(chunks.mapInArrow(_coded(shape), _PIECE)).repartition(tasks, "chunk")
            .sortWithinPartitions("chunk", "whole")
            .mapInArrow(_scorer(model), "doc_id bigint, held_out boolean, n_tokens bigint, "
                        "n_known bigint, train_tokens bigint, base_score double, score double"))


#: Pieces of a chunk: the counts of some of its words (in ``codes``), or the chunk itself with
#: the classes and context values of its words, which sorts last.
_PIECE = "chunk bigint, whole boolean, " + ", ".join(f"{c} binary" for c in _BINARY)
_COUNT = np.dtype([("at", "<i4"), ("c", "<i8")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The training counts of words, brought together by chunk."""
    def give(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        chunks, at, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, chunks))
        chunks, cells = chunks[order], np.empty(len(order), _COUNT)
        cells["at"], cells["c"] = at[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]]))
        ends = (np.append(first, len(chunks)) * _COUNT.itemsize).astype(np.int32)
        n = len(first)
        codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends),
                                                       pa.py_buffer(cells)])
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks[first]), pa.array(np.zeros(n, bool)),
             *[pa.nulls(n, pa.binary())] * (len(_BINARY) - 1), codes],
            names=["chunk", "whole", *_BINARY])

    parts, size = [], 0
    for batch in batches:
        parts.append(tuple(batch.column(x).to_numpy() for x in ("chunk", "at", "c")))
        size += batch.num_rows
        if size >= _KNOWN:
            yield give(parts)
            parts, size = [], 0
    if size:
        yield give(parts)


def _coded(shape: Shape):
    """Chunks with the classes and context values of their words in place of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            row["codes"] = _squeezed(np.stack(shape.of_words(_words(row)[0].to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]], pa.int64()), pa.array([True]),
                 *(pa.array([row[c]], pa.binary()) for c in _BINARY)],
                names=["chunk", "whole", *_BINARY])
    return run


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = []
        for row in _rows(batches):
            if row["whole"]:
                yield _scored(row, known, model)
                known = []
            else:
                known.append(np.frombuffer(row["codes"], _COUNT))
    return run


def _class_logs(shape: Shape, weights: np.ndarray, classes: np.ndarray,
                contexts: np.ndarray) -> np.ndarray:
    """log10 probability of every token's class in its context, each context worked out once."""
    here = np.zeros(shape.n_values ** 2, bool)
    here[contexts] = True
    distinct = np.flatnonzero(here)
    rank = (np.cumsum(here, dtype=np.int32) - 1)[contexts]
    out = np.empty(len(contexts), np.float32)
    for part in shape.slices(len(distinct)):
        logs = log_softmax(weights, shape.features(distinct[part]))
        at = np.flatnonzero((rank >= part.start) & (rank < part.stop))
        out[at] = logs[rank[at] - part.start, classes[at]]
    return out / np.float32(np.log(10))


def _scored(row: dict, known: list[np.ndarray], model: dict) -> pa.RecordBatch:
    chunk, shape, total = _Chunk(row), model["shape"], model["total"]
    classes, values = _numbers(row["codes"]).reshape(2, -1)
    c = np.zeros(len(classes))
    for counts in known:
        c[counts["at"]] = counts["c"]
    seen = c > 0
    base = np.log10((c + 0.1) / (total + 0.1 * (model["distinct"] + 1)))
    logs = None
    if model["weights"] is not None:
        new = min(0.5, max(model["once"], 0.1) / (total + 0.1))
        inside = classes - shape.hashed
        mass = model["masses"][np.maximum(inside, 0)]
        share = np.log10(np.where(seen & (inside >= 0), (c + 0.1) / np.maximum(mass, 0.1), 1.0))
        share = np.where(seen, share + np.log10(1 - new), np.log10(new))
        logs = _class_logs(shape, model["weights"], *shape.of_chunk(chunk, classes, values))
    n_known = np.zeros(len(chunk.ids), np.int64)
    bases, scores = np.zeros(len(chunk.ids)), np.zeros(len(chunk.ids))
    for start in range(0, len(chunk.tokens), _TOKENS):
        part = chunk.tokens[start:start + _TOKENS]
        docs = slice(np.searchsorted(chunk.starts, start, side="right") - 1,
                     np.searchsorted(chunk.starts, start + len(part)))
        cuts = np.maximum(chunk.starts[docs] - start, 0)
        here = seen[part]
        n_known[docs] += np.add.reduceat(here, cuts, dtype=np.int64)
        bases[docs] += np.add.reduceat(base[part], cuts)
        if logs is not None:
            scores[docs] += np.add.reduceat(
                share[part] + np.where(here, logs[start:start + len(part)], 0), cuts)
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids, mask=chunk.no_id), pa.array(chunk.held), pa.array(chunk.lengths),
         pa.array(n_known), pa.array(np.full(len(chunk.ids), total, np.int64)),
         pa.array(bases), pa.array(bases if logs is None else scores)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
               "score"])
