"""Learned vocabularies: token ids by the distinct pieces of all texts.

A byte-pair vocabulary first cuts a text into pieces by a pattern and merges bytes inside each
piece only. So a piece is encoded once, whatever the number of its occurrences: the distinct
pieces are written, encoded in Arrow batches, and joined back. Cutting and joining stay on the
JVM; the equal pieces of a text are counted where the text lies. A piece that very many texts hold is one row of the joined table, so Spark can split
its side of the join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tuneloom.constants import PIECE_PATTERN
from tuneloom.session import stage_table


class RankVocabulary:
    """Byte sequences and their ranks, from a file of ``base64 rank`` lines of a bounded size."""

    def __init__(self, path: str, pattern: str = PIECE_PATTERN):
        self.pattern = pattern
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks,
                                 special_tokens={})


def _pieces(text: str, vocabulary: RankVocabulary):
    # white space as Unicode has it
    return F.regexp_extract_all(F.col(text), F.lit("(?U)" + vocabulary.pattern), F.lit(0))


def piece_ids(pieces: DataFrame, vocabulary: RankVocabulary) -> DataFrame:
    """``piece, ids`` for every distinct value of the column ``piece``, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            ids = [encoder.encode_ordinary(p) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])

    distinct = stage_table(pieces.select("piece").distinct(), "pieces")
    return stage_table(distinct.mapInArrow(run, "piece string, ids array<int>"), "piece-ids")


_TEXTS = 256


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, piece and how often, for each distinct piece of every row."""
    for whole in batches:
        for start in range(0, whole.num_rows, _TEXTS):
            batch = whole.slice(start, _TEXTS)
            held = batch.column("pieces")
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(held), dtype=np.int64), sizes)
            known = held.flatten().dictionary_encode()
            most = max(1, len(known.dictionary))
            found, times = np.unique(row * most + known.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(found // most)),
                 known.dictionary.take(pa.array(found % most)), pa.array(times, pa.int64())],
                names=[batch.schema.names[0], "piece", "times"])


def count_by_pieces(df: DataFrame, vocabulary: RankVocabulary, key: str,
                    text: str = "text") -> DataFrame:
    """``key, n_tokens`` of every row; null texts have none. ``key`` is unique."""
    pieces = df.select(key, _pieces(text, vocabulary).alias("pieces"))
    shape = StructType([pieces.schema[key], StructField("piece", StringType()),
                        StructField("times", LongType())])
    held = stage_table(pieces.mapInArrow(_counted, shape), "held-pieces")
    counts = piece_ids(held, vocabulary).select("piece", F.size("ids").alias("n"))
    found = (held.join(counts, "piece").groupBy(key)
             .agg(F.sum(F.col("n") * F.col("times")).alias("n_tokens")))
    return (df.select(key).join(found, key, "left")
            .select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))


def ids_by_pieces(df: DataFrame, vocabulary: RankVocabulary, key: str,
                  text: str = "text") -> DataFrame:
    """``key, ids`` of every row, in the order of the text; null texts have no ids."""
    held = stage_table(df.select(key, F.posexplode(_pieces(text, vocabulary)).alias("at", "piece")),
                       "placed-pieces")
    part = F.struct("at", "ids")
    found = (held.join(piece_ids(held, vocabulary), "piece").groupBy(key)
             .agg(F.array_sort(F.collect_list(part)).alias("parts")))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return (df.select(key).join(found, key, "left")
            .select(key, F.coalesce(ids, F.array().cast("array<int>")).alias("ids")))
