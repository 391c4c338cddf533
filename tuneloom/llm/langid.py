"""Language identification by compression with per-language dictionaries.

Each language gets a raw-content zstandard dictionary of its own texts. A text is compressed
with every dictionary, piece by piece so that a long text stays comparable throughout, and the
language of the smallest output wins. Outputs of dictionaries of unequal size count in units of
what a dictionary of that size leaves of texts in other languages. Texts without a letter, and texts whose two best outputs
are too close, are rejected as ``und``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.llm.common import held_out
from tuneloom.session import stage_table

UNKNOWN = "und"
#: The dictionaries hold at most so many bytes, from so many labelled texts a language (the
#: first ones in hash order), each with so many characters from a place that its id's hash names:
#: the bounded sample that is fitted.
DICTIONARY_BYTES = 1 << 16
SAMPLE_TEXTS = 500
SAMPLE_CHARS = 4000
PIECE = 2048
#: Texts a language, and languages with the largest dictionaries, on which the size of the dictionaries is corrected for.
BASE_TEXTS = 20
BASE_LANGUAGES = 6
#: Texts a language from which the margin is chosen, and its place among their margins.
MARGIN_TEXTS = 200
UNTAUGHT, CLEAN = 0.95, 0.01
#: Match search that does not change with the size of what is compressed, as levels do.
SEARCH = {"strategy": zstandard.STRATEGY_GREEDY, "window_log": 18, "hash_log": 17,
          "chain_log": 17, "search_log": 3, "min_match": 4}
#: Bytes by which one output must be smaller for the odds to rise e-fold.
TEMPERATURE = 4.0


def _taught(docs: DataFrame, learn: Column) -> tuple[DataFrame, list[str]]:
    """What each language teaches, and the languages, the one with most rows first.

    From the rows ``learn`` marks. The sample is drawn by a hash threshold from counted rows, then
    cut in hash order, so that no language gathers more than SAMPLE_TEXTS pieces of whole texts.
    Texts without a word teach nothing. A language's pieces meet in one task, which leaves its
    dictionary, that of every second piece, and some of the pieces.
    """
    length = F.length("text")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(length - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\S")).select(
        F.col("lang").alias("language"),
        F.substr("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece"),
        F.abs(F.xxhash64("doc_id") % F.lit(1 << 30)).alias("draw"))
    counts = {r.language: r.n for r in rows.groupBy("language").agg(F.count("*").alias("n"))
              .collect()}
    share = F.create_map(*[x for k, n in counts.items()
                           for x in (F.lit(k), F.lit(min(1.0, 2 * SAMPLE_TEXTS / n)))]
                         or [F.lit(""), F.lit(0.0)])
    drawn = rows.where(F.col("draw") < share[F.col("language")] * (1 << 30))
    order = Window.partitionBy("language").orderBy("draw", "piece")
    sample = (drawn.select("language", "draw", "piece").distinct()
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_TEXTS))
    tested = _tested(len(counts))

    def learn_one(group: pa.Table) -> pa.Table:
        pieces = [p for p in group.sort_by("rank").column("piece").to_pylist() if p.strip()]
        return pa.Table.from_pylist([{
            "language": group.column("language")[0].as_py(), "dictionary": _dictionary(pieces),
            "pieces": pieces[:BASE_TEXTS], "half": _dictionary(pieces[::2]),
            "half_pieces": pieces[::2][:BASE_TEXTS], "tested": pieces[1::2][:tested]}], _TAUGHT)

    taught = sample.groupBy("language").applyInArrow(
        learn_one, "language string, dictionary binary, pieces array<string>, half binary, "
        "half_pieces array<string>, tested array<string>")
    return stage_table(taught, "languages"), sorted(counts, key=lambda k: (-counts[k], k))


_TAUGHT = pa.schema([("language", pa.string()), ("dictionary", pa.binary()),
                     ("pieces", pa.list_(pa.string())), ("half", pa.binary()),
                     ("half_pieces", pa.list_(pa.string())), ("tested", pa.list_(pa.string()))])


def _tested(languages: int) -> int:
    """Texts of a language that the margin is learnt from; 1,000 of all, but one each."""
    return max(1, min(MARGIN_TEXTS, 1000 // max(1, languages)))


def _dictionary(pieces: list[str]) -> bytes:
    """The distinct words of a sample, the most frequent ones last, where they are cheapest to
    refer to: as much of them as a dictionary holds, whatever other languages have."""
    words = Counter(w for t in pieces for w in t.lower().split())
    joined = " ".join(sorted(words, key=lambda w: (words[w], w))).encode("utf-8", "replace")
    return joined[-DICTIONARY_BYTES:]


def _column(taught: DataFrame, languages: list[str], name: str) -> dict:
    """One column of what is taught, by language; empty dictionaries stay out."""
    found = {r.language: r[name] for r in taught.select("language", name).collect() if r[name]}
    return {k: found[k] for k in languages if k in found}


def _baselines(taught: DataFrame, name: str, dictionaries: dict[str, bytes]) -> dict[str, float]:
    """What dictionaries of each one's size leave of other languages' texts; 1 for the largest.

    Measured with the dictionaries of BASE_LANGUAGES languages cut to powers of two, and
    interpolated, so that dictionaries of equal size count alike.
    """
    sizes = {k: len(v) for k, v in dictionaries.items()}
    largest = max(sizes.values(), default=0)
    if min(sizes.values(), default=0) == largest:
        return dict.fromkeys(sizes, 1.0)
    levels = [1 << i for i in range(4, 17, 2) if 1 << i < largest] + [largest]
    by_size = sorted(sizes, key=lambda k: -sizes[k])[:BASE_LANGUAGES]
    pieces = _column(taught.where(F.col("language").isin(by_size)), by_size, name)
    texts = [(k, t) for k in by_size for t in pieces.get(k, [])]
    left = []
    for level in levels:
        coders = Coders({k: dictionaries[k][-level:] for k in by_size if sizes[k] >= level})
        found = [(n, whole) for language, text in texts
                 for whole in (len(text.encode("utf-8", "replace")),)
                 for other, n in coders.sizes(text).items() if other != language]
        left.append(sum(n for n, _ in found) / max(1, sum(w for _, w in found)))
    share = np.interp(np.log2(list(sizes.values())), np.log2(levels), np.array(left) / left[-1])
    return dict(zip(sizes, share.tolist(), strict=True))


def _margin(taught: DataFrame, languages: list[str]) -> float:
    """The margin under which a text is taken for one of an untaught language.

    One half of the sample is compared with dictionaries of the other. Without the dictionary of
    its own language a text stands for an untaught one: the margin lies above UNTAUGHT of these,
    but under all save CLEAN of the right answers that do not tie. Two languages leave no such
    comparison, so half of what the right answers allow is taken.
    """
    dictionaries = _column(taught, languages, "half")
    coders = Coders(dictionaries, _baselines(taught, "half_pieces", dictionaries))
    right, untaught = [], []
    for language, texts in _column(taught, languages, "tested").items():
        for text in texts:
            if not any(c.isalpha() for c in text):
                continue
            ranked = coders.ranked(text)
            if len(ranked) > 1 and ranked[0][1] == language and ranked[1][0] > ranked[0][0]:
                right.append(ranked[1][0] / ranked[0][0] - 1)
            others = [n for n, k in ranked if k != language]
            if len(others) > 1:
                untaught.append(others[1] / others[0] - 1)
    if not right:
        return 0.0
    clean = float(np.quantile(right, CLEAN, method="lower"))
    return min(clean, float(np.quantile(untaught, UNTAUGHT))) if untaught else clean / 2


class Model(NamedTuple):
    """What is learnt from the labelled sample."""

    dictionaries: dict[str, bytes]
    baselines: dict[str, float]
    margin: float


def learn_model(docs: DataFrame, learn: Column, margin: float | None = 0.0) -> Model:
    """Raw dictionaries by language, the one with most rows first, their baselines, a margin.

    Without a ``margin`` it is learnt. The driver holds a dictionary a language, the pieces of
    BASE_LANGUAGES of them and, to learn a margin, some 1,000 pieces.
    """
    taught, languages = _taught(docs, learn)
    dictionaries = _column(taught, languages, "dictionary")
    return Model(dictionaries, _baselines(taught, "pieces", dictionaries),
                 _margin(taught, languages) if margin is None else margin)


class Coders:
    """One compressor a language, made once per task."""

    def __init__(self, dictionaries: dict[str, bytes], baselines: dict[str, float] | None = None):
        self.coders = {}
        self.baselines = baselines or dict.fromkeys(dictionaries, 1.0)
        search = zstandard.ZstdCompressionParameters(
            write_content_size=False, write_dict_id=False, **SEARCH)
        for language, content in dictionaries.items():
            shared = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=search)
            self.coders[language] = zstandard.ZstdCompressor(
                dict_data=shared, compression_params=search)

    def sizes(self, text: str) -> dict[str, int]:
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
        return {language: sum(len(coder.compress(p)) for p in pieces)
                for language, coder in self.coders.items()}

    def ranked(self, text: str) -> list[tuple[float, str]]:
        """Corrected outputs and their languages, the smallest first."""
        return sorted(((n / self.baselines[language], language)
                       for language, n in self.sizes(text).items()), key=lambda r: r[0])

    def predict(self, text: str | None, margin: float = 0.0) -> tuple[str, float]:
        """Language and the odds of it among all; ``und`` and 0 for a rejected text."""
        if not self.coders or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        ranked = self.ranked(text)
        least = ranked[0][0]
        if len(ranked) > 1 and ranked[1][0] - least < margin * least:
            return UNKNOWN, 0.0
        odds = sum(math.exp(min(0.0, (least - n) / TEMPERATURE)) for n, _ in ranked)
        return ranked[0][1], 1.0 / odds


def _classifier(model: Model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(model.dictionaries, model.baselines)
        for batch in batches:
            found = [coders.predict(t, margin) for t in batch.column("text").to_pylist()]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i, n in enumerate(names) if n != "text"),
                 pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=[*(n for n in names if n != "text"), "lang_pred", "score"])
    return run


def identify(docs: DataFrame, folds: int = 5, margin: float = 0.0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    Learned from rows outside the held-out fold that have a language and a text. Null texts and
    texts without a letter give ``und`` and score 0, as do texts whose two smallest outputs
    differ by less than ``margin`` of the smallest; equal sizes go to the
    language that more rows teach. Without any language to learn everything is ``und``. Repeated rows stay rows.
    """
    out = held_out(F.col("doc_id"), folds)
    model = learn_model(docs.select("doc_id", "text", "lang"), ~out)
    return (docs.select("doc_id", out.alias("held_out"), "text")
            .mapInArrow(_classifier(model, margin),
                        "doc_id bigint, held_out boolean, lang_pred string, score double"))


def keep_identified(docs: DataFrame, folds: int = 5, margin: float | None = None) -> DataFrame:
    """The documents that are not rejected, with all their columns; rows stay where they lie.

    Without a ``margin`` the one learnt from the training fold holds; then texts whose two
    smallest outputs tie are rejected too. If no row teaches a language, nothing can be told
    apart and only null texts and texts without a letter go.
    """
    model = learn_model(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id"), folds),
                        margin)
    least = max(model.margin, 1e-9) if margin is None else margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(model.dictionaries, model.baselines)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield batch.filter(pa.array(
                [coders.predict(t, least)[0] != UNKNOWN for t in texts], pa.bool_()))

    if not model.dictionaries:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(run, docs.schema)
