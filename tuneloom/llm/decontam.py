"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, all other words their lower-case core, so
that a question with other numbers or names has the same template. Windows of ``WINDOW``
template tokens of the documents are hash-joined with those of the benchmark. In an occurrence
of an item in a document (windows in step with each other) windows with the item's own slots
count in any case; those with other slots count if the changes are consistent: one changed
value of the item always stands against the same value in the document.

Items without a telling window, as short or number-heavy ones, are looked up word for word by
their whole sequence of tokens instead.

Document windows are hashed and looked up in a bit table of fixed size, made from all benchmark
windows, where they lie: only hits are written and joined, on the whole template, so false
hits go. Texts never move. Benchmark items of one text are one until the end, and templates
that many document windows hold are joined in parts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.common import row_key, text_key, whole_row
from tuneloom.session import stage_table

WINDOW = 8
#: Windows that must hold so many plain words to tell anything.
LEAST_PLAIN = 4
#: An item is found if this share of its windows is, or a run of words of this many windows.
SHARE, ENOUGH = 0.5, 6
#: Items under so many tokens are found only where they are the whole text.
LEAST_WHOLE = 4
#: A template is joined in parts of so many hits, or of this share of all hits if that is more.
_PART, _PARTS = 1 << 16, 1 << 12
_BITS = 24
#: Words that a task keeps, and texts and their bytes that it takes at a time (one text at least).
_CACHE = 1 << 17
_STEP, _STEP_BYTES = 256, 1 << 20
_NUMBER, _NAME, _UNIT, _QUANTITY, _PLAIN, _NOTHING = range(6)
_SIGNS = ("<NUM>", "<NAME>", "<UNIT>", "<QTY>")
#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres inch inches "
    "foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes "
    "ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars euro euros cent cents usd eur hz khz mhz ghz kb mb gb "
    "tb watt watts kw volt volts mph kmh".split())
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¡¿"
_IS_NUMBER = re.compile(r"[0-9][0-9.,:/]*")
_IS_QUANTITY = re.compile(r"[0-9][0-9.,]*(?:st|nd|rd|th|[a-z]{1,3})")
_ENDS = re.compile(r"[.!?:…][\"'”’»)\]]*$")


class Words:
    """Numbers words of a task; what a word is, whatever stands around it."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.cores: list[str] = []
        self.kinds = bytearray()
        self.ends = bytearray()
        self.hashes = array("Q")

    def number(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = self.known[word] = len(self.cores)
            lower = word.isalpha() and word.islower()
            core = word if lower else word.strip(_EDGE)
            kind = _PLAIN
            if not core:
                kind = _NOTHING
            elif not lower:
                if _IS_NUMBER.fullmatch(core):
                    kind = _NUMBER
                elif core[0].isdigit() and _IS_QUANTITY.fullmatch(core.lower()):
                    kind = _QUANTITY
                elif core[0].isupper() and len(core) > 1 and not core.isupper():
                    kind = _NAME
                core = core.lower()
            if kind == _PLAIN and core in UNITS:
                kind = _UNIT
            self.cores.append(core)
            self.kinds.append(kind)
            self.ends.append(not lower and bool(_ENDS.search(word)))
            self.hashes.append(xxhash.xxh64_intdigest(core))
        return at


_SIGN_HASH = np.array([xxhash.xxh64_intdigest(s) for s in _SIGNS], np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, WINDOW - 1 - i, 1 << 64) for i in range(WINDOW)],
                   np.uint64)


class Templates:
    """The template tokens of a batch of texts, texts one after another."""

    def __init__(self, texts: list[str | None], words: Words):
        ids, starts, of = [], [], []
        for i, text in enumerate(texts):
            for line in (text or "").split("\n"):
                found = line.split()
                if found:
                    starts.append(len(ids))
                    ids += map(words.number, found)
            of.append(len(ids))
        ids = np.array(ids, np.int64)
        kinds = np.frombuffer(words.kinds, np.int8)[ids] if len(ids) else np.empty(0, np.int8)
        first = np.zeros(len(ids), bool)
        first[np.array(starts, np.int64)] = True
        if len(ids):
            first[1:] |= np.frombuffer(words.ends, bool)[ids[:-1]]
        text_of = np.searchsorted(np.array(of), np.arange(len(ids)), side="right")
        kept = kinds != _NOTHING
        self.ids, kinds, first, self.text_of = ids[kept], kinds[kept], first[kept], text_of[kept]
        after = np.zeros(len(kinds), bool)  # directly after a number of the same text
        after[1:] = (kinds[:-1] == _NUMBER) & (self.text_of[1:] == self.text_of[:-1])
        kinds = np.where((kinds == _NAME) & first, _PLAIN, kinds)
        self.kinds = np.where((kinds == _UNIT) & ~after, _PLAIN, kinds)
        self.words = words
        begins = np.searchsorted(self.text_of, np.arange(len(texts)))
        self.place = np.arange(len(self.ids)) - begins[self.text_of] if len(self.ids) \
            else np.empty(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where telling windows start, and their hashes."""
        n = len(self.ids) - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        plain = self.kinds == _PLAIN
        token = np.where(plain, np.frombuffer(self.words.hashes, np.uint64)[self.ids],
                         _SIGN_HASH[np.minimum(self.kinds, _QUANTITY)])
        hashes, count = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for i, power in enumerate(_POWERS):
            hashes += token[i:i + n] * power
            count += plain[i:i + n]
        at = np.flatnonzero((count >= LEAST_PLAIN) & (self.text_of[:n] == self.text_of[WINDOW - 1:]))
        return at, hashes[at]

    def pieces(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``width`` tokens start, and their hashes, slots as they are."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        token = np.frombuffer(self.words.hashes, np.uint64)[self.ids]
        hashes = np.full(n, width, np.uint64)
        for i, power in enumerate(_POWERS[:width]):
            hashes += token[i:i + n] * power
        inside = self.text_of[:n] == self.text_of[width - 1:]
        if width < LEAST_WHOLE:
            inside &= np.bincount(self.text_of)[self.text_of[:n]] == width
        at = np.flatnonzero(inside)
        return at, hashes[at]

    def piece(self, at: int, width: int) -> tuple[str, list[str]]:
        return " ".join(self.words.cores[i] for i in self.ids[at:at + width]), []

    def window(self, at: int) -> tuple[str, list[str]]:
        """Template and slot values of the window that starts there."""
        template, slots = [], []
        for i in range(at, at + WINDOW):
            core, kind = self.words.cores[self.ids[i]], self.kinds[i]
            if kind == _PLAIN:
                template.append(core)
            else:
                template.append(_SIGNS[kind])
                slots.append(core)
        return " ".join(template), slots


def _bit(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - _BITS)).astype(np.int64)


def _batch(found: Templates, batch: pa.RecordBatch, keys: list[str], at: np.ndarray,
           bit: np.ndarray, width: int) -> pa.RecordBatch:
    """Rows of the windows (width 0) or pieces that start at the places given."""
    row = pa.array(found.text_of[at])
    pairs = [found.piece(i, width) if width else found.window(i) for i in at.tolist()]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k).take(row) for k in keys), pa.array(np.full(len(at), width, np.int32)),
         pa.array(found.place[at]), pa.array(bit), pa.array([p[0] for p in pairs], pa.string()),
         pa.array([p[1] for p in pairs], pa.list_(pa.string()))],
        names=[*keys, "width", "place", "bit", "template", "slots"])


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded size, each text whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        most = _STEP_BYTES + (ends[start - 1] if start else 0)
        stop = min(start + _STEP, max(start + 1, int(np.searchsorted(ends, most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def _parsed(batches: Iterator[pa.RecordBatch]):
    words = Words()
    for whole in batches:
        for batch in _steps(whole):
            if len(words.cores) > _CACHE:
                words = Words()
            yield batch, Templates(batch.column("text").to_pylist(), words)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The telling windows of items; pieces that cover all of the items that have none."""
    for batch, found in _parsed(batches):
        at, hashes = found.windows()
        yield _batch(found, batch, ["item"], at, _bit(hashes), 0)
        sizes = np.bincount(found.text_of, minlength=batch.num_rows)
        sizes[found.text_of[at]] = 0
        for width in range(1, WINDOW + 1):
            at, hashes = found.pieces(width)
            here = np.minimum(sizes, WINDOW)[found.text_of[at]] == width
            yield _batch(found, batch, ["item"], at[here], _bit(hashes[here]), width)


def _hits(bits: np.ndarray, widths: list[int]):
    """The document windows and pieces whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _parsed(batches):
            for width in widths:
                at, hashes = found.pieces(width) if width else found.windows()
                bit = _bit(hashes)
                hit = bits[bit >> 3] >> (bit & 7) & 1 == 1
                yield _batch(found, batch, ["doc_id", "key"], at[hit], bit[hit], width)
    return run


def _bit_table(bench: DataFrame) -> np.ndarray:
    """The bits of all benchmark windows, gathered as words of 64: at most 2^18 rows."""
    found = (bench.groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).toArrow())
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.astype("<i8").view(np.uint8)


def _met(hits: DataFrame, bench: DataFrame) -> DataFrame:
    """Hits with the item windows of their template; templates of many hits go in parts."""
    limit = max(_PART, hits.count() // _PARTS)  # so at most _PARTS templates are above it
    hot = F.broadcast(hits.groupBy("width", "template").agg(F.count("*").alias("n"))
                      .where(F.col("n") > limit)
                      .select("width", "template", F.ceil(F.col("n") / limit).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    ours = (hits.join(hot, ["width", "template"], "left")
            .withColumn("part", F.pmod(F.xxhash64("key", "place"), parts)).drop("parts"))
    theirs = (bench.join(hot, ["width", "template"], "left")
              .select("width", "template", "item", F.col("place").alias("item_place"),
                      F.col("slots").alias("item_slots"),
                      F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")))
    return ours.join(theirs, ["width", "template", "part"])


_WINDOW = "width int, place bigint, bit bigint, template string, slots array<string>"


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``key, doc_id, item_id, matched, windows, slots`` of every document and the items in it.

    ``matched`` of an item's ``windows`` stand in the document, in occurrences with ``slots``
    pairs of slot values. An item without a telling window (under ``WINDOW`` tokens, or with
    fewer than ``LEAST_PLAIN`` plain words in each) is found where its whole sequence of tokens
    stands, numbers and names as they are; one under ``LEAST_WHOLE`` tokens only as a whole
    document. Documents are told apart by id and whole text. Null and empty texts, and texts
    without a word, match nothing. Items that repeat an id count as one, found if any of their
    texts is, with the figures of the best matched. Empty tables give an empty result.
    """
    owners = (items.where("item_id IS NOT NULL")
              .select("item_id", text_key(F.col("text")).alias("item"), "text"))
    bench = stage_table(
        owners.groupBy("item").agg(F.first("text").alias("text")).mapInArrow(
            _item_windows, f"item string, {_WINDOW}"), "item-windows")
    widths = sorted(r.width for r in bench.select("width").distinct().collect())
    hits = stage_table(
        docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(
            _hits(_bit_table(bench), widths), f"doc_id bigint, key string, {_WINDOW}"), "hits")
    sizes = bench.groupBy("item").agg(F.count_distinct("place").alias("windows"))
    pairs = F.arrays_zip(F.col("item_slots"), F.col("slots"))
    met = _met(hits.drop("bit"), bench).withColumn("pairs", pairs).withColumn(
        "changes", F.filter("pairs", lambda p: p["item_slots"] != p["slots"]))
    seen = (met.groupBy("key", "doc_id", "item", "width",
                        (F.col("place") - F.col("item_place")).alias("lag"))
            .agg(F.collect_set("item_place").alias("every"),
                 F.collect_set(F.when(F.size("changes") == 0, F.col("item_place"))).alias("same"),
                 F.array_distinct(F.flatten(F.collect_set("changes"))).alias("changes"),
                 F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")))
    sound = F.size(F.array_distinct(F.col("changes.item_slots"))) == F.size("changes")
    places = F.when(sound, F.col("every")).otherwise(F.col("same"))
    found = (seen.withColumn("places", places).groupBy("key", "doc_id", "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("bigint")
        .alias("matched"), F.max(F.size("places")).alias("at_once"),
        F.max(F.size("pairs")).alias("slots"), F.max("width").alias("width")))
    enough = F.when(F.col("width") > 0, F.col("at_once") == F.col("windows")).otherwise(
        (F.col("matched") >= ENOUGH) | (F.col("matched") >= F.lit(SHARE) * F.col("windows")))
    best = F.max(F.struct("matched", "windows", "slots"))
    return (found.join(sizes, "item").where((F.col("matched") > 0) & enough)
            .join(owners.select("item", "item_id").distinct(), "item")
            .groupBy("key", "doc_id", "item_id").agg(best.alias("best"))
            .select("key", "doc_id", "item_id", "best.*"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    leaked = stage_table(find_leaks(docs, items).select(F.col("key").alias("_key")).distinct(),
                         "leaked")
    full = docs.select(whole_row(docs).alias("row"), row_key().alias("_key"))
    return full.join(leaked, "_key", "left_anti").select("row.*")
