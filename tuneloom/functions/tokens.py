"""Tokenizers as column expressions, and the array functions built on them.

A tokenizer offers ``ids(text)`` and ``count(text)`` as columns. ``WordTokenizer``
and ``ByteTokenizer`` are pure expressions; ``PluginTokenizer`` runs any object
with an ``encode`` method (or a callable) through Arrow batches, built once per
task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneloom.constants import IGNORE_LABEL
from tuneloom.functions.text import text_parts, word_begins, words

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


class _Tokenizer:
    def __init__(self, eos_id: int = 2, pad_id: int | None = None, bos_id: int | None = None):
        self.eos_id = eos_id
        self.pad_id = eos_id if pad_id is None else pad_id
        self.bos_id = bos_id

    def _plain_ids(self, text: Column) -> Column:
        raise NotImplementedError

    def _plain_count(self, text: Column) -> Column:
        return F.size(self._plain_ids(text))

    def ids(self, text: Column, specials: bool = True) -> Column:
        ids = self._plain_ids(text)
        if specials and self.bos_id is not None:
            return F.concat(F.array(F.lit(self.bos_id)), ids)
        return ids

    def count(self, text: Column, specials: bool = True) -> Column:
        n = self._plain_count(text)
        return n + 1 if specials and self.bos_id is not None else n


class WordTokenizer(_Tokenizer):
    """White-space words; the id of a word is its CRC-32 without the top bit."""

    def _plain_ids(self, text: Column) -> Column:
        return F.transform(
            words(text), lambda w: F.crc32(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))

    def _plain_count(self, text: Column) -> Column:
        return F.size(words(text))


class ByteTokenizer(_Tokenizer):
    """UTF-8 bytes, ids 0 to 255."""

    def __init__(self, eos_id: int = 256, pad_id: int | None = None, bos_id: int | None = None):
        super().__init__(eos_id, pad_id, bos_id)

    def _plain_ids(self, text: Column) -> Column:
        one_char_per_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
        chars = F.filter(F.split(one_char_per_byte, ""), lambda c: c != "")
        return F.transform(chars, F.ascii)

    def _plain_count(self, text: Column) -> Column:
        return F.octet_length(text)


def encode_text(tokenizer: Any, text: str, specials: bool) -> list[int]:
    """Token ids from an object with ``encode``, or from a plain callable."""
    if hasattr(tokenizer, "encode"):
        try:
            out = tokenizer.encode(text, add_special_tokens=specials)
        except TypeError:
            out = tokenizer.encode(text)
    else:
        out = tokenizer(text)
    if hasattr(out, "ids"):
        out = out.ids
    elif isinstance(out, dict):
        out = out["input_ids"]
    return list(out)


def encode_texts(tokenizer: Any, texts: list[str | None], specials: bool) -> list[list[int] | None]:
    """Token ids of many texts, in one call where the tokenizer has ``encode_batch``."""
    if not hasattr(tokenizer, "encode_batch"):
        return [None if t is None else encode_text(tokenizer, t, specials) for t in texts]
    known = [t for t in texts if t is not None]
    try:
        found = tokenizer.encode_batch(known, add_special_tokens=specials)
    except TypeError:
        found = tokenizer.encode_batch(known)
    ids = iter([list(getattr(f, "ids", f)) for f in found])
    return [None if t is None else next(ids) for t in texts]


class PluginTokenizer(_Tokenizer):
    """Any learned vocabulary. ``factory`` runs once per task, on the executor.

    Vocabulary files reach the executors with ``SparkContext.addFile``; the
    factory opens them through ``SparkFiles.get``.
    """

    def __init__(self, factory: Callable[[], Any], eos_id: int, pad_id: int | None = None):
        super().__init__(eos_id, pad_id)
        self.factory = factory

    def ids(self, text: Column, specials: bool = True) -> Column:
        factory = self.factory

        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = factory()
            for batch in batches:
                yield pd.Series(encode_texts(tokenizer, batch.tolist(), specials), dtype=object)

        return encode(text)

    def count(self, text: Column, specials: bool = True) -> Column:
        factory = self.factory

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = factory()
            for batch in batches:
                found = encode_texts(tokenizer, batch.tolist(), specials)
                yield pd.Series([None if f is None else len(f) for f in found], dtype="Int32")

        return count(text)


def append_eos(ids: Column, eos_id: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos_id)))


def truncate(ids: Column, max_len: int) -> Column:
    """Keep the first ``max_len`` ids; an end marker beyond them is lost."""
    return F.slice(ids, 1, max_len)


def mask_prompt(ids: Column, prompt_len: Column) -> Column:
    """Labels: the prompt part is ignored by the loss, the rest predicts itself."""
    n = F.least(prompt_len, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE_LABEL), n), F.slice(ids, n + 1, F.size(ids)))


def fill_right(values: Column, filler: int, width: Column) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), width - F.size(values)))


def fill_left(values: Column, filler: int, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(filler), width - F.size(values)), values)


def ramp(n: Column) -> Column:
    """``[0 .. n-1]``; empty for n = 0, where ``sequence(0, -1)`` would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))


def position_ids(lens: Column) -> Column:
    """Positions inside a block that restart with every example."""
    return F.flatten(F.transform(lens, ramp))


def cut_completion(ids: Column, max_tokens: Column) -> Column:
    """A request's own share of a generation that ran for the longest request."""
    return F.slice(ids, F.lit(1), F.greatest(max_tokens, F.lit(0)))


def _lists(sizes: np.ndarray, values: pa.Array, missing: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(missing))


def _is_null(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def _spans(texts: pa.Array) -> pa.Array:
    sizes, starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for data, edges in text_parts(texts):
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begins = word_begins(space, edges)
        lasts = word_begins(space[::-1], len(data) - edges[::-1])[::-1]  # a word's last byte
        first, last = np.flatnonzero(begins), np.flatnonzero(lasts)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
        text = np.searchsorted(edges, first, side="right") - 1
        base = chars[edges[text]]
        sizes.append(np.bincount(text, minlength=len(edges) - 1))
        starts.append((chars[first] - base).astype(np.int32))
        ends.append((chars[last + 1] - base).astype(np.int32))
    found = pa.StructArray.from_arrays([np.concatenate(starts), np.concatenate(ends)],
                                       fields=list(_SPAN))
    return _lists(np.concatenate(sizes), found, _is_null(texts))


def word_spans(text: Column) -> Column:
    """Where each white-space word of a text lies: ``array<struct<start, end>>``, end exclusive."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        return _spans(texts)

    return spans(text)


def _rows(column: pa.Array) -> np.ndarray:
    """The row of each element of a list column, as ``flatten`` gives them."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes)


def _places(column: pa.Array, field: str) -> np.ndarray:
    """Rows and places in one number; a row's places lie apart from those of any other."""
    at = column.flatten().field(field).to_numpy(zero_copy_only=False)
    return (_rows(column) << 32) + at


def _masked(ids: pa.Array, spans: pa.Array, loss: pa.Array) -> pa.Array:
    missing = _is_null(ids) | _is_null(spans)
    start, opened, closed = _places(spans, "start"), _places(loss, "start"), _places(loss, "end")
    real = opened < closed
    inside = (np.searchsorted(np.sort(opened[real]), start, side="right")
              > np.searchsorted(np.sort(closed[real]), start, side="right"))
    tokens = ids.flatten().to_numpy(zero_copy_only=False)
    both = ~missing[_rows(ids)], ~missing[_rows(spans)]
    row = _rows(ids)[both[0]]
    if not np.array_equal(row, _rows(spans)[both[1]]):
        raise ValueError("every token must have one span")
    labels = np.where(inside[both[1]], tokens[both[0]], IGNORE_LABEL).astype(np.int32)
    return _lists(np.bincount(row, minlength=len(ids)), pa.array(labels, pa.int32()), missing)


def mask_outside(ids: Column, spans: Column, loss: Column) -> Column:
    """Labels: a token predicts itself if it begins inside one of the ``loss`` spans.

    So a token across a prompt's end belongs to the prompt, wherever a count of the prompt's own
    tokens would have put the border. Each token has one span; loss spans may lie in any order.
    """
    @F.arrow_udf("array<int>")
    def labels(ids: pa.Array, spans: pa.Array, loss: pa.Array) -> pa.Array:
        return _masked(ids, spans, loss)

    return labels(ids, spans, loss)
