"""Text column functions. All stay on the JVM side but those that count or place words, which
read the bytes of many texts at once in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
_ASCII_WORD = r"\S+"
# Unicode white space in UTF-8 beyond ASCII
_WIDE_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
               + "".join(map(chr, range(0x2000, 0x200b)))]
#: Bytes of texts that are looked at in one go; a longer text goes alone.
_GO = 1 << 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_present(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def strip(col: Column | str) -> Column:
    """Cut Unicode white space off both ends (``trim`` only knows the blank)."""
    left = F.regexp_replace(_col(col), f"(?U)^{_SPACE}+", "")
    return F.regexp_replace(left, f"(?U){_SPACE}+$", "")


def norm_label(col: Column | str) -> Column:
    """Lower case, ``_`` and ``-`` as blanks, runs of white space as one blank."""
    plain = F.translate(F.lower(_col(col)), "_-", "  ")
    return F.trim(F.regexp_replace(plain, f"(?U){_SPACE}+", " "))


def preview(col: Column | str, width: int = 80) -> Column:
    return F.substring(_col(col), 1, width)


def words(col: Column | str) -> Column:
    return F.regexp_extract_all(_col(col), F.lit(_ASCII_WORD), F.lit(0))


def text_parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of texts and where each begins and ends in them, in parts of bounded size."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _GO, side="right")) - 1)
        yield data[ends[start]:ends[stop]], ends[start:stop + 1] - ends[start]
        start = stop


def _is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a character that is Unicode white space."""
    space = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32))
    for lead in {c[0] for c in _WIDE_SPACE}:
        at = np.flatnonzero(data == lead)
        for sign in (c for c in _WIDE_SPACE if c[0] == lead):
            here = at[at + len(sign) <= len(data)]
            for i, byte in enumerate(sign[1:], 1):
                here = here[data[here + i] == byte]
            for i in range(len(sign)):
                space[here + i] = True
    return space


def word_begins(space: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes begin a word, no word going on from one text to the next."""
    begins = ~space
    begins[1:] &= space[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = ~space[first]
    return begins


def _count_words(texts: pa.Array) -> pa.Array:
    counts = [np.diff(np.concatenate([[0], np.cumsum(word_begins(_is_space(data), ends))])[ends])
              for data, ends in text_parts(texts)]
    found = np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int32)
    return pa.array(found, mask=texts.is_null().to_numpy(zero_copy_only=False))


def word_count(col: Column | str) -> Column:
    """Words as Unicode white space parts them."""
    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return _count_words(texts)

    return count(_col(col))


def base_name(col: Column | str) -> Column:
    """Last path segment, trailing slashes ignored."""
    return F.regexp_extract(F.rtrim(_col(col), F.lit("/")), r"([^/]*)$", 1)


def last_segment(col: Column | str) -> Column:
    """Text after the last slash; empty when the name ends in one."""
    return F.element_at(F.split(_col(col), "/"), -1)


def iso_seconds(col: Column | str) -> Column:
    """Timestamp as ISO text with seconds and no zone."""
    return F.date_format(_col(col), "yyyy-MM-dd'T'HH:mm:ss")
