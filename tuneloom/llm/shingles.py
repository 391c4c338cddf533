"""Shingle sets of texts, and bit tables of fixed size that tell which hashes matter."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 26
_CACHE = 1 << 17


class Shingles:
    """Shingle hashes of texts; keeps the hashes of words a task has seen."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(width)],
                               np.uint64)

    def _word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes, A-Z in lower case; fewer words make a single shingle."""
        if len(self.known) > _CACHE:
            self.known = {}
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        hashes = np.fromiter(map(self._word, words), np.uint64, len(words))
        n = max(1, len(words) - self.width + 1) if words else 0
        out = np.zeros(n, np.uint64)
        for i, power in enumerate(self.powers[:len(words)]):
            out += hashes[i:i + n] * power
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


def bit_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def bit_table(tokens: DataFrame) -> np.ndarray:
    """Bits of the hashes (column ``token``), gathered as words of 64: at most 2^20 rows."""
    bit = F.shiftrightunsigned("token", 64 - _BITS)
    words = (tokens.groupBy(F.shiftright(bit, 6).alias("word"))
             .agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(token, {64 - _BITS}) "
                         "& 63 AS INT)))").alias("bits")))
    found = words.toArrow()
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.astype("<i8").view(np.uint8)
