"""Stand-in engines of the tests."""

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class EchoEngine:
    """Answers with the first words of the prompt."""

    pad_id = 0

    def __init__(self) -> None:
        self._ids: dict[str, int] = {}
        self._words: list[str] = [""]

    def encode(self, text: str) -> list[int]:
        out = []
        for word in text.split():
            if word not in self._ids:
                self._ids[word] = len(self._words)
                self._words.append(word)
            out.append(self._ids[word])
        return out

    def generate(self, ids: np.ndarray, mask: np.ndarray, max_new: int,
                 temperature: float) -> list[list[int]]:
        return [[int(x) for x in row[keep == 1]][:max_new] for row, keep in zip(ids, mask)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self._words[i] for i in ids)
