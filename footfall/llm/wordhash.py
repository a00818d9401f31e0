"""Words of whole texts as 64-bit numbers, for numpy code inside tasks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class WordHashes:
    """Hashes of ASCII-space separated words; remembers a bounded number of them."""

    most = 300_000

    def __init__(self) -> None:
        self.known = _Known()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.frombuffer(array("Q", map(self.known.__getitem__, words)), "uint64")


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; empty for null."""
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every bit of the result depends on every bit of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of n words."""
    if len(hashes) < n:
        return np.zeros(0, "uint64")
    size = len(hashes) - n + 1
    total = np.zeros(size, "uint64")
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[k : k + size] + np.uint64(k + 1))
    return mixed(total)
