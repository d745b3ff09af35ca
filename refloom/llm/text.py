"""Words and word hashes, as Python workers compute them.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D. bytes.split() splits UTF-8 at exactly
these six bytes, which is faster than a regular expression and needs no table.
"""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_PUNCTUATION_TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Distinct words whose hashes a worker keeps; beyond that it starts anew, so memory stays bounded.
CACHED_WORDS = 400_000
#: Rows of a batch that are turned into Python values at a time: a batch may have 64 MB of texts.
HELD_ROWS = 256


#: What this worker process keeps from task to task, by name.
_KEPT: dict = {}


def kept(name: object, make: Callable):
    """The worker process's object of that name, made by the first task that asks for it."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Gives memory that is free within this process back to the system, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget() -> None:
    """Drops what tasks have kept."""
    if _KEPT:
        _KEPT.clear()
        release()


def lean(run: Callable, keeps: bool = False) -> Callable:
    """run, a task's function of Arrow batches, for workers that Spark uses again for other tasks: it gives back free memory at a task's end.

    Unless it keeps things itself it begins by dropping what tasks of other kinds have kept.
    """

    def leanly(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        yield from run(batches)
        release()

    return leanly


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation; a null text has none."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION_TO_SPACE).split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash (XXH64, seed 0), remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words, from the words' hashes; a shorter sequence is one window of all its words, an empty one has none."""
    if not len(words):
        return words
    n = min(n, len(words))
    k = len(words) - n + 1
    out = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out ^= words[i : i + k] + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return out


def rows_of(batch, *names: str) -> Iterator[tuple]:
    """The named columns of an Arrow batch, row by row, as Python values, of which some rows' are held at a time."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for a in range(0, batch.num_rows, HELD_ROWS):
        yield from zip(*(c.slice(a, HELD_ROWS).to_pylist() for c in columns), strict=True)
