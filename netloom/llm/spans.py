"""Vectorised work on byte spans: words, 64-bit hashes, shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_A, _B, _C = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: ASCII white space: blank, tab, newline, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return freed memory to the system; a Python worker otherwise keeps the most that any task of it took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(function: Callable) -> Callable:
    """A function over batches that gives freed memory back after each batch that it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from function(taken())
        give_back()

    return run


def lean_group(function: Callable) -> Callable:
    """The same for a function over the table of a group."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        return function(table)

    return run


def lean_pair(function: Callable) -> Callable:
    """The same for a function over the two tables of a group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        return function(left, right)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; works in place on a fresh array."""
    x = x ^ (x >> U(30))
    x *= _A
    x ^= x >> U(27)
    x *= _B
    x ^= x >> U(31)
    return x


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``, eight bytes at a time.

    ``data`` must end in at least eight bytes that no span covers.
    """
    words = np.ndarray((len(data) - 7,), U, data, 0, (1,))
    size = ends - starts
    h = mix((words[starts] & _MASK[np.minimum(size, 8)]) + _C * size.astype(U))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        left = size[rest] - at
        h[rest] = mix((h[rest] * _C) ^ (words[starts[rest] + at] & _MASK[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    return h


def join_texts(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts in one buffer, a newline after each, and where each begins (one more at the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return b"\n".join(texts) + b"\n" * 9, np.concatenate(([0], np.cumsum(sizes)))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    edge = np.diff(SPACE[np.frombuffer(data, np.uint8)].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text, and where each set begins.

    A text with fewer than ``width`` words has one shingle, its whole sequence;
    one without words has none.
    """
    data, begins = join_texts(texts)
    data = data.lower()
    starts, ends = word_spans(data)
    h = hash_spans(data, starts, ends)
    first = np.searchsorted(starts, begins)
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, U)
        for k in range(width):
            rolled = rolled * _C + h[k : len(h) - width + 1 + k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, U)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, n, c) in enumerate(zip(first.tolist(), n_words.tolist(), count.tolist())):
        if not c:
            continue
        if n >= width:
            s = np.sort(rolled[a : a + c])
            if c > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            x = U(n)
            with np.errstate(over="ignore"):
                for w in h[a : a + n]:
                    x = x * _C + w
                s = mix(np.array([x ^ _A], U))
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))
