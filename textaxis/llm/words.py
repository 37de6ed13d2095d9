"""Words and their 64-bit hashes, for whole Arrow batches of text at once.

Texts are taken as UTF-8 bytes straight from Arrow's buffers. The word classes used here only name ASCII characters as
separators, so splitting bytes equals splitting code points. Hashes are polynomials modulo 2**64 over random tables
with a finishing mix; the seeds are fixed, so every task and every attempt gives the same values.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes that are worked on at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All but digits, lower-case letters and bytes of other characters, for texts in lower case.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[ord("0"):ord("9") + 1] = NOT_ALNUM[ord("a"):ord("z") + 1] = False
NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U) | U(1)
_PLACE, *_BASES = (int(x) | 1 for x in _rng.integers(2**40, 2**63, 4, dtype=U))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Free memory of this process goes back to the system, where its allocators can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # other systems than glibc's
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, a function of ``mapInArrow``, that leaves no free memory in its worker: Spark keeps workers for later tasks,
    so what one stage freed would stand beside all that the next ones take."""

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        try:
            for out in run(batches):
                yield out
                del out
                pool.release_unused()
        finally:
            give_back()

    return leaving


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n, b, U)
            p[0] = 1
            pair.append(np.cumprod(p))
        have = _tables[base] = (pair[0], pair[1])
    return have


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def split_words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and row of each word; ``offsets`` are into ``buf`` and start at 0."""
    word = ~separators[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin], last[end] = word[begin], word[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), U)
    size = np.cumsum(ends - starts)
    lo = 0
    while lo < len(starts):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + 4 * SLICE_BYTES, "right")))
        lens = ends[lo:hi] - starts[lo:hi]
        at = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        v = _BYTE[buf[place + np.repeat(starts[lo:hi], lens)]]
        v *= powers(_PLACE, int(lens.max()))[0][place]
        out[lo:hi] = np.add.reduceat(v, at) + lens.astype(U)
        lo = hi
    return mix(out)


class Ranges:
    """Hashes of runs of consecutive words, from prefix sums; equal runs have equal hashes wherever they stand."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        n = len(hashes)
        pw, self.inverse = powers(_BASES[which], n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(hashes * pw[:n], out=self.sums[1:])

    def rolling(self, k: int) -> np.ndarray:
        """The hash of each run of ``k`` words, by its first word."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n] + U(k)) if n > 0 else np.zeros(0, U)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of words ``a`` to before ``b``."""
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n]) if have < width else x[:n]


def word_slices(batch: pa.RecordBatch, column: str, separators: np.ndarray = SPACES, lower: bool = False):
    """For each slice of a batch: its rows, and each word's row in the slice and hash; ``lower`` takes A-Z as a-z."""
    buf, offsets = text_buffer(batch.column(column))
    for lo, hi in slices(offsets):
        part, at = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        if lower:
            part = LOWER[part]
        starts, ends, row = split_words(part, at, separators)
        yield lo, hi, row, hash_words(part, starts, ends)
