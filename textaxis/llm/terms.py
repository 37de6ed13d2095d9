"""Terms of whole texts as codes into a dictionary, for Arrow batches of text.

Terms are exact strings, never hashes: the bytes of all terms are gathered into one string array, which Arrow encodes as
a dictionary. Separators are ASCII characters, so bytes are split as code points would be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from textaxis.llm.words import LOWER, NOT_ALNUM, slices, split_words, text_buffer

#: All but lower-case letters and bytes of other characters, for texts in lower case.
NOT_ALPHA = NOT_ALNUM.copy()
NOT_ALPHA[ord("0"):ord("9") + 1] = True
#: Text bytes that are worked on at a time; one longer text is taken alone.
SLICE_BYTES = 8 << 20


def coded_terms(batch: pa.RecordBatch, separators: np.ndarray, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """For each slice of a batch: its rows, each term's row in the slice and code, and the dictionary; A-Z count as a-z.

    A null text has no terms.
    """
    buf, offsets = text_buffer(batch.column(column))
    for lo, hi in slices(offsets, most):
        part, at = LOWER[buf[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, row = split_words(part, at, separators)
        ends_at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=ends_at[1:])
        data = part[~separators[part]]
        terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(data)]).dictionary_encode()
        yield lo, hi, row, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``keys`` in order, and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])
