"""Words and shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

A text is a run of UTF-8 bytes; many short texts are hashed in one numpy call
and a long one is hashed in one piece, so the cost per byte does not depend on
how the bytes are dealt to documents. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Bytes that are not space, tab, line feed, vertical tab, form feed or return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEPS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64
)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> np.ndarray:
    """The first n powers of the base."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive rows of about ``limit`` bytes, always whole texts."""
    data, at = bytes_of(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where a text begins."""
    n = len(mask)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | begins[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    ends = np.flatnonzero(mask & (~after | begins[1:])) + 1
    return starts, ends


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(first, lengths)
    values = data[np.repeat(starts, lengths) + inside].astype(np.uint64)
    values += np.uint64(1)
    values *= _power(int(lengths.max()))[inside]
    return mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) << np.uint64(40)))


def word_hashes(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, bytes) of every word of the texts, in order; A-Z count as a-z."""
    starts, ends = runs(is_word[data], at)
    row = np.searchsorted(at, starts, "right") - 1
    return hash_runs(LOWER[data], starts, ends), row, ends - starts


def shingle_layout(row: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, offsets by row) of every k-word shingle in order; 1 to k - 1 words are one shingle."""
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    at = np.concatenate(([0], np.cumsum(sizes)))
    begin = np.repeat(first, sizes) + (np.arange(at[-1]) - np.repeat(at[:-1], sizes))
    return begin, np.repeat(np.minimum(count, k), sizes), at


def shingle_hashes(words: np.ndarray, begin: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hash of each shingle of a layout."""
    most = int(left.max()) if len(left) else 0
    if most > len(_STEPS):
        raise ValueError(f"shingles of 1 to {len(_STEPS)} words")
    out = np.zeros(len(begin), np.uint64)
    for j in range(most):
        here = left > j
        if here.all():
            out += mix(words[begin + j] + _STEPS[j])
        else:
            out[here] += mix(words[begin[here] + j] + _STEPS[j])
    return mix(out)
