"""Bloom filters of a fixed size over tables of numbers, to read again only what may be wanted.

What a filter lets through wrongly is dropped by a join later on; a filter that
more keys fill lets more through, and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import mix

FILTER_BITS, FILTER_HASHES = 1 << 26, 3


def _slots(key: np.ndarray) -> np.ndarray:
    h = mix(key.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    shift = np.uint64(64 - (FILTER_BITS.bit_length() - 1))
    return np.stack([(h >> np.uint64(20 * i)) * np.uint64(0x9E3779B97F4A7C15) >> shift for i in range(FILTER_HASHES)])


def in_filter(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a filter may hold."""
    slot = _slots(key)
    return ((held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def filter_of(keys: DataFrame) -> np.ndarray:
    """The filter of a table with one column of 64-bit keys; a row for each 64 bits comes to the driver."""

    def bits(batches):
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(zero_copy_only=False)).ravel().astype(np.int64)
            bit = np.uint64(1) << (slot & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(bit.view(np.int64))], ["word", "bit"])

    words = keys.mapInArrow(bits, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS >> 6, np.int64)
    held[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return held.view(np.uint8)
