"""A Bloom filter of bounded size: spares a shuffle the rows that surely have no partner. What passes it is joined exactly, so a
filter that is too small for its keys costs work, never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most (8 MB), bits a key up to there, bits set for a key, and tasks that build one.
MAX_BITS, BITS_A_KEY, SET, TASKS = 1 << 26, 12, 6, 8


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = h.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(SET):
        yield (a + np.uint64(k) * b) % np.uint64(bits)


def bloom(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes: false only for one that is not in the one column of ``keys``. The filter is made of ``TASKS``
    parts, each of ``MAX_BITS`` bits at most, that come to the driver."""
    bits = max(64, min(MAX_BITS, BITS_A_KEY * keys.count()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(), bits):
                held[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(-(-bits // 8), np.uint8)
    for (part,) in keys.coalesce(TASKS).mapInArrow(build, "bits binary").collect():
        whole |= np.frombuffer(part, np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        found, packed = np.ones(len(h), bool), held.value
        for at in _places(h.to_numpy(), bits):
            found &= (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return maybe
