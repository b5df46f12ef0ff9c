"""A bit for each cell of hashed keys: which rows may be among wanted ones, before a join decides.

A sieve has about SPARE bits for each key and at most MOST_BITS (64 MB) whatever the
number of keys, so that it can be broadcast. It lets no wanted row go; the more keys
there are beyond that bound, the more others pass, and the join after it is larger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkronym.llm import words as w

SPARE, LEAST_BITS, MOST_BITS, SLAB = 16, 1 << 20, 1 << 29, 20
U = np.uint64


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return w.mix(keys.view(U) + U(0x1F83D9ABFB41BD6B)) >> U(64 - bits)


def _slabs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.unique(cells(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), bits))
            slab = (c >> U(SLAB)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(slab)) + 1
            rows = [(int(s[0]), x.astype(np.uint32).tobytes()) for s, x in zip(np.split(slab, cuts), np.split(c & U((1 << SLAB) - 1), cuts), strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["slab", "cells"])

    return w.tidy(run)


def _merge(key, rows):
    import pandas as pd

    bits = np.zeros(1 << SLAB, bool)
    for c in rows["cells"]:
        bits[np.frombuffer(c, np.uint32)] = True
    return pd.DataFrame({"slab": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


class Sieve:
    """Built from the one column of longs of keys, of which there are about n."""

    def __init__(self, keys: DataFrame, n: int, most_bits: int = MOST_BITS):
        self.bits = int(min(max(LEAST_BITS, n * SPARE), most_bits) - 1).bit_length()
        merged = keys.mapInArrow(_slabs(self.bits), "slab long, cells binary").groupBy("slab").applyInPandas(_merge, "slab long, bits binary")
        data = bytearray(1 << (self.bits - 3))
        for slab, b in merged.collect():  # as many bits as are broadcast
            data[slab << (SLAB - 3) : (slab << (SLAB - 3)) + len(b)] = b
        self.data = keys.sparkSession.sparkContext.broadcast(bytes(data))

    def __getstate__(self):
        return self.bits, self.data

    def __setstate__(self, state):
        self.bits, self.data = state

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be among those it was built from; all that are pass."""
        c = cells(keys, self.bits)
        return (np.frombuffer(self.data.value, np.uint8)[(c >> U(3)).astype(np.int64)] >> (c & U(7)).astype(np.uint8)) & 1 == 1
