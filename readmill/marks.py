"""A bit for the hash of each number of a set: 8 MB, whatever the set. Numbers without a mark are surely others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 26  # 2^26 marks are 8 MB
_BLOCK = 1 << 14  # bytes of marks in one row


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64 bits, cut to 62, so that runs of one letter are no minimizers of everything."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(15))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x >> np.uint64(2)).astype(np.int64)


def mark(x: np.ndarray) -> np.ndarray:
    return mixed(x.astype(np.uint64)) >> (62 - BITS)


def marked(marks: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether numbers may be among those that the marks were made of."""
    at = mark(x)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def marks(numbers: DataFrame) -> np.ndarray:
    """The marks of the one column of a table. Made in each task, united block by block."""

    def blocks(bits: np.ndarray) -> pa.RecordBatch:
        found = [(i, c.tobytes()) for i, c in enumerate(bits.reshape(-1, _BLOCK)) if c.any()]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], ["block", "bits"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS - 3, np.uint8)
        for b in batches:
            at = mark(np.asarray(b.column(0)))
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield blocks(bits)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(((1 << BITS - 3) // _BLOCK, _BLOCK), np.uint8)
        for b in batches:
            for i, c in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
                bits[i] |= np.frombuffer(c, np.uint8)
        yield blocks(bits)

    rows = numbers.mapInArrow(partial, "block int, bits binary").repartition("block").mapInArrow(united, "block int, bits binary")
    found = np.zeros(((1 << BITS - 3) // _BLOCK, _BLOCK), np.uint8)
    for r in rows.collect():  # 8 MB at most
        found[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return found.ravel()
