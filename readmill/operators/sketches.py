"""Count-min sketches as mergeable blocks: each task sums up its reads' cells, and blocks of one place are summed behind the shuffle.

What is shuffled is bounded by tasks times the sketch, whatever the reads; k-mers don't leave their
task, nor do those whose distinct ones are found by a bit for each (k up to 12). Cells are those of `kmers.row_cell`. Estimates look the distinct k-mers up in the sketch, which
goes to every task where it has at most `few` cells, and is joined cell by cell else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions import sequences as S

from . import kmers as K
from .minimizers import CHUNK, M, chunks, counted
from .normalize import codes, odd_letters

_BLOCK = 1 << 14  # cells of a row in one block
_PRIME = 2147483647
_BITS = 12  # letters of k-mers that have a bit each in a task


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x from 0 below 2^62, by shifts, which are much faster than divisions."""
    x = (x & _PRIME) + (x >> 31)
    x = (x & _PRIME) + (x >> 31)
    return x - _PRIME * (x >= _PRIME)


def _cells(code: np.ndarray, row: int, cells: int) -> np.ndarray:
    """`kmers.row_cell` of 2-bit codes."""
    x = _mod(_mod(_mod(code) * ((1103515245 + 12345 * row) % _PRIME)) + 7919 * (row + 1))
    return x & (cells - 1) if cells & (cells - 1) == 0 else x % cells


class Cells:
    """The sketch of a task's reads."""

    def __init__(self, k: int, t: int, cells: int):
        self.k, self.t, self.cells, self.table = k, t, cells, np.zeros((t, cells), np.int32)

    def add(self, seqs: pa.Array, size: int = CHUNK) -> None:
        """Adds reads, which are taken in parts of so many letters; the k-mers of one read in several parts wait for its end."""
        held: list[np.ndarray] = []
        row = -1  # whose those are
        for raw, rows, _, begins in chunks(seqs, self.k, size):
            n = max(0, len(raw) - self.k + 1)
            odd = np.concatenate([[0], np.cumsum(odd_letters(raw))])
            at = np.flatnonzero(odd[self.k :] == odd[:n]) if n else np.zeros(0, np.int64)
            x, of = codes(raw.tobytes(), self.k)[0].astype(np.int64)[at], rows[np.searchsorted(begins, at, "right") - 1]
            if row not in (-1, rows[-1]):  # its last part, if it has one here
                self._count(np.concatenate([*held, x[of == row]]), 0)
                x, of, held = x[of != row], of[of != row], []
            row = rows[-1]
            held.append(x[of == row])
            self._count(x[of != row], of[of != row])
        if held:
            self._count(np.concatenate(held), 0)

    def _count(self, x: np.ndarray, of: np.ndarray | int) -> None:
        for row in range(self.t):
            own = np.sort(of * self.cells + _cells(x, row, self.cells))
            own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
            self.table[row] = np.minimum(self.table[row] + np.bincount(own % self.cells, minlength=self.cells), S.COUNT_MAX)


def blocks(reads: DataFrame, k: int, t: int, cells: int, seq: str = "seq") -> DataFrame:
    """(row, block, counts array<int>): the sketch of reads, each of which adds one to a cell at most; counters stop at their limit. Rows are reads, null ones have no k-mers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(k, t, cells)
        for b in batches:
            own.add(b.column("s"))
        used = [(r, i // _BLOCK, own.table[r, i : i + _BLOCK]) for r in range(t) for i in range(0, cells, _BLOCK)]
        used = [(r, i, c) for r, i, c in used if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in used], pa.int32()), pa.array([x[1] for x in used], pa.int32()), pa.array([x[2].tolist() for x in used], pa.list_(pa.int32()))], ["row", "block", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # a task's blocks
        for b in batches:
            for row, block, c in zip(b.column("row").to_pylist(), b.column("block").to_pylist(), b.column("counts"), strict=True):
                c = c.values.to_numpy()
                sums[row, block] = np.minimum(sums.get((row, block), 0) + c, S.COUNT_MAX)
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()), pa.array([c.tolist() for c in sums.values()], pa.list_(pa.int32()))], ["row", "block", "counts"])

    schema = "row int, block int, counts array<int>"
    return reads.select(F.upper(seq).alias("s")).mapInArrow(partial, schema).repartition("row", "block").mapInArrow(merged, schema)


def sketch(reads: DataFrame, k: int, t: int, cells: int, seq: str = "seq") -> DataFrame:
    """(row, cell, cnt) of the occupied cells, as `kmers.sketch` gives them."""
    each = blocks(reads, k, t, cells, seq).select("row", "block", F.posexplode("counts").alias("i", "cnt")).where("cnt > 0")
    return each.select("row", (F.col("block") * _BLOCK + F.col("i")).cast("int").alias("cell"), "cnt")


def present(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code): the distinct k-mers without N of reads, by a bit for each of 4^k in each task; what is shuffled is bounded by tasks times 4^k bits. k is up to 12."""
    if k > _BITS:
        raise ValueError(f"k is up to {_BITS}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(max(8, 4**k), bool)
        for b in batches:
            for raw, *_ in chunks(b.column("s"), k):
                x, odd = codes(raw.tobytes(), k)
                seen[x[~odd].astype(np.int64)] = True
        bits = np.packbits(seen)
        used = [(i, bits[i : i + _BLOCK]) for i in range(0, len(bits), _BLOCK)]
        used = [(i, x.tobytes()) for i, x in used if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in used], pa.int32()), pa.array([x for _, x in used], pa.binary())], ["block", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_: dict[int, np.ndarray] = {}  # a task's blocks
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                all_[block] = all_[block] | x if block in all_ else x
        for block, x in all_.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.unpackbits(x)) + block * 8, pa.int64())], ["code"])

    return reads.select(F.upper(seq).alias("s")).mapInArrow(partial, "block int, bits binary").repartition("block").mapInArrow(merged, "code long")


def estimates(reads: DataFrame, k: int, t: int, cells: int, key: str = "read_id", seq: str = "seq", few: int = 1 << 22) -> DataFrame:
    """(canon, est): the least cell of each distinct k-mer of the reads."""
    each = present(reads, k, seq) if k <= _BITS else counted(reads, k, key, seq, min(M, k)).select(F.col("canon").alias("code"))
    if t * cells > few:
        named = each.select(S.decoded(F.col("code"), k).alias("canon"))
        return K.estimates(named, sketch(reads, k, t, cells, seq), t, cells, few)
    table = np.zeros((t, cells), np.int32)
    for r in blocks(reads, k, t, cells, seq).toLocalIterator():  # of a checked size
        table[r.row, r.block * _BLOCK : r.block * _BLOCK + len(r.counts)] = r.counts
    shared = reads.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("code").to_numpy()
            least = np.min([shared.value[row][_cells(x, row, cells)] for row in range(t)], axis=0) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("code"), pa.array(least, pa.int32())], ["code", "est"])

    return each.mapInArrow(run, "code long, est int").select(S.decoded(F.col("code"), k).alias("canon"), "est")
