"""Lines that several documents share, kept in the first of them only: two Bloom filters find suspects, a shuffle decides.

A line's key is the line without white space at its ends, in lower case (A to Z). Each task puts the
64-bit hashes of its documents' keys into two filters, for hashes seen once and seen twice (a key
counts once a document). The tasks' filters are merged block by block: what two of them have seen
once has been seen twice. The filter of twice-seen hashes, of a fixed size, goes to every task, and
only lines whose hash it holds are suspects. A filter has no false negatives: every repeated key is
suspected. Suspects alone are shuffled, by the SHA-256 of their keys, which confirms repeats exactly
and chooses the document that keeps the line; then texts meet the places of their dropped lines.
Keys with a large share of all suspects are few and go to every task instead of meeting in one.

The size is `bits` (2^29 by default, 64 MB a filter), whatever the input. With 8 bits a key (67
million keys) about 3 % of the single keys are suspects by mistake. Beyond, the share grows up to
all lines, so that more is shuffled; the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, tasks, text_or_empty, tidy, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST = 10  # code points of a key that counts
BITS = 29  # of each filter, as a power of two
_BLOCK = 20  # bits of a block of a filter, as a power of two
_TURNS = 3  # bits a hash sets, all in one block
_HELD = 1 << 20  # hashes a task holds before it gives its filters' bits


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(each eligible line's text, its place there, its key)."""
    lists = pc.split_pattern(texts, "\n")
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=SPACE))
    at = np.asarray(lists.offsets)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    place = np.arange(len(of)) - (at[:-1] - at[0])[of]
    fine = pc.greater_equal(pc.utf8_length(keys), LEAST)
    chosen = np.flatnonzero(np.asarray(fine))
    return of[chosen], place[chosen], keys.filter(fine)


def _hashes(keys: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k) for k in keys.cast(pa.binary()).to_pylist()), np.uint64, len(keys))


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits in it as a row for each turn): the lowest 40 bits of a hash give the bits, those above the block."""
    mask = np.uint64((1 << _BLOCK) - 1)
    first, step = h & mask, (h >> np.uint64(_BLOCK)) & mask | np.uint64(1)
    block = (h >> np.uint64(2 * _BLOCK)) & np.uint64((1 << bits - _BLOCK) - 1)
    return block.astype(np.int64), np.stack([(first + np.uint64(i) * step & mask).astype(np.int64) for i in range(_TURNS)])


def twice_seen(docs: DataFrame, id_col: str, text_col: str, bits: int = BITS) -> DataFrame:
    """(block, bits): the non-empty blocks of the filter of hashes that two documents' keys have, at most 2^(bits - 20) rows of 128 KB."""

    @tidy
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def given() -> pa.RecordBatch:
            x, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            block, cell = _cells(x, bits)
            order = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.diff(block[order])) + 1
            rows = [(int(block[i[0]]), cell[:, i].astype(np.int32).tobytes(), cell[:, i[count[i] > 1]].astype(np.int32).tobytes()) for i in np.split(order, ends) if len(i)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], ["block", "once", "twice"])

        for b in batches:
            of, _, keys = _lines(b.column("text"))
            both = np.unique(np.rec.fromarrays([of, _hashes(keys)], names="of,h"))  # a key counts once a document
            held.append(both.h)
            n += len(both)
            if n >= _HELD:
                yield given()
                n = 0
        yield given()

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, one, two in zip(*(b.column(c).to_pylist() for c in ("block", "once", "twice"))):
                if block != now:
                    yield from given()
                    now, once, twice = block, np.zeros(1 << _BLOCK, bool), np.zeros(1 << _BLOCK, bool)
                cells = np.frombuffer(one, np.int32)
                twice[cells[once[cells]]] = True
                once[cells] = True
                twice[np.frombuffer(two, np.int32)] = True
        yield from given()

    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(local, "block int, once binary, twice binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary")


def _suspects(rows: DataFrame, seen, bits: int) -> DataFrame:
    """(id, print, place, key): lines of rows (id, print, text) whose hash the broadcast filter holds; key is the SHA-256 of theirs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = seen.value
        for b in batches:
            of, place, keys = _lines(b.column("text"))
            block, cell = _cells(_hashes(keys), bits)
            found = np.zeros(len(block), bool)
            order = np.argsort(block, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
                if (x := blocks.get(int(block[i[0]]))) is not None:
                    c = cell[:, i]
                    found[i] = (x[c >> 3] >> (c & 7).astype(np.uint8) & 1).all(axis=0)
            at = np.flatnonzero(found)
            named = [hashlib.sha256(k).digest() for k in keys.take(pa.array(at)).cast(pa.binary()).to_pylist()]
            own = pa.array(of[at])
            yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("print").take(own), pa.array(place[at], pa.int32()), pa.array(named, pa.binary())], ["id", "print", "place", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, print long, place int, key binary")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row of docs: text is what is left of it, n_lines counts the lines before.

    Keys of at least 10 code points that two documents hold lose all their lines but those in the
    document of the least id. Rows of one id are one document: a line they share stays in all of
    them. Null ids are one document too, behind all others. A null or empty text is one empty line
    and becomes an empty text. Repeats within a document, shorter keys and empty lines stay. An empty
    table gives none; columns other than the two aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    blocks = {r.block: np.frombuffer(r.bits, np.uint8) for r in twice_seen(rows, "id", "text", bits).collect()}  # 2^bits / 8 bytes at most
    rows = rows.withColumn("print", F.xxhash64("id", "text"))
    suspects = written(_suspects(rows, spark.sparkContext.broadcast(blocks), bits))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    first = suspects.groupBy("key").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last")
    first, most = written(first.select("key", "first", "n")), suspects.count() // (4 * tasks(spark))
    often = F.broadcast(first.where(F.col("n") > most))  # 4 times as many rows as a shuffle has parts, at most
    rest = suspects.join(often, "key", "left_anti").join(first.where(F.col("n") <= most), "key")
    dropped = suspects.join(often, "key").unionByName(rest).where(own != F.col("first"))
    dropped = dropped.groupBy("id", "print").agg(F.collect_set("place").alias("places"))  # a text's lines at most
    of = dropped.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "places")
    both = rows.join(of, (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "text", "places")

    @tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist()):
                lines = text.split("\n")
                gone = set(places or ())
                out.append((text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "text", "n_lines", "n_dropped"])

    kind = rows.schema["id"].dataType.simpleString()
    found = both.mapInArrow(kept, f"id {kind}, text string, n_lines long, n_dropped long")
    return found.withColumnsRenamed({"id": id_col, "text": text_col})


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those dropped, and the digest of what is left."""
    found = without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT row, doc_id, string_split(text, chr(10)) AS lines FROM d))),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > 1),
j AS (SELECT row, l.doc_id, i, line, coalesce(l.doc_id IS DISTINCT FROM first, true) AND r.key IS NOT NULL AS gone FROM l LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY row
"""
