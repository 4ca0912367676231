"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.storage import materialized as written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 4 << 20) -> None:
    """Arrow batches of few rows and bytes (or one row), as a row may hold a long text.

    The plan reads both limits when it runs, so they stay set for the session; smaller ones that
    the caller has set are kept.
    """
    for key, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        found = spark.conf.get(key, None)
        at = int(found) if found and found.lstrip("-").isdecimal() else 0
        if not 0 < at <= limit:
            spark.conf.set(key, str(limit))


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """large joined with small (one row for each key), where one key may hold a large part of large: its rows are dealt by a hash of `by` too."""
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", salt).join(each, [*keys, "_salt"], how).drop("_salt")


def clashes(classes: DataFrame, name: str) -> DataFrame:
    """(name, kept): names that classes of different `first` and `last` check got, and the check that keeps the name."""
    return classes.where("first <> last").select(name, F.col("first").alias("kept"))


def renamed(rows: DataFrame, clash: DataFrame, name: str, by: str) -> DataFrame:
    """rows (name, check, ...), where classes with a name in clash, but the one that keeps it, get their check as name."""
    found = salted_join(rows, clash, [name], by, "left")
    return found.withColumn(name, F.when(F.col("check") != F.col("kept"), F.col("check")).otherwise(F.col(name))).drop("kept")


class Remembered(dict):
    """What `make` gave for keys met before, in two generations of `most` keys each: keys in use outlive a change of generations."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.older = {}


_caches: list[dict] = []


def only(cache: dict) -> dict:
    """The cache, after emptying those of other operators in this worker process: workers outlive queries."""
    if not any(c is cache for c in _caches):
        _caches.append(cache)
    if others := [c for c in _caches if c and c is not cache]:
        for c in others:
            c.clear()
        gc.collect()
        _give_back()
    return cache


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f over a task's batches, giving freed memory back at its end: workers wait idle between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _give_back()

    return run


no_cache: dict = {}


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle of the size at hand, as the session sets it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
