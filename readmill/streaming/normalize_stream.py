"""Normalising a stream of reads.

`greedy` keeps the exact order-dependent filter: a run's sketch lies in the state store in parts, of
which a micro-batch reads and writes those that its own reads touch. `batched` judges a micro-batch
by the counts before it and adds the kept reads' k-mers as counts of its own; it scales with the
cluster, as it is joins and aggregates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from readmill.functions import hashing
from readmill.operators.decide import Params
from readmill.operators.normalize import Filter, Sketch, add_counts, judge_batch
from readmill.storage import drop

_PART = 10  # cells of a part of a sketch's row, as a power of two
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_READ = ("seq", "qual", "seq2", "qual2")


class StoredSketch(Sketch):
    """A sketch whose rows lie in a map state in parts: they are read when first touched, and those changed are written back."""

    def __init__(self, t: int, bits: int, k: int, state):
        super().__init__(t, bits, k)
        self.state, self.part = state, min(_PART, bits)
        self.known = np.zeros((t, 1 << bits - self.part), bool)
        self.changed = np.zeros_like(self.known)

    def counts(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        at = hashing.cells(x, self.a, self.b, self.bits) >> self.part
        asked = np.zeros_like(self.known)
        asked[self.rows, at] = True
        for row, part in np.argwhere(asked & ~self.known).tolist():
            if self.state.containsKey((row, part)):
                self.table[row, part << self.part : part + 1 << self.part] = np.frombuffer(self.state.getValue((row, part))[0], np.uint8)
        self.known |= asked
        return super().counts(x)

    def add(self, x: np.ndarray, snapshot: object, chosen: np.ndarray) -> None:
        super().add(x, snapshot, chosen)
        self.changed[self.rows, snapshot[0][:, chosen] >> self.part] = True

    def save(self) -> None:
        for row, part in np.argwhere(self.changed).tolist():
            self.state.updateValue((row, part), (self.table[row, part << self.part : part + 1 << self.part].tobytes(),))


class _Greedy(StatefulProcessor):
    def __init__(self, params: Params, t: int, bits: int):
        self.params, self.t, self.bits = params, t, bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "row int, part int", "cells binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sketch = StoredSketch(self.t, self.bits, self.params.k, self.cells)
        f = Filter(self.params, sketch)
        found = pd.concat(list(rows)).sort_values(["file_nr", "ord", "nth", "seq"])
        text = lambda v: v if isinstance(v, str) else None
        out = [(key[0], r.file_nr, r.ord, r.nth, *f.judge(text(r.seq) or "", text(r.qual), text(r.seq2), text(r.qual2))[:2]) for r in found.itertuples()]
        sketch.save()
        yield pd.DataFrame(out, columns=["run_id", "file_nr", "ord", "nth", "kept", "reason"])

    def close(self) -> None:
        pass


def greedy(reads: DataFrame, params: Params, t: int = 4, bits: int = 16) -> DataFrame:
    """Verdicts (run_id, file_nr, ord, nth, kept, reason) for a stream of reads (run_id[, file_nr], ord[, nth], seq[, qual, seq2, qual2]); a run's state has t * 2^bits bytes at most.

    Reads of a micro-batch are taken in the order of files and within them, as `normalize` does
    (limit a micro-batch by the source, as `maxFilesPerTrigger`, since a run's part of it is sorted in
    memory); micro-batches in theirs. Pairs are judged as one, and qualities count. The state needs
    Spark's RocksDB store, which is set in the session.
    """
    reads.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    of = lambda c, kind, default: (F.col(c) if c in reads.columns else F.lit(default)).cast(kind).alias(c)
    rows = reads.select(F.col("run_id").cast("string").alias("run_id"), of("file_nr", "int", 0), "ord", of("nth", "int", 0), *(of(c, "string", None) for c in _READ))
    return rows.groupBy("run_id").transformWithStateInPandas(_Greedy(params, t, bits), "run_id string, file_nr int, ord long, nth int, kept boolean, reason string", "append", "none")


def stream_files(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """A stream of Parquet files of reads, so many files a micro-batch: the source waits while the filter works."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


class Progress(StreamingQueryListener):
    """Prints the number of reads each time another `tick` of them has been processed."""

    def __init__(self, tick: int = 100_000, say=print):
        self.tick, self.say, self.seen = tick, say, 0

    def onQueryStarted(self, event) -> None:
        self.seen = 0

    def onQueryProgress(self, event) -> None:
        before, self.seen = self.seen, self.seen + event.progress.numInputRows
        if self.seen // self.tick > before // self.tick:
            self.say(f"{self.seen} reads processed")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counts_before(spark: SparkSession, counts: str, n: int, every: int = 16) -> DataFrame | None:
    """(canon, d): what micro-batches before the n-th have counted; None before the first."""
    base = (n - 1) // every * every if n else 0
    paths = [f"{counts}/base={base}"] if base else []
    paths += [f"{counts}/batch={i}" for i in range(base, n)]
    return add_counts(spark.read.schema("canon string, d int").parquet(*paths)) if paths else None


def batched(reads: DataFrame, params: Params, out: str, counts: str, checkpoint: str, every: int = 16):
    """Starts a query that appends verdicts to `out` and each micro-batch's own counts to `counts`; ends when the input is read.

    The n-th micro-batch writes `batch=n` in both, in proportion to its own reads, and replaces it if
    it is replayed. Behind each `every`-th batch the counts so far are summed up once as `base=n`, for
    all batches before the n-th, so that at most `every` tables and a base are read; what the base
    holds is dropped a batch later, when no replay needs it.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n > every and n % every == 1:
            drop(spark, *(f"{counts}/batch={i}" for i in range(n - 1 - every, n - 1)), f"{counts}/base={n - 1 - every}")
        if n and n % every == 0:
            counts_before(spark, counts, n, every).write.mode("overwrite").parquet(f"{counts}/base={n}")
        before = spark.read.parquet(f"{counts}/base={n}") if n and n % every == 0 else counts_before(spark, counts, n, every)
        verdicts, more = judge_batch(batch, before, params)
        verdicts.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")
        more.write.mode("overwrite").parquet(f"{counts}/batch={n}")

    return reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
