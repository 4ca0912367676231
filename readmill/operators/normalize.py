"""The greedy redundancy filter: reads in order, each judged by the counts of reads kept before it.

Runs (`run_id`) are independent and spread over the cluster; within a run order matters, so a run
is one sorted stream through one task. Reads arrive in batches; the state is a count-min sketch of
fixed size (t rows of 2^bits one-byte cells), or exact counts in a dictionary for small inputs. The
batched mode gives up order within a batch instead: all its reads are judged by the counts before
it, with joins and aggregates only.
"""

from __future__ import annotations

import sys
import time
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions import hashing
from readmill.functions import sequences as S

from readmill.storage import materialized

from . import kmers as K
from . import reads as R
from .decide import Params, classes, decision, keep, keep_array
from .reads import kept_percent

CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
_IS_N = np.ones(256, bool)
_IS_N[[ord(c) for c in "ACGTacgt"]] = False
_NONE = np.zeros(0, np.int64)


def odd_letters(raw: np.ndarray) -> np.ndarray:
    """Which letters aren't A, C, G, T in either case."""
    return _IS_N[raw]


def codes(seq: bytes, k: int, first_min: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Canonical 2-bit codes (uint64) of a read's k-mers, and which of them hold an N. k is up to 32."""
    raw = np.frombuffer(seq, np.uint8)
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    kind = np.uint32 if k <= 16 else np.uint64
    x = CODE[raw].astype(kind)
    part, part_back, width = x, kind(3) - x, 1  # of 1, 2, 4, ... letters
    forward = back = None
    done = 0  # letters of forward and back, put together from parts
    while True:
        if k & width:
            m = len(raw) - done - width + 1
            if forward is None:
                forward, back = part, part_back
            else:
                forward = (forward[:m] << kind(2 * width)) | part[done : done + m]
                back = back[:m] | (part_back[done : done + m] << kind(2 * done))
            done += width
        if done == k:
            break
        m = len(part) - width
        part, part_back = (part[:m] << kind(2 * width)) | part[width:], part_back[:m] | (part_back[width:] << kind(2 * width))
        width *= 2
    canon = np.maximum(forward, back)
    if first_min:
        canon[0] = min(forward[0], back[0])
    canon = canon.astype(np.uint64, copy=False)
    bad = np.concatenate([[0], np.cumsum(_IS_N[raw])])
    return canon, bad[k:] > bad[:-k]


class Sketch:
    """t rows of 2^bits saturating counters."""

    def __init__(self, t: int, bits: int, k: int, hash_set: int = 1, seed: int = 0):
        self.a, self.b = hashing.parameters(hash_set, t, k, bits, seed)
        self.bits, self.table = bits, np.zeros((t, 1 << bits), np.uint8)
        self.rows = np.arange(t)[:, None]

    def counts(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        at = hashing.cells(x, self.a, self.b, self.bits)
        got = self.table[self.rows, at]
        return got.min(axis=0, initial=255).astype(np.int64), (at, got)

    def add(self, x: np.ndarray, snapshot: object, chosen: np.ndarray) -> None:
        at, got = snapshot
        self.table[self.rows, at[:, chosen]] = np.minimum(got[:, chosen], S.COUNT_MAX - 1) + 1

    def histogram(self) -> np.ndarray:
        return np.bincount(self.table.ravel(), minlength=256)


class Exact:
    """The same with a counter for each k-mer; memory grows with the distinct k-mers of a run."""

    def __init__(self) -> None:
        self.table: dict[int, int] = defaultdict(int)

    def counts(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        return np.array([self.table.get(v, 0) for v in x.tolist()], np.int64), None

    def add(self, x: np.ndarray, snapshot: object, chosen: np.ndarray) -> None:
        for v in set(x[chosen].tolist()):
            self.table[v] = min(self.table[v] + 1, S.COUNT_MAX)

    def histogram(self) -> np.ndarray:
        return np.bincount(np.fromiter(self.table.values(), np.int64, len(self.table)), minlength=256)


class Filter:
    """One run's state and its verdict on each read."""

    def __init__(self, p: Params, counter, max_len: int = S.MAX_LEN, count_n: bool = False, first_min: bool = False):
        self.p, self.counter, self.max_len, self.count_n, self.first_min = p, counter, max_len, count_n, first_min
        self.stats: dict[str, int] = defaultdict(int)

    def judge(self, seq1: str, qual1: str | None, seq2: str | None = None, qual2: str | None = None, ready: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[bool, str | None, list[int], list[int]]:
        """(kept, reason if not, estimated counts of mate 1's k-mers, of mate 2's). ready: the `codes` of a read without a mate, where they are known."""
        p, st = self.p, self.stats
        mates = [(s[: self.max_len].encode(), (q or "")[: self.max_len].encode()) for s, q in ((seq1 or "", qual1), (seq2, qual2)) if s is not None]
        kind = "paired" if len(mates) == 2 else "unpaired"
        st[f"{kind}_in"] += 1
        if any(len(s) < p.k for s, _ in mates):
            st["too_short"] += 1
            return False, "too_short", [], []
        if p.N >= 0 and sum(s.count(b"N") + s.count(b"n") for s, _ in mates) > p.N:
            st["too_many_n"] += 1
            return False, "too_many_n", [], []
        each = [ready] if ready is not None and len(mates) == 1 else [codes(s, p.k, self.first_min and not i) for i, (s, _) in enumerate(mates)]
        x, bad = (np.concatenate(c) for c in zip(*each, strict=True))
        c, snapshot = self.counter.counts(x)
        cut = len(each[0][0])
        low = [self._least(q, len(e[0])) for (_, q), e in zip(mates, each, strict=True)]
        kept = keep_array(p, c[:cut], c[cut:], low[0], low[1] if len(low) == 2 else _NONE)
        st["kmers"] += len(x)
        st["kmers_with_n"] += int(bad.sum())
        if kept:
            chosen = np.ones(len(x), bool) if self.count_n else ~bad
            st["new_kmers"] += len(np.unique(x[chosen & (c == 0)]))
            self.counter.add(x, snapshot, np.flatnonzero(chosen))
            st[f"{kind}_out"] += 1
        return kept, None if kept else "redundant", c[:cut].tolist(), c[cut:].tolist()

    def _least(self, qual: bytes, n: int) -> np.ndarray:
        """Least quality of each k-mer; without qualities every k-mer passes."""
        q = np.frombuffer(qual, np.uint8).astype(np.int64) - self.p.qbase
        if len(q) < n + self.p.k - 1:
            return np.full(n, 1 << 20)
        return np.lib.stride_tricks.sliding_window_view(q, self.p.k).min(axis=1)[:n]


def _together(b: pa.RecordBatch, params: Params, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(codes, which hold an N, where each row's begin and end) of all rows' first mates at once, which takes far fewer calls; null where rows differ in k or have other than ASCII letters."""
    from .dense import windows

    ks = {params.k if k is None else k for k in b.column("k").unique().to_pylist()} if "k" in b.schema.names else {params.k}
    k = ks.pop()
    if ks or not 3 <= k <= 32:
        return None
    raw, start, of, pos = windows(b.column("seq"), k)
    if not len(start) or raw.max() > 127:
        return None
    fine = pos <= max_len - k
    start, of = start[fine], of[fine]
    x, bad = codes(raw.tobytes(), k)
    return x[start], bad[start], np.searchsorted(of, np.arange(len(b) + 1))


def _counter(kind: str, t: int, bits: int, k: int, hash_set: int):
    return Exact() if kind == "exact" else Sketch(t, bits, k, hash_set)


def _nth(reads: DataFrame):
    """The read's place among those of one (file_nr, ord)."""
    return (F.col("nth") if "nth" in reads.columns else F.lit(0)).cast("int").alias("nth")


_VERDICT = "run_id string, file_nr int, ord long, nth int, kept boolean, reason string, counts array<int>, counts2 array<int>"
_STATS = ("unpaired_in", "paired_in", "too_short", "too_many_n", "kmers", "kmers_with_n", "new_kmers", "unpaired_out", "paired_out", "millis")
_ROW = f"kind int, {_VERDICT}, stats array<long>, histogram array<long>, row int, part int, cells binary"
SEP = "\x1f"  # between the name of a parameter set and a run's
_PART = 1 << 20  # bytes of a sketch's row in one row of the result
TICK = 100_000  # reads between two lines of progress


def _pass(reads: DataFrame, params: Params, kind: str, t: int, bits: int, hash_set: int, max_len: int, count_n: bool, first_min: bool, detail: bool, verdicts: bool, statistics: bool, dump: bool, progress: bool, catch: bool = False, sets: dict[str, dict] | None = None) -> DataFrame:
    """One pass over all runs: rows of verdicts (kind 0), and a run's statistics (1) and sketch (2) behind its last read. catch: a run's error is the reason in its statistics, in place of figures.

    sets: parameters by name; each run is judged under each of them, its run_id in the result is the
    name, SEP and the run's. All of them read the same shuffle, in which a read is once.
    """
    from .dense import slices

    own = [c for c in ("d", "k", "A", "B", "C", "N", "Q") if c in reads.columns]
    cols = [F.col(c).cast("string").alias(c) if c in reads.columns else F.lit(None).cast("string").alias(c) for c in ("seq", "qual", "seq2", "qual2")]
    rows = reads.select(F.col("run_id").cast("string").alias("run_id"), F.col("file_nr").cast("int").alias("file_nr"), F.col("ord").cast("long").alias("ord"), _nth(reads), *cols, *(F.col(c).cast("int").alias(c) for c in own))
    # several times as many parts as the session's shuffles have, so that few runs meet in a task, and none are put together for being small
    parts = (4 if sets is None else 1) * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(parts, "run_id").sortWithinPartitions("run_id", "file_nr", "ord", "nth", "seq")
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch], name: str | None = None) -> Iterator[pa.RecordBatch]:
        run_id, f, n, began, out, error = None, None, 0, 0.0, [], None
        base = params if name is None else Params(**(params.__dict__ | {c: v for c, v in sets[name].items() if v is not None}))

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)
            out.clear()
            return b

        def done() -> Iterator[pa.RecordBatch]:
            none = (None,) * 7
            told = run_id if name is None else name if run_id is None else f"{name}{SEP}{run_id}"
            if error is not None and statistics:
                out.append((1, told, None, None, None, None, error, None, None, [0] * len(_STATS), [], None, None, None))
            if f is None or error is not None:
                return
            if statistics:
                f.stats["millis"] = round(1000 * (time.monotonic() - began))
                out.append((1, told, *none, [f.stats[x] for x in _STATS], f.counter.histogram().tolist(), None, None, None))
            if dump and isinstance(f.counter, Sketch):
                for row, cells in enumerate(f.counter.table):
                    for part in range(0, len(cells), _PART):
                        out.append((2, told, *none, None, None, row, part // _PART, cells[part : part + _PART].tobytes()))
                        yield batch()

        for b in (whole.slice(i, j - i) for whole in batches for i, j in slices(whole, ("seq",))):
            all_ = None if first_min else _together(b, base, max_len)
            for at, r in enumerate(b.to_pylist()):
                try:
                    if n == 0 or r["run_id"] != run_id:
                        yield from done()
                        run_id, n, began, f, error = r["run_id"], 0, time.monotonic(), None, None
                        p = base if not own else Params(**(base.__dict__ | {c: r[c] for c in own if r[c] is not None}))
                        f = Filter(p, _counter(kind, t, bits, p.k, hash_set), max_len, count_n, first_min)
                    n += 1
                    if error is not None:
                        continue
                    kept, why, c1, c2 = f.judge(r["seq"], r["qual"], r["seq2"], r["qual2"], None if all_ is None else tuple(c[all_[2][at] : all_[2][at + 1]] for c in all_[:2]))
                except Exception as e:
                    if not catch:
                        raise
                    n, error = max(n, 1), f"{type(e).__name__}: {e}"
                    continue
                if progress and n % TICK == 0:
                    print(f"run {run_id}: {n} reads processed", file=sys.stderr, flush=True)
                if verdicts:
                    out.append((0, run_id, r["file_nr"], r["ord"], r["nth"], kept, why, c1 if detail else None, c2 if detail else None, None, None, None, None, None))
            yield batch()
        yield from done()
        yield batch()

    if sets is None:
        return sorted_.mapInArrow(run, _ROW)
    found = sorted_.limit(0).mapInArrow(run, _ROW) if not sets else None
    for name in sets:
        one = sorted_.mapInArrow(partial(run, name=name), _ROW)
        found = one if found is None else found.unionByName(one)
    return found


def _verdicts(found: DataFrame, reads: DataFrame) -> DataFrame:
    v = found.where("kind = 0").select(*(x.split()[0] for x in _VERDICT.split(", ")))
    return v if "nth" in reads.columns else v.drop("nth")


def _statistics(found: DataFrame, t: int, catch: bool = False) -> DataFrame:
    s = found.where("kind = 1").select("run_id", F.col("reason").alias("error"), *(F.col("stats")[i].alias(n) for i, n in enumerate(_STATS)), "histogram", F.aggregate("histogram", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_cells"))
    occupied = F.aggregate(F.slice("histogram", 2, 254), F.lit(0).cast("long"), lambda a, x: a + x)
    total = F.aggregate(F.transform(F.slice("histogram", 2, 254), lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    base = S.safe_ratio(occupied, F.col("total_cells"))
    kept, seen = F.col("unpaired_out") + F.col("paired_out"), F.col("unpaired_in") + F.col("paired_in")
    s = s.select("*", occupied.alias("n_occupied"), total.alias("counter_sum"), base.alias("base"), F.pow(base, t).alias("fp"), kept_percent(kept, seen).alias("reads_kept_pct"))
    return s if catch else s.drop("error")


def normalize(reads: DataFrame, params: Params, kind: str = "sketch", t: int = 10, bits: int = 20, hash_set: int = 1, max_len: int = S.MAX_LEN, count_n: bool = False, first_min: bool = False, detail: bool = False) -> DataFrame:
    """Verdicts (run_id, file_nr, ord, kept, reason, counts, counts2) for reads (run_id, file_nr, ord, seq[, qual, seq2, qual2]).

    A run may carry its own parameters in columns named as those of Params. Null sequences count as
    empty (too short). A column `nth` orders the reads of one (file_nr, ord) and is returned too. Rows
    with equal places are taken in the order of their sequences. counts and counts2, of the mates'
    k-mers, come with `detail` only.
    """
    return _verdicts(_pass(reads, params, kind, t, bits, hash_set, max_len, count_n, first_min, detail, True, False, False, False), reads)


def run_statistics(reads: DataFrame, params: Params, kind: str = "sketch", t: int = 10, bits: int = 20, hash_set: int = 1, max_len: int = S.MAX_LEN, count_n: bool = False, first_min: bool = False, sets: dict[str, dict] | None = None) -> DataFrame:
    """One row for each run: counters, milliseconds in its task, cells, base and false-positive rate, share kept, and the counter histogram. A run may carry its own parameters.

    sets: parameters by name, see `_pass`; then one row for each run and set.
    """
    return _statistics(_pass(reads, params, kind, t, bits, hash_set, max_len, count_n, first_min, False, False, True, False, False, sets=sets), t)


def normalize_all(reads: DataFrame, params: Params, kind: str = "sketch", t: int = 10, bits: int = 20, hash_set: int = 1, max_len: int = S.MAX_LEN, count_n: bool = False, first_min: bool = False, detail: bool = False, dump: bool = False, progress: bool = False, catch: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, statistics, sketch) of one pass, which is written once; sketch (run_id, row, part, cells) is empty unless `dump`.

    progress: a line for each TICK reads in the executors' logs. catch: a run in which something
    fails (its parameters, a read) has what failed as `error` in its statistics, and figures of 0;
    other runs go on. Its verdicts up to there are worthless.
    """
    found = materialized(_pass(reads, params, kind, t, bits, hash_set, max_len, count_n, first_min, detail, True, True, dump, progress, catch))
    return _verdicts(found, reads), _statistics(found, t, catch), found.where("kind = 2").select("run_id", "row", "part", "cells")


def pass_through(reads: DataFrame) -> DataFrame:
    """Verdicts that keep every read: the stage without a filter."""
    at = ["run_id", "file_nr", "ord", *(["nth"] if "nth" in reads.columns else [])]
    return reads.select(*at, F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"))


def add_counts(*counts: DataFrame) -> DataFrame:
    """Tables (canon, d) summed up; counters stop at their limit, so that sums in any order are the same."""
    out = counts[0].select("canon", "d")
    for more in counts[1:]:
        out = out.unionByName(more.select("canon", "d"))
    return out.groupBy("canon").agg(F.least(F.sum("d"), F.lit(S.COUNT_MAX)).cast("int").alias("d"))


def normalize_batch(reads: DataFrame, counts: DataFrame | None, params: Params, max_len: int = S.MAX_LEN, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(verdicts, counts after) of a batch, see `judge_batch`."""
    verdicts, more = judge_batch(reads, counts, params, max_len, last)
    return verdicts, more if counts is None or last else add_counts(counts, more)


def judge_batch(reads: DataFrame, counts: DataFrame | None, params: Params, max_len: int = S.MAX_LEN, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(verdicts, counts of the kept reads) with every read or pair judged by the same counts (canon, d); last: no counts are made.

    A pair is one read: a k-mer counts once for both mates. Where there are no qualities, every
    k-mer passes decision 6. k-mers are those of `kmers.kmer_rows`. Short k-mers are counted in one
    array (`dense`), longer ones travel as runs (`minimizers`); with qualities, as rows.
    """
    p = params
    at = ["file_nr", "ord", *(["nth"] if "nth" in reads.columns else [])]
    cut = {c: S.truncated(F.coalesce(F.col(c), F.lit("")) if c == "seq" else F.col(c), max_len) for c in ("seq", "qual", "seq2", "qual2") if c in reads.columns}
    r = reads.withColumns(cut)
    if K.is_small(p.k):
        return _judge_short(r, counts, p, at, last)
    if p.k <= 31 and (p.d != 6 or not {"qual", "qual2"} & set(r.columns)):
        return _judge_runs(r, counts, p, at, last)
    return _judge_rows(r.withColumn("read_id", F.struct(*at)), counts, p, at)


def _fine(r: DataFrame, p: Params):
    return R.reject_reason(F.col("seq"), p.k, p.N, F.col("seq2") if "seq2" in r.columns else None).isNull()


def _judge_short(r: DataFrame, counts: DataFrame | None, p: Params, at: list[str], last: bool) -> tuple[DataFrame, DataFrame | None]:
    """By one array of counters; reads are judged where they lie."""
    from . import dense

    seqs = tuple(c for c in ("seq", "seq2") if c in r.columns)
    null = F.lit(None).cast("string")
    r = r.withColumns({"_ok": _fine(r, p)} | {f"_{c}": F.col(c) for c in seqs} | {q: F.col(q) if q in r.columns else null for q in ("qual", "qual2")})
    table = None if counts is None else dense.table_of(counts, p.k)
    judged = dense.judged(r, table, p, (*at, "_ok", *(f"_{c}" for c in seqs)), seqs, ("qual", "qual2")[: len(seqs)] if p.d == 6 else ())
    judged = judged.withColumn("kept", F.col("kept") & F.col("_ok"))
    verdicts = judged.select(*at, "kept")
    return verdicts, None if last else dense.rows(dense.frequencies(judged.where("kept"), p.k, tuple(f"_{c}" for c in seqs)), p.k)


def _judge_runs(r: DataFrame, counts: DataFrame | None, p: Params, at: list[str], last: bool) -> tuple[DataFrame, DataFrame | None]:
    """By runs of k-mers, which meet the counts at their minimizers; only what counts change in a read's sums comes back."""
    from . import minimizers

    seqs = [c for c in ("seq", "seq2") if c in r.columns]
    r = materialized(r.select(*at, *seqs, _fine(r, p).alias("_ok")).withColumn("_no", F.monotonically_increasing_id()))
    size = [F.greatest(F.coalesce(F.length(c), F.lit(0)) - p.k + 1, F.lit(0)) for c in seqs]
    base = [[n, *(n if x else F.lit(0) for x in classes(p, 0))] for n in size] + ([[F.lit(0)] * 4] if len(seqs) == 1 else [])
    mates = lambda x: x.select("_no", F.posexplode(F.array(*seqs)).alias("_mate", "seq")).where("seq is not null")
    if counts is not None:
        read = (F.col("_no") * 2 + F.col("_mate")).alias("no")
        found = minimizers.changes(mates(r.where("_ok")).select(read, F.regexp_replace(F.upper("seq"), "[^ACGT]", "A").alias("seq")), counts, p)
        of = lambda c, i: F.coalesce(F.sum(F.when(F.col("no") % 2 == i, F.col(c))), F.lit(0)).alias(f"{c}{i}")
        found = found.groupBy(F.floor(F.col("no") / 2).alias("_no")).agg(*(of(c, i) for i in range(2) for c in ("rare", "mid", "low")))
        judged = r.join(found, "_no", "left")
        base = [[b[0], *(v + F.coalesce(f"{c}{i}", F.lit(0)) for v, c in zip(b[1:], ("rare", "mid", "low"), strict=True))] for i, b in enumerate(base)]
    else:
        judged = r
    judged = judged.select(*r.columns, (F.col("_ok") & decision(p, *base)).alias("kept"))
    if last:
        return judged.select(*at, "kept"), None
    judged = materialized(judged) if counts is not None else judged
    taken = mates(judged.where("kept"))
    more = minimizers.kmer_counts(taken, p.k, key="_no")
    return judged.select(*at, "kept"), more.select("canon", F.least("d", F.lit(S.COUNT_MAX)).cast("int").alias("d"))


def _judge_rows(r: DataFrame, counts: DataFrame | None, p: Params, at: list[str]) -> tuple[DataFrame, DataFrame]:
    """A row for each k-mer, relational throughout."""
    if counts is None:
        counts = r.sparkSession.createDataFrame([], "canon string, d int")
    mates = [x for x in (("seq", "qual"), ("seq2", "qual2")) if x[0] in r.columns]
    null = F.lit(None).cast("string")
    each = r.select("read_id", F.explode(F.array(*(F.struct(F.lit(i).alias("mate"), F.col(s).alias("seq"), (F.col(q) if q in r.columns else null).alias("qual")) for i, (s, q) in enumerate(mates)))).alias("x")).select("read_id", "x.*").where("seq is not null")
    rows = K.kmer_rows(each, p.k, qual="qual" if p.d == 6 else None, keys=("read_id", "mate"))
    if p.d == 6:
        rows = rows.withColumn("min_qual", F.col("min_qual") - F.when(F.col("min_qual") < 1 << 20, p.qbase - 33).otherwise(0))
    found = K.counts_by_read(rows, counts, ["read_id", "mate"])
    none = F.array().cast("array<int>")
    of = lambda c, i: F.coalesce(F.max(F.when(F.col("mate") == i, F.col(c))), none).alias(f"{c}{i}")
    cols = [of(c, i) for c in (["counts", "quals"] if p.d == 6 else ["counts"]) for i in range(2)]
    judged = found.groupBy("read_id").agg(*cols)
    q = [F.col(f"quals{i}") if p.d == 6 else None for i in range(2)]
    judged = judged.select("read_id", keep(p.d, F.col("counts0"), F.col("counts1"), *q, params=p).alias("kept"))
    verdicts = r.join(judged, "read_id", "left").select(*at, (F.coalesce("kept", F.lit(False)) & _fine(r, p)).alias("kept"))
    taken = rows.join(verdicts.where("kept").select(F.struct(*at).alias("read_id")), "read_id", "left_semi")
    return verdicts, K.document_frequency(taken)
