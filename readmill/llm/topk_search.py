"""Exact top-k by integer inner product over an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks of a bounded number of rows; each block keeps, for each dimension,
its postings by descending component, cut into segments of equal quantised component. A query
orders all segments by their quantised impact (its own component times the segment's best), taken
above the block's least impact in that dimension so that no contribution is negative, and adds
segments to the accumulators in rounds. After a round, what the segments still to come can add to
any row is the sum over dimensions of the best of them; the rows that lead are scored exactly, and
the k-th best of those scores is one that the result can't fall below. Rows whose accumulator plus
that sum stays below it are proven out; once few enough rows are left (or all segments are done),
those are rescored exactly. Nothing is left out without that proof.

Every block gives its k best to each query; the k best of those are the result. Queries are a
stated set: they stream past each block's index, in batches. A tile is a block and a part of the
queries; there are as many parts as keep all tasks busy (one, where there are blocks enough), and
each tile is a partition of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tasks, tidy, written

class Block:
    ROUNDS = 8  # in which all segments would be read

    def __init__(self, vectors: np.ndarray, levels: int = 16):
        self.vectors = vectors  # int64, rows by dimensions
        self.floats = vectors.astype(np.float64)
        n, dims = vectors.shape
        self.biggest = int(np.abs(vectors).max(initial=0))
        span = max(1, int(vectors.max(initial=0)) - int(vectors.min(initial=0)) + 1)
        step = -(-span // levels)
        rows, values, cut, dim = [], [], [0], []
        for d in range(dims):
            order = np.argsort(-vectors[:, d], kind="stable")
            v = vectors[order, d]
            ends = np.append(np.flatnonzero(np.diff(v // step)) + 1, n) if n else np.zeros(0, np.int64)
            rows.append(order)
            values.append(v)
            cut.extend((d * n + ends).tolist())
            dim.extend([d] * len(ends))
        self.rows = np.concatenate(rows) if dims else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if dims else np.zeros(0, np.int64)
        self.narrow = self.values.astype(np.int32) if self.biggest < 1 << 20 else None
        self.cut, self.dim = np.array(cut, np.int64), np.array(dim, np.int64)
        self.high = self.values[self.cut[:-1]] if dims and n else np.zeros(0)
        self.low = self.values[self.cut[1:] - 1] if dims and n else np.zeros(0)

    def search(self, q: np.ndarray, k: int, own: int, enough: float = 0.5) -> list[tuple[int, int]]:
        """(row, score) of the k best rows but `own` (-1: none), with all that tie with the last.

        enough: share of the rows that are rescored once no more than those are possible.
        """
        n, dims = self.vectors.shape
        largest = int(np.abs(q).max(initial=0))
        if self.biggest * largest * max(1, dims) >= 1 << 52:
            return self._best(np.arange(n), q.astype(object), k, own)  # too large to add up in the accumulators' type
        left = np.arange(n)
        if n > 4 * k + 64 and dims:
            left = self._possible(q.astype(np.float64), k + (own >= 0), max(2 * k, enough * n))
        return self._best(left, q, k, own)

    def _possible(self, q: np.ndarray, k: int, enough: float) -> np.ndarray:
        """Rows that may be among the k best."""
        n, dims = self.vectors.shape
        a, b = q[self.dim] * self.high, q[self.dim] * self.low
        best, worst = np.maximum(a, b), np.minimum(a, b)
        floor = np.full(dims, np.inf)
        np.minimum.at(floor, self.dim, worst)
        impact = best - floor[self.dim]
        order = np.argsort(-impact, kind="stable")
        done = np.zeros(dims, np.int64)  # segments of each dimension that are in the accumulators, from its better end
        segments = np.bincount(self.dim, minlength=dims)
        first = np.concatenate([[0], np.cumsum(segments)])
        # half as wide where sums of what is added can't overflow
        values = self.narrow if self.biggest * float(np.abs(q).max()) * dims < 1 << 30 and self.narrow is not None else self.values
        acc, whole, base = np.zeros(n, values.dtype), q.astype(values.dtype), floor.astype(values.dtype)
        below, leaders = floor.sum(), min(n, 4 * k)
        size = max(1, -(-len(order) // self.ROUNDS))
        for i in range(0, len(order), size):
            upto = done + np.bincount(self.dim[order[i : i + size]], minlength=dims)
            for d in np.flatnonzero(upto > done).tolist():
                x, y = (first[d] + done[d], first[d] + upto[d]) if q[d] >= 0 else (first[d + 1] - upto[d], first[d + 1] - done[d])
                x, y = self.cut[x], self.cut[y]
                acc[self.rows[x:y]] += whole[d] * values[x:y] - base[d]
            done = upto
            rest = order[i + size :]
            to_come = np.zeros(dims)
            np.maximum.at(to_come, self.dim[rest], impact[rest])
            lead = np.argpartition(acc, n - leaders)[n - leaders :]
            sure = np.partition(self.floats[lead] @ q, leaders - k)[leaders - k] - below
            possible = np.flatnonzero(acc + to_come.sum() >= sure)
            if len(possible) <= enough:
                return possible
        return possible

    def _best(self, rows: np.ndarray, q: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        rows = rows[rows != own]
        if not len(rows):
            return []
        if q.dtype == object:
            s = self.vectors[rows].astype(object) @ q
        else:  # sums below 2^52 are exact
            s = (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        if len(rows) > k:
            keep = s >= np.sort(s)[-k]
            rows, s = rows[keep], s[keep]
        return list(zip(rows.tolist(), [int(x) for x in s], strict=True))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, id_col, score): the k rows with the largest inner products of floor(scale * x), ties to smaller ids.

    Rows whose vector or id is null, or whose vector holds a null or non-finite component, take no
    part; a row is never its own neighbour, but another row with the same id or vector may be.
    Vectors of different lengths don't meet. Fewer than k other rows give fewer results, a lone
    row or an empty table none.
    """
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows)
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    parts = max(1, min(8, tasks(vectors.sparkSession) // blocks))  # a block's rows go to each of them
    deal = lambda by, n: F.pmod(F.xxhash64("row", F.lit(by)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(deal(0, blocks).alias("block"), each(parts).alias("part"), F.size("v").alias("dims"), F.lit(0).alias("role"), "row", "id", "v")
    asked = rows.where("asks").select(each(blocks).alias("block"), deal(1, parts).alias("part"), F.size("v").alias("dims"), F.lit(1).alias("role"), "row", "id", "v")
    dealt = held.unionByName(asked).repartitionById(blocks * parts, F.col("block") * parts + F.col("part")).sortWithinPartitions("dims", "role", "row")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, index, place = None, [], [], None, {}
        for b in batches:
            out: list[tuple] = []
            kinds = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "role")]) if b.num_rows else np.zeros((0, 2))
            edges = [0, *(np.flatnonzero(np.any(np.diff(kinds, axis=0) != 0, axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(edges, edges[1:]):
                dims, role = (int(x) for x in kinds[i])
                if dims != key:
                    key, held, ids, index, place = dims, [], [], None, {}
                part = b.slice(i, j - i)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(j - i, dims).astype(np.int64)
                row, own = part.column("row").to_pylist(), part.column("id").to_pylist()
                if role == 0:
                    held.append(x)
                    place.update(zip(row, range(len(ids), len(ids) + len(row)), strict=True))
                    ids.extend(own)
                    continue
                if not ids:
                    continue
                index = index or Block(np.concatenate(held))
                for q, r, name in zip(x, row, own, strict=True):
                    found = sorted((-s, ids[p]) for p, s in index.search(q, k, place.get(r, -1)))[:k]
                    out.extend((r, name, i, -s) for s, i in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["row", "query_id", "id", "score"])

    near = dealt.mapInArrow(run, "row long, query_id long, id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH g AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM g q JOIN g c ON q.vec_id % 50 = 0 AND c.n <> q.n AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
