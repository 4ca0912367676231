"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of non-ASCII characters. A shared
span of `span` words contains span - k + 1 k-grams; keeping the least k-gram hash of each window of
that many k-grams leaves at least one common fingerprint in every shared span of `span` words or
more, whatever surrounds it. Test items keep the fingerprints of all their windows and are joined
with the documents' on the hash. A hit is then extended: the words around it are compared with the
item's, so that exactly the item's windows that occur are found. An item of fewer words than
`span` is one window of its own length n and has its own guarantee (k = n, every k-gram kept).

The items go to the tasks while their words are at most `max_words`; a larger set is dealt into
parts of that size by item, each joined with all documents, and their hits are merged by row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, no_cache, only, table, text_or_empty, tidy

#: Bytes of words stay (A-Z lower-cased), others become spaces; bytes of non-ASCII characters are 0x80 and above.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NONE = np.iinfo(np.uint64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of word numbers; _NONE where a word (-1) is in no item."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, unknown = np.zeros(n, np.uint64), np.zeros(n, bool)
    u = ids.astype(np.uint64)
    for i in range(k):
        h = (h ^ u[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
        unknown |= ids[i : i + n] < 0
    h[unknown] = _NONE
    return h


def _winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of each window of w, the rightmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, best = np.arange(n), h[:n].copy()
    for i in range(1, w):
        better = h[i : i + n] <= best
        at[better] = np.flatnonzero(better) + i
        best[better] = h[i : i + n][better]
    at = np.unique(at)
    return at[h[at] != _NONE]


class Items:
    """Fingerprints of test items, by the length of their windows."""

    def __init__(self, items: list[tuple[str, bytes]], span: int, k: int):
        self.number: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words_of(t)], np.int64) for _, t in items]
        self.kinds = []  # (window, k, hashes ascending, item, place)
        by_window = defaultdict(list)
        self.window = [min(span, len(w)) for w in self.words]
        for i, w in enumerate(self.words):
            if len(w):
                by_window[self.window[i]].append(i)
        for window, members in by_window.items():
            g = k if window == span else window
            found = [(int(h[p]), i, p) for i in members for h in [_grams(self.words[i], g)] for p in _winnowed(h, window - g + 1).tolist()]
            found.sort()
            h, i, p = (np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int64, np.int64), strict=True))
            self.kinds.append((window, g, h, i, p))

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (first word, end, item) of runs of an item's windows."""
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, _minus), np.int64, len(words))
        if not len(words) or ids.max() < 0:
            return len(words), []
        diagonals: dict[int, list[np.ndarray]] = defaultdict(list)
        for window, g, hashes, items, places in self.kinds:
            h = _grams(ids, g)
            at = _winnowed(h, window - g + 1)
            at = at[np.argsort(h[at], kind="stable")]
            lo, hi = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
            for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(lo)) + 1) if len(at) else []:  # the places of one fingerprint
                a, b = int(lo[own[0]]), int(hi[own[0]])
                for q in np.split(np.arange(a, b), np.flatnonzero(np.diff(items[a:b])) + 1):
                    diagonals[int(items[q[0]])].append(_differences(at[own], places[q]))
        runs = {(left, right, i) for i, d in diagonals.items() for x in np.unique(np.concatenate(d)).tolist() for left, right in self._along(ids, self.words[i], x, self.window[i])}
        return len(words), sorted(runs)

    @staticmethod
    def _along(doc: np.ndarray, item: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
        """The longest runs of at least so many words in doc that equal the item's words `shift` places before."""
        a = max(0, shift)
        n = min(len(doc) - a, len(item) - a + shift)
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = doc[a : a + n] == item[a - shift : a - shift + n]
        turns = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        return [(a + x, a + y) for x, y in turns[turns[:, 1] - turns[:, 0] >= least].tolist()]


def _differences(p: np.ndarray, q: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """All different p - q; a fingerprint may have very many places on both sides, so they are taken in parts."""
    out = np.zeros(0, np.int64)
    step = max(1, most // len(q))
    for i in range(0, len(p), step):
        out = np.union1d(out, p[i : i + step, None] - q[None, :])
    return out


class _Always:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_minus = _Always()


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_ROW = "id {}, n_words long, starts array<long>, ends array<long>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = 4_000_000) -> DataFrame:
    """(id_col, n_words, spans, items): merged runs of hit words [start, end) and the items hit, for each row of docs.

    Null and empty texts and items have no words: no spans, no items. Items with equal text are all
    reported, item ids repeated in `items` once; null item ids are left out. Ids may be null or
    repeated; each row of docs gives one row. Other columns are ignored.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be from 1 to span")
    bounded_batches(docs.sparkSession)
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), text_or_empty(item_text).alias("t"))
    n_words = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-n_words // (2 * max_words)) or 1  # a word and what follows it take two bytes at least
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()

    def one(docs: DataFrame, chosen: DataFrame, keys: str) -> DataFrame:
        known = docs.sparkSession.sparkContext.broadcast([(r.item, r.t.encode()) for r in chosen.collect()])  # at most max_words words
        schema = keys + _ROW.format(kind)
        cached: list[Items] = []

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only(no_cache)
            own = cached[0] if cached else Items(known.value, span, k)
            cached[:] = [own]
            for b in batches:
                out = []
                for t in b.column("t").cast(pa.binary()).to_pylist():
                    n, runs = own.hits(t)
                    merged = _merged([(x, y) for x, y, _ in runs])
                    out.append((n, [x for x, _ in merged], [y for _, y in merged], sorted({own.names[i] for *_, i in runs})))
                types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*([b.column("row")] if keys else []), b.column("id"), *cols], [f.split()[0] for f in schema.split(", ")])

        return docs.mapInArrow(run, schema)

    if parts == 1:
        found = one(docs, items, "")
    else:
        docs = docs.withColumn("row", F.monotonically_increasing_id())
        found = None
        for i in range(parts):
            x = one(docs, items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i), "row long, ")
            found = x if found is None else found.unionByName(x)
        found = found.groupBy("row").agg(*(F.first(c).alias(c) for c in ("id", "n_words")), *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
        found = found.withColumn("items", F.array_sort(F.array_distinct("items")))
        order = F.array_sort(F.arrays_zip("starts", "ends"))
        joined = F.aggregate(order, F.array().cast("array<struct<starts:long,ends:long>>"), lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= x["starts"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(done, F.array(x))))
        found = found.withColumn("m", joined).withColumns({c: F.col(f"m.{c}") for c in ("starts", "ends")})
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return found.select(F.col("id").alias(id_col), "n_words", spans.alias("spans"), "items")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str | None]], span: int = 10) -> tuple[int, int, int, str, bool]:
    """The contract word by word, for tests."""
    words, hit, found = words_of((text or "").encode()), set(), set()
    for name, t in items:
        w = words_of((t or "").encode())
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[j : j + n]:
                    hit.update(range(p, p + n))
                    found.add(name)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
