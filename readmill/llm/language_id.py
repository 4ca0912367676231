"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point alone. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rotated) by its place: V(abc) =
r2(L(a)) * r1(L(b)) * L(c). A text's vector bundles (adds) the vectors of its n-grams, words being
padded with a space on either side; a language's prototype bundles those of its sample. A text gets
the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, only, table, text_or_empty, tidy

_OTHERS = re.compile(r"[\W\d_]+")
_PIECE = 1 << 18  # n-grams of a text that are held at once
UNDETERMINED = "und"


def words_of(text: str) -> str:
    """A text's letters in lower case, all else as single spaces."""
    words = _OTHERS.sub(" ", text.lower())
    if words.replace(" ", "").isalpha():
        return words
    return _OTHERS.sub(" ", "".join(c if c.isalpha() else " " for c in words))  # numerals such as ½ and Ⅷ count as word characters above


class Vectors:
    """Letter and n-gram vectors, made when first met."""

    REMEMBERED = 30_000  # n-gram vectors; 30 MB at 1024 dimensions

    def __init__(self, dims: int, n: int, seed: int):
        self.dims, self.n, self.seed = dims, n, seed
        self.letters: dict[str, np.ndarray] = {}
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, dims), np.int8)

    def letter(self, c: str) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[c] = np.random.default_rng([self.seed, ord(c)]).integers(0, 2, self.dims, np.int8) * np.int8(2) - np.int8(1)
        return self.letters[c]

    def gram(self, g: str) -> np.ndarray:
        v = np.ones(self.dims, np.int8)
        for i, c in enumerate(g):
            v = v * np.roll(self.letter(c), self.n - 1 - i)
        return v

    def bundle(self, counts: dict[str, int]) -> np.ndarray:
        """The sum of the vectors of n-grams, each as often as counted."""
        if len(self.row) + len(counts) > self.REMEMBERED:
            self.row.clear()
        total, grams = np.zeros(self.dims, np.float32), list(counts)
        for i in range(0, len(grams), 8192):
            at = []
            for g in grams[i : i + 8192]:
                if (r := self.row.get(g)) is None:
                    r = self.row[g] = len(self.row)
                    if r >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[r] = self.gram(g)
                at.append(r)
            weights = np.fromiter((counts[g] for g in grams[i : i + 8192]), np.float32, len(at))
            total += weights @ self.rows[at].astype(np.float32)
        return total

    def counts(self, text: str) -> dict[str, int]:
        """How often each n-gram of the text's words occurs; empty if it has no letters."""
        out: dict[str, int] = {}
        if words := words_of(text).strip():
            padded = f" {words} "
            for a in range(0, len(padded) - self.n + 1, _PIECE):
                _count(padded[a : a + _PIECE + self.n - 1], self.n, out)  # neighbouring pieces share n - 1 characters
        return out


def _count(padded: str, n: int, out: dict[str, int]) -> None:
    """Adds the n-grams that hold no inner space."""
    # one array of code points; n-grams as rows; those with a space inside are left out
    x = np.frombuffer(padded.encode("utf-32-le"), "<u4")
    seen, codes = np.unique(x, return_inverse=True)
    base, m = len(seen), len(x) - n + 1
    if float(base) ** n >= 2**62:
        s = padded
        for i in range(m):
            if " " not in s[i + 1 : i + n - 1]:
                out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
        return
    key, inner = np.zeros(m, np.int64), np.ones(m, bool)
    space = 0 if seen[0] == 32 else -1  # the least code, as words hold letters only; a piece within one word has none
    for i in range(n):
        c = codes[i : i + m]
        key = key * base + c
        if 0 < i < n - 1:
            inner &= c != space
    key = key[inner]
    if base**n <= 1 << 18:
        k = np.bincount(key, minlength=base**n)
        grams = np.flatnonzero(k)
        k = k[grams]
    else:
        grams, k = np.unique(key, return_counts=True)
    digits = np.empty((len(grams), n), np.int64)
    for i in reversed(range(n)):
        grams, digits[:, i] = np.divmod(grams, base)
    text = seen[digits].astype("<u4").tobytes().decode("utf-32-le")
    for i, c in enumerate(k.tolist()):
        g = text[i * n : i * n + n]
        out[g] = out.get(g, 0) + c


_vectors: dict[tuple, Vectors] = {}


def _shared(dims: int, n: int, seed: int) -> Vectors:
    """One for each worker process."""
    if (dims, n, seed) not in only(_vectors):
        _vectors[dims, n, seed] = Vectors(dims, n, seed)
    return _vectors[dims, n, seed]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows_per_language: int = 400, dims: int = 1024, n: int = 3, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototypes by language, from about rows_per_language rows of each, chosen by a hash of key_col.

    Rows without a language or text are left out. The prototypes are as many as languages, of dims
    numbers each.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("t"))
    sizes = labelled.groupBy("lang").count()
    place = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(sizes), "lang").where(place * F.col("count") < rows_per_language)  # a row for each language

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, totals = _shared(dims, n, seed), {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t").to_pylist(), strict=True):
                if counts := v.counts(t):
                    x = v.bundle(counts).astype(np.float64)
                    totals[lang] = totals.get(lang, 0) + x / (np.linalg.norm(x) or 1)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "v": pa.array([x.tobytes() for x in totals.values()], pa.binary())})

    parts = chosen.select("lang", "t").mapInArrow(run, "lang string, v binary")

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, v in zip(b.column("lang").to_pylist(), b.column("v").to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "v": pa.array([x.tobytes() for x in totals.values()], pa.binary())})

    found = parts.repartition(8, "lang").mapInArrow(add, "lang string, v binary").collect()  # a vector for each language
    return {r.lang: (lambda x: (x / (np.linalg.norm(x) or 1)).astype(np.float32))(np.frombuffer(r.v)) for r in sorted(found)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, n: int = 3, seed: int = 7) -> DataFrame:
    """(id_col, *keep, lang_pred, score) for each row: the nearest prototype, and its cosine cut to 0..1.

    `und` with score 0 for null texts, texts without letters, and where there is no prototype. Ties
    go to the language first in order. Ids may be null or repeated.
    """
    bounded_batches(docs.sparkSession)
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]) if langs else np.zeros((0, 1), np.float32)
    keep = keep or []
    inner = docs.select(F.col(id_col).alias("_0"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep, 1)), text_or_empty(text_col).alias("t"))
    names = [f"_{i}" for i in range(len(keep) + 1)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(matrix.shape[1], n, seed)
        for b in batches:
            lang, score = [], []
            for t in b.column("t").to_pylist():
                counts = v.counts(t) if langs else {}
                if not counts:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                x = v.bundle(counts)
                cos = matrix @ x / (float(np.linalg.norm(x)) or 1)
                best = int(np.argmax(cos))
                lang.append(langs[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"{c} {inner.schema[c].dataType.simpleString()}" for c in names), "lang_pred string", "score double"])
    return inner.mapInArrow(run, schema).select(*(F.col(a).alias(b) for a, b in zip(names, [id_col, *keep], strict=True)), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3; a null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
