"""Shared lines against a plain count of keys, whitening against sums in Python's integers and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmill.llm import line_dedup as L
from readmill.llm.line_dedup import without_repeated_lines
from readmill.llm.whitening import op12_embedding_whitening, whitened

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(L.SPACE).translate(LOWER)


def plain(rows):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add((i is None, i or 0))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(h := held.get(key(x), ())) > 1 and min(h) != (i is None, i or 0) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


CASES = [
    (5, "A shared line here\nown line of five\n"), (3, "  a SHARED line here\t\nshort\nshort"), (9, "a shared line here\na shared line here\n\n"),
    (7, None), (8, ""), (None, "a shared line here\nonly where no id is"), (None, "only where no id is\nshort"), (5, "A shared line here\nown line of five\n"),
    (5, "own line of five\nÄÖÜ äöü straße"), (2, "äöü ÄÖÜ straße\nÄÖÜ äöü straße"), (1, "123456789\n1234567890"), (4, "1234567890\n123456789"),
    (11, " a shared line here"), (12, "a shared line here\r\nx"), (13, "x" * 300_000), (14, "y\n" * 50_000 + "X" * 300_000), (15, "\n"),
]


@pytest.mark.parametrize("bits", [20, 29])
def test_cases(spark, bits):
    df = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "1 as key", "2 as place", "3 as id", "4 as print").repartition(5)
    assert found(without_repeated_lines(df, bits=bits)) == plain(CASES)
    assert without_repeated_lines(df.limit(0), bits=bits).count() == 0


def test_filters_of_any_load(spark):
    """A filter of 2^20 bits under 600,000 keys suspects nearly all lines; the result is the same."""
    rng = random.Random(1)
    rows = [(i, "\n".join(f"line number {rng.randrange(400_000)}" for _ in range(300))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(without_repeated_lines(df, bits=20)) == found(without_repeated_lines(df)) == plain(rows)


def test_twice_seen_has_no_false_negatives(spark):
    rows = [(i, f"once {i} and no more\nhere in all of them\nin two of them {i // 2}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    blocks = {r.block: np.frombuffer(r.bits, np.uint8) for r in L.twice_seen(df, "doc_id", "text").collect()}

    def held(text):
        (block,), cell = L._cells(np.array([L.xxhash.xxh3_64_intdigest(text.encode())], np.uint64), L.BITS)
        return int(block) in blocks and all(blocks[int(block)][c >> 3] >> (c & 7) & 1 for c in cell[:, 0].tolist())

    assert held("here in all of them") and all(held(f"in two of them {i}") for i in range(500))
    assert sum(held(f"once {i} and no more") for i in range(1000)) < 5


def expected(rows, most=4):
    lists = [(i, [math.floor(256 * v) for v in c]) for i, c in rows]
    fit = sorted({tuple(x) for _, x in lists})
    n, sums = len(fit), [sum(v) for v in zip(*fit, strict=True)]
    z = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    cov = z.T @ z / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    out = {}
    for i, x in lists:
        for c in range(len(values)):
            w = np.array([(n * v - s) / n for v, s in zip(x, sums, strict=True)]) @ axes[:, c] / np.sqrt(values[c])
            out[i, c + 1] = (n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), w, values[c] / np.trace(cov))
    return out


def check(got, want):
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(w) > 1e-6:
            assert sign.setdefault(r.component, np.sign(r.whitened * w)) == np.sign(r.whitened * w)
        assert abs(abs(r.whitened) - abs(w)) < 1e-7


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_embedding_whitening(spark, sf).collect(), expected(rows))


def test_repeated_and_far_vectors(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(60, 3)) * [1e4, 30, 1] + [1e5, -5, 0]).astype(np.float32).astype(float)
    rows = [(i, v[i % 40].tolist()) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    check(whitened(df).collect(), expected(rows))


def test_whitening_cases(spark):
    none = float("nan")
    rows = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), ((1 << 60) + 1, [0.9, -0.0]), (None, [0.1, 0.2]), (2, None), (3, [none, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [float("inf"), 0.0]), (8, [-float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "2 as x", "3 as v", "'a' as id")
    got = whitened(df).collect()
    assert sorted(((r.vec_id or 0), r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), ((1 << 60) + 1, 1), ((1 << 60) + 1, 2)]
    assert {r.n for r in got} == {3} and sum(r.vec_id is None for r in got) == 2
    for some in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2"), df.where("vec_id = 6")):
        assert whitened(some).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    one = whitened(line).collect()
    assert len(one) == 5 and {r.component for r in one} == {1} and abs(one[0].explained - 1) < 1e-12
    big = spark.createDataFrame([(i, [1e9 * i]) for i in range(1, 5)], "vec_id long, embedding array<double>")
    assert whitened(big).where(F.col("deviation").isNull()).count() == 4  # (n x)^2 is above 64 bits
