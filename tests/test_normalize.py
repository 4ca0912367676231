"""The greedy filter against a plain version, sketch against exact counts, and its edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readmill.functions import hashing
from readmill.operators.decide import Params
from readmill.operators import parallel_filter
from readmill.operators.parallel_filter import normalize_parallel
from readmill.operators.normalize import Exact, Filter, Sketch, codes, normalize, normalize_batch, run_statistics

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def canon(seq, k):
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        a = w.replace("N", "A")
        yield max(a, a.translate(COMPLEMENT)[::-1]), "N" in w


def plain(reads, p):
    count, out = {}, []
    for seq in reads:
        seq = seq[:300].upper()
        if len(seq) < p.k or p.N >= 0 and seq.count("N") > p.N:
            out.append(False)
            continue
        x = list(canon(seq, p.k))
        c = [count.get(m, 0) for m, _ in x]
        rare, mid = sum(v < p.A for v in c), sum(p.A <= v < p.C for v in c)
        keep = sorted(c)[len(c) // 2] <= p.C if p.d == 1 else sorted(c)[len(c) // 4] <= p.C if p.d == 2 else rare > p.k or mid > p.B
        if keep:
            for m in {m for m, n in x if not n}:
                count[m] = min(253, count.get(m, 0) + 1)
        out.append(keep)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=40), max_size=30), st.sampled_from([1, 2, 3, 5]), st.integers(0, 3))
def test_exact_is_plain(reads, d, c):
    p = Params(d=d, k=5, A=2, B=4, C=c, N=3)
    f = Filter(p, Exact())
    assert [f.judge(r, None)[0] for r in reads] == plain(reads, p)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ACGT", min_size=8, max_size=40), max_size=30))
def test_large_sketch_is_exact(reads):
    p = Params(d=1, k=7, C=0, N=-1)
    a, b = Filter(p, Exact()), Filter(p, Sketch(4, 18, 7))
    assert [a.judge(r, None)[0] for r in reads] == [b.judge(r, None)[0] for r in reads]


def test_codes():
    x, bad = codes(b"ACGTN", 3)
    assert x.tolist() == [0b000110 if 0b000110 > 0b011011 else max(0b000110, 0b011011), max(0b011011, 0b000110), max(0b101100, 0b110001)] and bad.tolist() == [False, False, True]
    assert codes(b"AC", 3)[0].size == 0 and codes(b"ACGT" * 8, 32)[0].size == 1
    low, _ = codes(b"AAAC", 3, first_min=True)
    assert low[0] == 0


def test_a_repeat_within_a_read_counts_once():
    c = Exact()
    f = Filter(Params(d=1, k=3, C=20, N=-1), c)
    f.judge("AAAAAAAA", None)
    assert list(c.table.values()) == [1]


def test_order_matters_and_runs_are_apart(spark):
    reads = [("a", 0, i, s) for i, s in enumerate(["ACGTACGTAC", "ACGTACGTAC", "TTTTGGGGCC"])] + [("b", 0, 0, "ACGTACGTAC")]
    v = normalize(spark.createDataFrame(reads, "run_id string, file_nr int, ord long, seq string"), Params(d=1, k=5, C=0, N=-1), kind="exact")
    assert {(r.run_id, r.ord): r.kept for r in v.collect()} == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("b", 0): True}


def test_pairs_nulls_and_statistics(spark):
    reads = [("a", 0, 0, "ACGTACGTAC", "I" * 10, "GGGTTTCCCA", "I" * 10), ("a", 0, 1, None, None, None, None), ("a", 0, 2, "ACG", None, "ACGTACGTAC", None), ("a", 0, 3, "NNNNNNACGT", None, "NNACGTACGT", None)]
    df = spark.createDataFrame(reads, "run_id string, file_nr int, ord long, seq string, qual string, seq2 string, qual2 string")
    p = Params(d=6, k=4, A=3, B=3, C=20, N=6, Q=20)
    v = {r.ord: (r.kept, r.reason) for r in normalize(df, p, kind="exact").collect()}
    assert v == {0: (True, None), 1: (False, "too_short"), 2: (False, "too_short"), 3: (False, "too_many_n")}
    s = run_statistics(df, p, t=3, bits=12).first()
    assert (s.paired_in, s.unpaired_in, s.paired_out, s.too_short, s.too_many_n, s.total_cells) == (3, 1, 1, 2, 1, 3 << 12)
    assert s.n_occupied + s.histogram[0] == s.total_cells and abs(s.fp - (s.n_occupied / s.total_cells) ** 3) < 1e-12
    assert normalize(df.limit(0), p).count() == 0


def test_batches_freeze_counts(spark):
    df = spark.createDataFrame([(0, i, "ACGTACGTACGT") for i in range(3)], "file_nr int, ord long, seq string")
    p = Params(d=1, k=5, C=0, N=-1)
    first, counts = normalize_batch(df, None, p)
    assert all(r.kept for r in first.collect())
    second, _ = normalize_batch(df, counts, p)
    assert not any(r.kept for r in second.collect())


def test_hash_sets():
    for i, (a, b) in hashing.HASH_SETS.items():
        assert len(a) == len(b) == 25 and all(x % 2 for x in a), i
    a, _ = hashing.random_set(6, 3)
    assert all(hashing.are_coprime(x, a[:i]) for i, x in enumerate(a))
    assert [hashing.floor_power_of_two(x) for x in (1, 3, 256, 1000)] == [1, 2, 256, 512]
    a, b = hashing.parameters(1, 2, 31, 20)
    x = np.array([123456789, (1 << 62) - 1], np.uint64)
    want = [[(int(m) * int(v) + int(c)) % 2**64 >> 44 for v in x] for m, c in zip(a, b, strict=True)]
    assert hashing.cells(x, a, b, 20).tolist() == want
    with pytest.raises(ValueError):
        hashing.parameters(4, 2, 31, 20)
    with pytest.raises(ValueError):
        Params(d=7)


@pytest.mark.parametrize("d", [1, 3, 6])
def test_parallel_rounds_judge_as_one_task_does(spark, d, monkeypatch):
    monkeypatch.setattr(parallel_filter, "_BLOCK", 7)
    rng = random.Random(d)
    genome = "".join(rng.choice("ACGT") for _ in range(160))

    def piece(n):
        a = rng.randrange(160 - n)
        return "".join(c if rng.random() > 0.01 else "n" for c in genome[a : a + n])

    qual = lambda s: "".join(rng.choice("IIIIIIIIIIII5+") for _ in s)
    rows = []
    for i in range(110):
        one, two = piece(40), rng.choice([None, None, piece(30), "ACG"])
        rows.append((rng.choice("aab"), i // 60, i, 0, one, rng.choice([qual(one), None, "II"]), two, two and qual(two)))
    rows += [("a", 0, 5, 1, genome[:40], None, None, None), ("a", 0, 5, 0, genome[:50], None, None, None), ("c", 0, 0, 0, None, None, None, None), ("c", 0, 1, 0, "", None, None, None), ("c", 0, 2, 0, "N" * 60, None, None, None), (None, 0, 2, 0, genome, None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, file_nr int, ord long, nth int, seq string, qual string, seq2 string, qual2 string").selectExpr("*", "1 as at", "2 as canon", "3 as kept").repartition(5)
    p = Params(d=d, k=11, A=2, B=4, C=4, N=8, Q=15)
    key = lambda x: sorted(((r.run_id or "", r.file_nr, r.ord, r.nth, r.kept, r.reason) for r in x.collect()))
    want = key(normalize(df, p, kind="exact"))
    assert key(normalize_parallel(df, p)) == want and {r[4] for r in want} == {True, False}
    assert normalize_parallel(df.limit(0), p).count() == 0
