"""Each query against the same in SQL."""

import pytest

from readmill import queries as Q
from readmill.operators.decide import Params
from readmill.operators.normalize import normalize


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf, same_as_sql, name):
    same_as_sql(Q.queries()[name](spark, sf), Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"parallel_normalize"}))
def test_runs(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reads_cover_all_letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    letters = {r.doc_id: len("".join(c for c in (r.text or "").lower() if "a" <= c <= "z")) for r in docs}
    assert max(letters.values()) > 300
    runs = Q._runs(spark, sf).collect()
    of = {i: [r for r in runs if r.ord == i] for i in letters}
    assert all(sum(len(r.seq or "") for r in of[i]) == n and len(of[i]) == max(1, -(-n // 300)) for i, n in letters.items())
    assert all(r.qual is None or len(r.qual) == len(r.seq) <= 300 for r in runs)
    verdicts = Q.queries()["greedy_normalize"](spark, sf).collect()
    assert {(r.ord, r.nth) for r in verdicts} == {(r.ord, r.nth) for r in runs} and len(verdicts) == len(runs) == Q.queries()["batched_normalize"](spark, sf).count()


def test_a_kmer_behind_300_letters_classifies(spark, tmp_path):
    word = "the quick brown fox jumps over a small dog and then some more"
    sf = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(1, word)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "z" * 400 + word)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.read_id, r.taxid) for r in Q.queries()["classify_reads"](spark, str(tmp_path)).collect()] == [(7, 101)]


def test_parallel_rounds_on_the_table(spark, sf):
    key = lambda x: sorted((r.run_id, r.ord, r.nth, r.kept, r.reason or "") for r in x.collect())
    want = normalize(Q._runs(spark, sf), Params(d=3, k=21, A=3, B=200, C=2, N=10), kind="exact")
    assert key(Q.queries()["parallel_normalize"](spark, sf)) == key(want)
