"""Whole programs over small folders: pairs, sweeps, classification, evaluation; and result files of our own making."""

import gzip
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from readmill import cli
from readmill.operators import classify as C
from readmill.operators import evaluate as E
from readmill.operators import kmers as K
from readmill.operators.decide import Params
from readmill.operators.normalize import normalize, normalize_all, normalize_batch, pass_through
from readmill.plans import runs
from readmill.plans import sweep as P
from readmill.sources import reads as R
from readmill.sources import sinks, tables
from readmill.streaming import normalize_stream as N

SEQS = ["ACGTTGCAACGGTTACAGTC", "TTGACCAGTAGGATCCATTA", "GGCATTACGATCGATTTAGC"]


def fastq(path, records, opener=open):
    with opener(path, "wt") as f:
        f.write("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in records))


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_both_mates_are_written(spark, tmp_path):
    fastq(tmp_path / "x_R1.fq", [("a/1 c1", SEQS[0]), ("b/1", SEQS[0]), ("c/1", SEQS[2])])
    fastq(tmp_path / "x_R2.fq", [("a/2 c2", SEQS[1]), ("b/2", SEQS[1]), ("c/2", SEQS[0][::-1])])
    fastq(tmp_path / "u.fq", [("u", SEQS[1][::-1])])
    cli.main(["normalize", "-u", str(tmp_path / "u.fq"), "-1", str(tmp_path / "x_R1.fq"), "-2", str(tmp_path / "x_R2.fq"), "-k", "7", "-d", "1", "-C", "0", "-t", "3", "-m", "1", "-o", "1", "-r", "-H", "-q", "-D", str(tmp_path / "cells"), "--out", str(tmp_path / "o")])
    kept, gone = tmp_path / "o_keep", tmp_path / "o_rej"
    first, second = lines(spark, kept / "file_nr=1" / "mate=1"), lines(spark, kept / "file_nr=1" / "mate=2")
    assert first[1] == SEQS[0] and first[0].startswith("@a/1 cnt:0;0") and first[0].endswith(" c1") and "@c/1" in first[4]
    assert second[1] == SEQS[1] and second[0].startswith("@a/2 cnt:") and second[0].endswith(" c2") and second[4].startswith("@c/2 cnt:0;0") and len(second) == 8
    assert lines(spark, kept / "file_nr=0" / "mate=1")[1] == SEQS[1][::-1]
    assert ">b/2 cnt:1;" in lines(spark, gone / "file_nr=1" / "mate=2")[0]
    assert [x.split()[0] for x in lines(spark, gone / "file_nr=1" / "mate=1")] == [">b/1", SEQS[0]] and [x.split()[0] for x in lines(spark, gone / "file_nr=1" / "mate=2")] == [">b/2", SEQS[1]]
    cells = spark.read.parquet(str(tmp_path / "cells")).collect()
    assert sorted(r.row for r in cells) == [0, 1, 2] and {len(r.cells) for r in cells} == {1 << 20} and all(any(r.cells) for r in cells)


def test_sweep_reads_pairs_and_resumes(spark, tmp_path):
    data, out = tmp_path / "in", tmp_path / "out"
    data.mkdir()
    fastq(data / "x_R1.fastq.gz", [(f"r{i}", SEQS[0] * 4) for i in range(24)], gzip.open)
    fastq(data / "x_R2.fastq.gz", [(f"r{i}", SEQS[1] * 4) for i in range(24)], gzip.open)
    (data / "y.fa").write_text(">r\n" + "".join(SEQS) + "\n")
    (data / "y.fa_keep").write_text("no input")
    cli.main(["sweep", "--folder", str(data), "--experiment-dir", str(out), "--baseline-only", "--param-prefix", "p_", "-t", "2"])
    got = {(r.dataset, r.param_set): (r.reads_processed, r.reads_accepted) for r in tables.read_sweep(spark, str(out / "summary.tsv")).collect()}
    assert got == {("x", "p_default"): (24, 20), ("y", "p_default"): (1, 0)}  # pairs count once
    logs = {r.path.rsplit("/", 1)[-1]: r for r in tables.read_statistics(spark, str(out / "logs")).collect()}
    assert logs["x_R1.fastq.gz_p_default_log.txt"].reads_processed == 24 and len(logs) == 2
    for mate, seq in (("R1", SEQS[0]), ("R2", SEQS[1])):
        with gzip.open(data / f"x_{mate}.fastq.gz.p_default.gz", "rt") as f:
            assert f.read().split("\n")[:6] == ["@r0", seq * 4, "+", "I" * 80, "@r1", seq * 4]
    assert (data / "y.fa.p_default.gz").exists()
    (out / "summary.tsv").write_text((out / "summary.tsv").read_text().replace("x\tp_default\t24", "x\tp_default\t77") + "z\told\t5\t4\t80.00\t0.001\t9\n")
    cli.main(["sweep", "--folder", str(data), "--experiment-dir", str(out), "--baseline-only", "--param-prefix", "p_", "-t", "2", "--skip-done", "--no-reads"])
    assert {r.dataset: r.reads_processed for r in tables.read_sweep(spark, str(out / "summary.tsv")).collect()} == {"x": 77, "y": 1, "z": 5}
    cli.main(["sweep", "--folder", str(data), "--experiment-dir", str(out), "--baseline-only", "--param-prefix", "p_", "-t", "2", "--no-reads", "--four-lines"])
    assert {r.dataset: r.reads_processed for r in tables.read_sweep(spark, str(out / "summary.tsv")).collect()} == {"x": 24, "y": 1, "z": 5}


def test_a_failing_run_fails_alone(spark, tmp_path, monkeypatch):
    data, out = tmp_path / "in", tmp_path / "out"
    data.mkdir()
    fastq(data / "x.fastq.gz", [(f"r{i}", SEQS[0] * 4) for i in range(24)], gzip.open)
    fastq(data / "y.fastq.gz", [(f"r{i}", (SEQS[1] * 4)[i:]) for i in range(40)], gzip.open)
    (data / "y.fastq.gz").write_bytes((data / "y.fastq.gz").read_bytes()[:-30])
    (data / "z.fa").write_text(">r\n" + "".join(SEQS) + "\n")
    out.mkdir()
    (out / "summary.tsv").write_text("dataset\tparam_set\treads_processed\treads_accepted\treads_kept_pct\tfp\truntime_s\ny\tdefault\t5\t4\t80.00\t0.001\t9\n")
    got = runs.experiments(spark, str(data), str(out), baseline_only=True, t=2, bits=14)
    assert {(r.dataset, r.reads_processed, r.exit_code) for r in got.collect()} == {("x", 24, 0), ("y", 0, 1), ("z", 1, 0)}
    assert P.outcome(got).first()[:] == (2, 1, 3)
    assert {r.dataset: r.reads_processed for r in tables.read_sweep(spark, str(out / "summary.tsv")).collect()} == {"x": 24, "y": 5, "z": 1}
    assert "Return code: 1" in (out / "logs" / "y.fastq.gz_default_log.txt").read_text() and "Return code: 0" in (out / "logs" / "x.fastq.gz_default_log.txt").read_text()
    assert (data / "x.fastq.gz.default.gz").exists() and not (data / "y.fastq.gz.default.gz").exists()


def test_a_run_with_impossible_parameters_fails_alone(spark):
    reads = spark.createDataFrame([(r, 0, i, SEQS[i % 3], k) for r, k in (("a", 7), ("b", 99), ("c", 9)) for i in range(6)], "run_id string, file_nr int, ord long, seq string, k int").coalesce(1)
    v, s, _ = normalize_all(reads, Params(d=1, k=7, C=0, N=-1), t=2, bits=12, catch=True)
    by = {r.run_id: r for r in s.collect()}
    assert by["a"].error is None and by["c"].error is None and by["a"].unpaired_in == by["c"].unpaired_in == 6 and "ValueError" in by["b"].error and by["b"].unpaired_in == 0
    assert {r.run_id for r in v.where("kept").collect()} == {"a", "c"}
    with pytest.raises(Exception, match="k is 3 to 32"):
        normalize_all(reads, Params(d=1, k=7, C=0, N=-1), t=2, bits=12)


TAXA = [(1, None, "no rank", "root"), (10, 1, "genus", "Alpha"), (11, 10, "species", "Alpha one"), (12, 10, "species", "Alpha two"), (20, 1, "genus", "Beta"), (21, 20, "species", "Beta one")]


def test_classify_then_evaluate(spark, tmp_path):
    refs = [(11, "ACGTTGCAACGGTTACAGTCAAGG"), (12, "TTGACCAGTAGGATCCATTACCGA"), (21, "GGCATTACGATCGATTTAGCCTCA")]
    spark.createDataFrame(refs, "taxid long, seq string").write.parquet(str(tmp_path / "refs"))
    spark.createDataFrame(TAXA, "taxid long, parent long, rank string, name string").write.parquet(str(tmp_path / "taxa"))
    for level, rows in (("genus", "10\t0.5\t2\tgenus\tAlpha\n20\t0.5\t1\tgenus\tBeta\n"), ("species", "11\t0.5\t1\tspecies\tAlpha one\n21\t0.5\t1\tspecies\tBeta one\n")):
        (tmp_path / "truth" / level).mkdir(parents=True)
        for d in ("one", "two"):
            (tmp_path / "truth" / level / f"{d}_TRUTH.txt").write_text(rows)
        (tmp_path / "truth" / level / "._one_TRUTH.txt").write_text("hidden")
    data, ev = tmp_path / "reads", tmp_path / "eval"
    data.mkdir()
    fastq(data / "one_R1.fastq", [("a", refs[0][1][:14]), ("b", refs[1][1].lower()), ("c", "A" * 20)])
    fastq(data / "one_R2.fastq", [("a", refs[0][1][8:]), ("b", refs[1][1]), ("c", "C" * 20)])
    (data / "two.fasta").write_text(">x\n" + refs[2][1] + "\n")
    call = ["classify", "--folder", str(data), "--ground-truth-dir", str(tmp_path / "truth"), "--references", str(tmp_path / "refs"), "--taxonomy", str(tmp_path / "taxa"), "-k", "9", "--tool", "mill", "--out", str(ev), "--four-lines"]
    cli.main([*call, "--datasets-to-classify", "one"])
    assert sorted(os.listdir(ev / "mill"))[-2:] == ["one_REPORT.tsv", "runtimes.tsv"]
    before = (ev / "mill" / "one_REPORT.tsv").stat().st_mtime_ns
    cli.main(call)
    assert (ev / "mill" / "one_REPORT.tsv").stat().st_mtime_ns == before  # done before
    rows = {r.taxid: r for r in tables.read_reports(spark, str(ev / "mill" / "one_REPORT.tsv")).collect()}
    assert {t: (r.reads, r.tax_reads) for t, r in rows.items()} == {0: (1, 1), 1: (2, 0), 10: (2, 0), 11: (1, 1), 12: (1, 1)}
    assert rows[11].depth == 2 and rows[11].kmers in (13, 14) and rows[11].cov > 0.8 and rows[10].kmers >= rows[11].kmers + rows[12].kmers > 20 and rows[0].cov is None and abs(rows[1].percent - 66.67) < 0.01
    text = (ev / "mill" / "one_REPORT.tsv").read_text().split("\n")
    assert [x.split("\t")[6] for x in text if x] == ["taxID", "0", "1", "10", "11", "12"]  # pre-order
    assert {r.dataset for r in tables.read_runtimes(spark, str(ev / "mill" / "runtimes.tsv")).collect()} == {"one", "two"}

    other = ev / "other"
    for level in ("genus", "species"):
        (other / level).mkdir(parents=True)
        for d in ("one", "two"):
            (other / level / f"{d}_fast_p_default.txt").write_text("10\t1\t9\tgenus\tAlpha\n" if level == "genus" else "")
        (other / level / "one_average_fast.txt").write_text("1\t1\t1\tgenus\tx\n")
        (other / level / "two_partial.txt").write_text("20\t1\t4\tgenus\tBeta\n")
    (other / "log").mkdir()
    for d, s in (("one", "11.5"), ("two", "12.5")):
        (other / "log" / f"{d}.fastq.log").write_text(f"start\n5 sequences (1 Mbp) processed in {s}s (2 Kseq/m).\n9 sequences processed in 99s (x)\n")
    (tmp_path / "exp").mkdir()
    (tmp_path / "exp" / "summary.tsv").write_text("dataset\tparam_set\treads_processed\treads_accepted\treads_kept_pct\tfp\truntime_s\none\tp_default\t5\t4\t80.00\t0.001\t100\n")
    cli.main(["evaluate", "--ground-truth-dir", str(tmp_path / "truth"), "--eval-dir", str(ev), "--experiments-dir", str(tmp_path / "exp")])
    got = [x.split("\t") for x in (ev / "benchmark_summary.tsv").read_text().rstrip("\n").split("\n")]
    assert got[0][:4] == ["Tool", "N_Datasets", "Genus_Precision_Mean", "Genus_Precision_Std"] and [r[0] for r in got[1:]] == ["mill", "other/fast_p_default"]
    by = {r[0]: dict(zip(got[0], r, strict=True)) for r in got[1:]}
    assert by["other/fast_p_default"]["Genus_Recall_Mean"] == "0.5000" and by["other/fast_p_default"]["Species_F1_Mean"] == "0.0000" and by["other/fast_p_default"]["N_Datasets"] == "2"
    one = (ev / "metrics" / "other_fast_p_default_one_metrics.tsv").read_text()
    assert one == "Metric\tGenus\tSpecies\nPrecision\t1.0000\t0.0000\nRecall\t0.5000\t0.0000\nF1\t0.6667\t0.0000\nAUPR\t1.0000\t0.0000\nTotal_Reads\t9\t9\n"
    plot = {x.split("\t")[0]: x.split("\t") for x in (ev / "benchmark_runtime_plot.tsv").read_text().split("\n")[1:] if x}
    assert plot["other/fast_p_default"][1:4] == ["12.0", "50.0", "62.0"] and plot["other/fast_p_default"][4] == "1m, 2s"
    assert "f1" in (ev / "benchmark_metrics_plot.tsv").read_text()
    pred = tables.read_predictions(spark, str(ev / "mill" / "species" / "one_mill.txt")).collect()
    assert {(r.taxid, r.abundance, r.rank, r.name) for r in pred} == {(11, 1.0, "species", "Alpha one"), (12, 1.0, "species", "Alpha two")}


REPORT = """# a comment
# another
%\treads\ttaxReads\tkmers\tdup\tcov\ttaxID\trank\ttaxName
20\t2\t2\t9\t1\tNA\t0\tno rank\tunclassified
80\t8\t1\t40\t1.2\t0.01\t1\tno rank\troot
70\t7\t2\t30\t1\t0.02\t10\tgenus\t  Alpha
50\t5\t5\t20\t1\t0.03\t1000000011\tspecies\t    Alpha one
short\tline
"""
LOG = """Reads processed:
\tunpaired: 700
\tpaired  : 300
\t----------
\ttotal   : 1000

Reads accepted:
\tunpaired: 500
\tpaired  : 125
\t----------
\ttotal   : 625

n_occupied:\t12
fp:\t0.038 (base: 0.721)
reads kept: 62.50 %
time needed: 71 s
"""


def test_result_files(spark, tmp_path):
    (tmp_path / "a_REPORT.tsv").write_text(REPORT)
    r = tables.read_reports(spark, str(tmp_path / "a_REPORT.tsv")).cache()
    assert {(x.taxid, x.depth, x.cov) for x in r.collect()} == {(0, 0, None), (1, 0, 0.01), (10, 1, 0.02), (1000000011, 2, 0.03)}
    tree = C.preorder_parents(r, ["path"]).where("taxid > 0").select("taxid", "parent")
    assert {x.taxid: x.parent for x in tree.collect()} == {1: None, 10: 1, 1000000011: 10}
    assert {x.taxid: (x.reads, round(x.percent)) for x in C.rollup(r.select("taxid", "tax_reads"), tree).collect()} == {x.taxid: (x.reads, round(x.percent)) for x in r.collect()}
    assert E.report_total(r, ["path"]).first().total_reads == 8 and E.report_total(r.where("taxid <> 1"), ["path"]).first().total_reads == 14
    (tmp_path / "p.txt").write_text("7\t0.1\t3\tgenus\tX\n8\tx\n7\t0.2\t4\tgenus\tX\n")
    assert [(x.taxid, x.fraction, x.abundance) for x in tables.read_predictions(spark, str(tmp_path / "p.txt")).collect()] == [(7, 0.2, 4.0)]
    (tmp_path / "runtimes.tsv").write_text("dataset\truntime_s\na\t12\nb\t3\na\t13\n")
    assert {x.dataset: x.runtime_s for x in tables.read_runtimes(spark, str(tmp_path / "runtimes.tsv")).collect()} == {"a": 13.0, "b": 3.0}
    (tmp_path / "log.txt").write_text(LOG)
    s = tables.read_statistics(spark, str(tmp_path / "log.txt")).first()
    assert (s.reads_processed, s.reads_accepted, s.reads_kept_pct, s.fp, s.time_s) == (1000, 625, 62.5, 0.038, 71)
    (tmp_path / "summary.tsv").write_text("dataset\tparam_set\treads_processed\treads_accepted\treads_kept_pct\tfp\truntime_s\na\tp\t10\t5\t50.00\t0.000\t7\na\tp\t10\t6\t60.00\t0.000\t8")
    assert [(x.reads_accepted, x.runtime_s) for x in tables.read_sweep(spark, str(tmp_path / "summary.tsv")).collect()] == [(6, 8)]
    (tmp_path / "a.fastq.log").write_text("x\n4 sequences (1 Mbp) processed in 1.25s (9 Kseq/m)\n")
    assert [(x.dataset, x.runtime_s) for x in tables.runtimes_from_logs(spark, str(tmp_path / "*.fastq.log")).collect()] == [("a", 1.25)]
    assert [r[1] for r in sinks.runtime_rows(spark.createDataFrame([("a", 2.5), ("b", 3.5)], "dataset string, runtime_s double")).collect()] == ["2", "4"]


def test_files_of_one_name_folders_and_sizes(spark, tmp_path):
    for d, s in (("p", "ACGT"), ("q", "GGTT")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "r+1 x.fa").write_text(f">{d}\n{s}\n")
    (tmp_path / "p" / "_hidden").write_text("")
    got = R.read_fastx(spark, [str(tmp_path / "q" / "r+1 x.fa"), str(tmp_path / "p")]).orderBy("file_nr").collect()
    assert [(r.file_nr, r.name, r.seq) for r in got] == [(0, "q", "GGTT"), (1, "p", "ACGT")] and got[1].path.endswith("/p/r+1 x.fa")
    assert R.listing(spark, str(tmp_path / "p")).collect()[0].size == 8 and R.listing(spark, str(tmp_path / "none")).count() == 0
    assert R.file_size(spark, str(tmp_path / "p" / "r+1 x.fa")) == 8 and R.file_size(spark, str(tmp_path / "none")) == 0
    (tmp_path / "odd").write_text("@a\nAC\n+\nII\n")
    (tmp_path / "e.fa").write_text("")
    assert [R.count_reads(spark, str(tmp_path / x)) for x in ("p/r+1 x.fa", "odd", "e.fa")] == [1, 1, 0]


def test_four_line_records_are_split(spark, tmp_path):
    records = [(f"r{i} c" if i % 2 else f"r{i}", SEQS[i % 3][: 5 + i % 11]) for i in range(500)]
    fastq(tmp_path / "a.fq", records)
    with open(tmp_path / "a.fq", "a") as f:
        f.write("\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = [tuple(r) for r in R.read_fastx(spark, [str(tmp_path / "a.fq")]).orderBy("ord").collect()]
        split = R.read_fastx(spark, [str(tmp_path / "a.fq")], four_lines=True)
        assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 4
        assert [tuple(r) for r in split.orderBy("ord").collect()] == whole and len(whole) == 500
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), old, strict=True):
            spark.conf.set(f"spark.sql.files.{k}", v)
    (tmp_path / "b.fq").write_text("@a\nAC\nGT\n+\nIIII\n")
    with pytest.raises(Exception, match="four lines"):
        R.read_fastx(spark, [str(tmp_path / "b.fq")], four_lines=True).collect()


def test_kmers_of_any_letters(spark):
    seq = "acgtRYacgtNNACGTTGCA" * 40  # several parts
    df = spark.createDataFrame([(1, seq, "I" * 799 + "!"), (2, "AC", "II"), (3, None, None)], "read_id long, seq string, qual string")
    up = "".join(c if c in "ACGT" else "N" for c in seq.upper())
    canon = lambda w: max(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    for k in (5, 21):
        want = [(i, canon(up[i : i + k].replace("N", "A")), "N" in up[i : i + k], 0 if i + k == len(up) else 40) for i in range(len(up) - k + 1)]
        rows = K.kmer_rows(df, k, qual="qual").collect()
        assert sorted((r.pos, r.canon, r.has_n, r.min_qual) for r in rows) == want
        coded = K.kmer_rows(df, k, coded=True).select("pos", K.decoded(F.col("canon"), k).alias("c"), K.code(K.decoded(F.col("canon"), k), k) == F.col("canon")).collect()
        assert sorted((r[0], r[1]) for r in coded) == [x[:2] for x in want] and all(r[2] for r in coded)
    long = {r.canon: (r.n, r.d) for r in K.kmer_counts(df, 32).collect()}
    assert sum(n for n, _ in long.values()) == sum("N" not in up[i : i + 32] for i in range(len(up) - 31))


def test_a_read_in_lower_case_is_classified(spark):
    taxa = spark.createDataFrame(TAXA, "taxid long, parent long, rank string, name string")
    refs = spark.createDataFrame([(11, SEQS[0] + "AA"), (12, SEQS[0] + "CC")], "taxid long, seq string")
    reads = spark.createDataFrame([(1, SEQS[0]), (2, SEQS[0].lower()), (3, SEQS[0].lower() + "aa"), (4, "t" * 30), (5, None)], "read_id long, seq string")
    for few in (1_000_000, 0):
        got = {r.read_id: r.taxid for r in C.classify(reads, C.kmer_taxa(refs, taxa, 9), taxa, 9, few=few).collect()}
        assert got == {1: 10, 2: 10, 3: 11, 4: 0, 5: 0}


def test_batches_heed_qualities_and_pairs(spark):
    rows = [(0, 0, SEQS[0], "I" * 20, SEQS[1], "I" * 20), (0, 1, SEQS[0], "!" * 20, SEQS[1], "!" * 20), (0, 2, SEQS[0], None, None, None), (0, 3, SEQS[0], "I" * 20, "ACG", "III"), (0, 4, "NNNNN" + SEQS[0], None, None, None)]
    df = spark.createDataFrame(rows, "file_nr int, ord long, seq string, qual string, seq2 string, qual2 string")
    p = Params(d=6, k=7, A=1, B=30, C=9, N=4)
    verdicts, counts = normalize_batch(df, None, p)
    exact = normalize(df.withColumn("run_id", F.concat(F.lit("r"), F.col("ord").cast("string"))), p, kind="exact")  # every read for itself: counts are 0
    want = {r.ord: r.kept for r in exact.collect()}
    assert {r.ord: r.kept for r in verdicts.collect()} == want == {0: True, 1: False, 2: True, 3: False, 4: False}
    again, _ = normalize_batch(df, counts, p)
    assert not any(r.kept for r in again.collect())


def test_one_pass_gives_verdicts_statistics_and_sketch(spark, capfd):
    reads = spark.createDataFrame([("a", 0, 0, "ACGTACGTAC", 0), ("a", 0, 1, "ACGTACGTAC", 0), ("b", 0, 0, "ACGTACGTAC", 5), ("b", 0, 1, "ACGTACGTAC", 5)], "run_id string, file_nr int, ord long, seq string, C int")
    v, s, cells = normalize_all(reads, Params(d=1, k=5, N=-1), t=2, bits=8, dump=True, detail=True)
    assert {(r.run_id, r.ord): r.kept for r in v.collect()} == {("a", 0): True, ("a", 1): False, ("b", 0): True, ("b", 1): True}  # each run's own parameters
    assert {r.run_id: r.unpaired_out for r in s.collect()} == {"a": 1, "b": 2} and {(r.run_id, r.row) for r in cells.collect()} == {(x, i) for x in "ab" for i in (0, 1)}
    assert [r.kept for r in pass_through(reads).collect()] == [True] * 4


def test_streams_in_the_order_of_files(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 1, 0, SEQS[0]), ("a", 0, 5, SEQS[0]), ("a", 0, 9, SEQS[1])]
    spark.createDataFrame(rows, "run_id string, file_nr int, ord long, seq string").withColumn("qual", F.lit(None).cast("string")).coalesce(1).write.parquet(src)
    stream = N.stream_files(spark, src, "run_id string, file_nr int, ord long, seq string, qual string")
    said = []
    listener = N.Progress(2, said.append)
    spark.streams.addListener(listener)
    q = N.greedy(stream, Params(d=1, k=7, C=0, N=-1)).writeStream.format("memory").queryName("by_file").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.file_nr, r.ord): r.kept for r in spark.table("by_file").collect()} == {(0, 5): True, (0, 9): True, (1, 0): False}
    for _ in range(50):
        if said:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert said == ["3 reads processed"]


def test_background(tmp_path):
    _, log = cli.background(["--", sys.executable, "-c", "print('done')"], str(tmp_path / "logs"))
    for _ in range(100):
        if "done" in open(log).read():
            break
        time.sleep(0.1)
    assert open(log).read() == "done\n" and os.path.basename(log).startswith(os.path.basename(sys.executable) + "__")


def test_sketch_size():
    assert cli.sketch_size(2560) == (10, 256) and cli.sketch_size(100_000) == (10, 4096) and cli.sketch_size(5120) == (10, 512)
    assert cli.sketch_size(100) == (6, 16) and cli.sketch_size(1) == (1, 1)
    assert cli.sketch_size(1000, m=100) == (10, 64) and cli.sketch_size(1000, t=4) == (4, 128) and cli.sketch_size(0, 3, 5) == (3, 4)
    with pytest.raises(SystemExit):
        cli.sketch_size(100, m=64)
    assert subprocess.run([sys.executable, "-m", "readmill.cli", "normalize", "--help"], capture_output=True, check=True).stdout


def test_questions_without_predictions(spark):
    truth = spark.createDataFrame([("d", "genus", 1), ("d", "species", 2), ("d", "species", 3), ("e", "genus", 1)], "dataset string, level string, taxid long")
    pred = spark.createDataFrame([("t", "d", "genus", 1, 5.0)], "tool string, dataset string, level string, taxid long, abundance double")
    asked = spark.createDataFrame([("t", "e", "genus")], "tool string, dataset string, level string")
    got = {(r.dataset, r.level): (r.f1, r.aupr, r.tp, r.fp, r.fn) for r in E.metrics(pred, truth, asked=asked).collect()}
    assert got == {("d", "genus"): (1.0, 1.0, 1, 0, 0), ("d", "species"): (0.0, 0.0, 0, 0, 2), ("e", "genus"): (0.0, 0.0, 0, 0, 1)}
    assert runs.NOT_TOOLS
