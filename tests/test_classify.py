"""Classification, trees, upserts and streaming on small inputs."""

import random

from pyspark.sql import functions as F

from readmill import cli
from readmill.operators import classify as C
from readmill.operators.decide import Params
from readmill.operators.normalize import run_statistics
from readmill.operators.relational import first_by_prefix, first_mates, upsert
from readmill.functions import sequences as S
from readmill.plans import sweep as P
from readmill.storage import materialized
from readmill.sources.sinks import histogram_rows, statistics_text
from readmill.sources.tables import statistics_columns
from readmill.streaming import normalize_stream as N

TREE = [(1, None, "no rank", "root"), (2, 1, "genus", "A"), (3, 2, "species", "Aa"), (4, 2, "species", "Ab"), (5, 1, "genus", "B")]


def tree(spark):
    return spark.createDataFrame(TREE, "taxid long, parent long, rank string, name string")


def test_closure(spark):
    assert {(r.taxid, r.ancestor, r.up) for r in C.closure(tree(spark)).collect()} >= {(3, 3, 0), (3, 2, 1), (3, 1, 2), (5, 1, 1)}
    assert C.closure(tree(spark)).count() == 1 + 2 + 3 + 3 + 2


def test_paths_ties_and_unknown(spark):
    refs = spark.createDataFrame([(3, "ACGTTGCAAT"), (4, "ACGTTCCGGA"), (5, "TTTTTGGGAC")], "taxid long, seq string")
    table = C.kmer_taxa(refs, tree(spark), 5)
    assert {r.taxid for r in table.collect()} >= {2, 3, 4, 5}
    reads = spark.createDataFrame([(1, "ACGTTGCAAT"), (2, "ACGTT"), (3, "GAGAGAGAG"), (4, "A")], "read_id long, seq string")
    calls = {r.read_id: r.taxid for r in C.classify(reads, table, tree(spark), 5).collect()}
    assert calls == {1: 3, 2: 2, 3: 0, 4: 0}
    assert C.classify(reads, table, tree(spark), 5, quick_hits=1).count() == 4
    report = C.rollup(spark.createDataFrame([(3, 2), (2, 1), (0, 1)], "taxid long, tax_reads long"), tree(spark))
    assert {r.taxid: (r.reads, r.tax_reads, r.percent) for r in report.collect()} == {3: (2, 2, 50.0), 2: (3, 1, 75.0), 1: (3, 0, 75.0), 0: (1, 1, 25.0)}


def test_prefixes_mates_upserts(spark):
    names = spark.createDataFrame([("ab",), ("abc",), ("x",)], "d string")
    files = spark.createDataFrame([("abc_1.txt",), ("ab_2.txt",), ("abcd",)], "f string")
    assert {(r.d, r.f) for r in first_by_prefix(names, files, "d", "f").collect()} == {("ab", "ab_2.txt"), ("abc", "abc_1.txt")}
    assert {(r.f, r.d) for r in first_by_prefix(names, files, "d", "f", sep="_", longest=True).collect()} == {("abc_1.txt", "abc"), ("ab_2.txt", "ab")}
    paths = spark.createDataFrame([("/d/s_R1.fq",), ("/d/s_R2.fq",), ("/d/SRR172902.fq",)], "path string")
    assert {(r.path, r.mate) for r in first_mates(paths, "path", S.mate_path(F.col("path"))).collect()} == {("/d/s_R1.fq", "/d/s_R2.fq"), ("/d/SRR172902.fq", None)}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {(r.k, r.v) for r in upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_scalars(spark):
    df = spark.createDataFrame([("tool_norm_default_quick", 3725.0, "a/b_R1.fastq.gz")], "p string, s double, f string")
    r = df.select(S.param_set_of(F.col("p"), "norm_"), S.duration_label(F.col("s")), S.dataset_name(F.col("f")), S.output_folder("tool", F.lit("x"), F.lit(True), F.lit("1G"))).first()
    assert tuple(r) == ("norm_default", "1h, 2m, 5s", "b", "tool_x_quick_preload-size-1G")
    k = spark.createDataFrame([("ACGTNAC",)], "seq string").select(S.canonical_kmers(F.col("seq"), 3).alias("k"), S.windows(F.lit("AC"), 3).alias("e")).first()
    assert k.k == ["CGT", "CGT", "GTA" if "GTA" > "TAC" else "TAC", "TAA" if "TAA" > "TTA" else "TTA", "GTT"][: len(k.k)] and k.e == []
    assert [r[0] for r in spark.range(1).select(S.decoded(S.code(F.lit("ACGT")), 4)).collect()] == ["ACGT"]


def test_sweep_shuffles_each_read_once(spark):
    rng = random.Random(4)
    reads = spark.createDataFrame([(f"d{i % 3}" if i else None, 0, i, "".join(rng.choice("ACGT") for _ in range(60))) for i in range(90)], "dataset string, file_nr int, ord long, seq string")
    sets = P.parameter_sets(spark, fastq=False)
    s = P.sweep(reads, sets, t=2, bits=12)
    got = {(r.dataset, r.param_set): r.reads_processed for r in s.collect()}
    assert got == {(d, x.param_set): n for x in sets.collect() for d, n in ((None, 1), ("d0", 29), ("d1", 30), ("d2", 30))}
    s.write.format("noop").mode("overwrite").save()
    s.collect()
    plan = s._jdf.queryExecution().executedPlan()
    plan = plan.toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == len(sets.collect()) - 1


def test_sweep_and_summary(spark):
    assert P.parameter_sets(spark).count() == 13 and P.parameter_sets(spark, fastq=False).count() == 7 and P.parameter_sets(spark, baseline_only=True).count() == 1
    reads = spark.createDataFrame([("d", 0, i, "ACGT" * 20) for i in range(4)], "dataset string, file_nr int, ord long, seq string")
    s = P.sweep(reads, P.parameter_sets(spark, fastq=False), t=2, bits=12)
    assert s.count() == 7 and {r.reads_processed for r in s.collect()} == {4}
    old = spark.createDataFrame([("d", "p", 1)], "dataset string, param_set string, reads_processed int")
    new = spark.createDataFrame([("/x/d_R1.fq.gz", "p", 2, 0), ("e.fa", "p", 3, 1)], "dataset string, param_set string, reads_processed int, exit_code int")
    assert [tuple(r) for r in P.update_summary(old, new).collect()] == [("d", "p", 2)]


def test_statistics_text_round_trip(spark):
    reads = spark.createDataFrame([("r", 0, i, "ACGTACGTAC"[i % 3 :] * (i % 2)) for i in range(6)], "run_id string, file_nr int, ord long, seq string")
    stats = run_statistics(reads, Params(d=1, k=5, C=0, N=3), t=2, bits=8)
    got = stats.select(statistics_text(5, 3, F.lit(7)).alias("t")).select(*statistics_columns(F.col("t"))).first()
    one = stats.first()
    assert (got.reads_processed, got.reads_accepted, got.time_s) == (6, one.unpaired_out, 7) and abs(got.reads_kept_pct - one.reads_kept_pct) < 0.01
    assert {r.cnt: r.cells for r in histogram_rows(stats).collect()} == {i: n for i, n in enumerate(one.histogram) if n}
    assert tuple(P.outcome(spark.createDataFrame([(0,), (1,), (None,)], "exit_code int")).first()) == (1, 2, 3)


def test_evaluation(spark):
    reports = spark.createDataFrame([("t", "d", 1, "no rank", 10, 0, "root"), ("t", "d", 2, "genus", 10, 6, "A"), ("t", "d", 3, "species", 4, 4, "Aa"), ("u", "e", 2, "genus", 5, 5, "A")], "tool string, dataset string, taxid long, rank string, reads long, tax_reads long, name string")
    truth = spark.createDataFrame([("d", "genus", 2), ("d", "species", 3)], "dataset string, level string, taxid long")
    m, s = P.evaluation(reports, truth)
    assert {(r.level, r.f1, r.aupr, r.total_reads) for r in m.where("tool = 't'").collect()} == {("genus", 1.0, 1.0, 6.0), ("species", 1.0, 1.0, 6.0)}
    assert [(r.tool, r.n_datasets, r.genus_f1_mean, r.genus_f1_std) for r in s.where("tool = 't'").collect()] == [("t", 1, 1.0, 0.0)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, i, "ACGTACGTAC", None) for i in range(3)], "run_id string, file_nr int, ord long, seq string, qual string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    p = Params(d=1, k=5, C=0, N=-1)
    q = N.greedy(stream, p).writeStream.format("memory").queryName("greedy_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.kept for r in spark.table("greedy_out").collect()) == 1
    q = N.batched(stream.drop("qual", "run_id"), p, str(tmp_path / "out"), str(tmp_path / "counts"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("kept").count() == 3


def test_command_line(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a\nACGTACGTAC\n>b\nACGTACGTAC\n>c\nTTTTGGGGCC\n")
    cli.main(["normalize", "-u", str(tmp_path / "r.fa"), "-k", "5", "-d", "1", "-C", "0", "-t", "3", "-m", "1", "--out", str(tmp_path / "o"), "-r"])
    assert {r.value for r in spark.read.text(str(tmp_path / "o_keep")).collect()} == {">a", "ACGTACGTAC", ">c", "TTTTGGGGCC"}


def test_clade_kmers_within_their_error(spark):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = draw(3000)
    refs = spark.createDataFrame([(11, core + draw(4000)), (12, core + draw(2000)), (21, draw(5000))], "taxid long, seq string")
    tree = spark.createDataFrame([(1, None), (10, 1), (11, 10), (12, 10), (20, 1), (21, 20), (22, 20)], "taxid long, parent long")
    up = C.closure(tree)
    table = materialized(C.kmer_taxa(refs, tree, 15, up))
    genomes = {r.taxid: r.seq for r in refs.collect()}
    reads = [(i, genomes[t := rng.choice([11, 12, 21])][(a := rng.randrange(len(genomes[t]) - 200)) : a + 200]) for i in range(150)] + [(900, draw(300)), (901, None)]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    calls = C.classify(df, table, tree, 15, up=up)
    exact = {r.taxid: r for r in C.clade_kmers(df, calls, table, 15, up, exact=True).collect()}
    near = {r.taxid: r for r in C.clade_kmers(df, calls, table, 15, up).collect()}
    assert set(exact) == set(near) == {1, 10, 11, 12, 20, 21}
    for t, r in exact.items():
        assert abs(near[t].kmers / r.kmers - 1) < 0.03 and abs(near[t].dup / r.dup - 1) < 0.03 and abs(near[t].cov - r.cov) < 0.03
    of = lambda s: {max(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for p in range(len(s) - 14) for w in [s[p : p + 15]]}
    called = {r.read_id for r in calls.where("taxid > 0").collect()}
    seen = set().union(*(of(s) for i, s in reads if i in called))
    assert exact[1].kmers == len(seen & set().union(*map(of, genomes.values()))) and exact[20].cov == len(seen & of(genomes[21])) / len(of(genomes[21]))
    lines = [r.value.split("\t") for r in C.report_lines(C.report(calls, C.clade_kmers(df, calls, table, 15, up), tree.selectExpr("*", "'x' as rank", "'y' as name"), up)).collect()]
    assert {x[6]: x[5] for x in lines[1:]}["0"] == "NA" and all(0 < float(x[5]) <= 1 for x in lines[2:])
