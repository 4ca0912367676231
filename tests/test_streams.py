"""Streams against the same filter over the whole input: pairs, qualities, counts in parts, names and line ends of files."""

import random

import pytest
from pyspark.sql import functions as F

from readmill.operators.decide import Params
from readmill.operators.normalize import add_counts, normalize, normalize_batch
from readmill.plans import runs
from readmill.sources import reads as R
from readmill.streaming import normalize_stream as N

SCHEMA = "run_id string, file_nr int, ord long, seq string, qual string, seq2 string, qual2 string"


def pairs(n=60, seed=1):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(120))
    out = []
    for i in range(n):
        a, b = rng.randrange(90), rng.randrange(90)
        seq2 = rng.choice([genome[b : b + 30], genome[b : b + 30], "ACG", None])
        qual = lambda s: None if s is None else "".join(rng.choice("5IIIIIIIIIIIIII+") for _ in s)
        out.append((rng.choice("ab"), i // 20, i, genome[a : a + 30], qual(genome[a : a + 30]), seq2, qual(seq2)))
    return out + [("a", 9, 99, None, None, None, None)]


def streamed(spark, frame, folder, parts, start):
    for i, part in enumerate(parts):  # a file for each micro-batch, in order
        frame.where(part).coalesce(1).write.mode("append").parquet(str(folder))
    q = start(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    q.awaitTermination(240)
    assert q.exception() is None


@pytest.mark.parametrize("d", [3, 6])
def test_streamed_pairs_are_judged_as_in_one_pass(spark, tmp_path, d):
    frame = spark.createDataFrame(pairs(), SCHEMA)
    p = Params(d=d, k=9, A=2, B=3, C=4, N=2, Q=15)
    start = lambda s: N.greedy(s, p, t=3, bits=12).writeStream.format("memory").queryName(f"pairs_{d}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    streamed(spark, frame, tmp_path / "in", [F.col("file_nr") == i for i in (0, 1, 2, 9)], start)
    key = lambda rows: sorted((r.run_id, r.file_nr, r.ord, r.kept, r.reason) for r in rows.collect())
    want = key(normalize(frame, p, t=3, bits=12))
    assert key(spark.table(f"pairs_{d}")) == want
    single = key(normalize(frame.drop("seq2", "qual2"), p, t=3, bits=12))
    assert single != want and {r[4] for r in want} >= {None, "too_short", "redundant"}  # mates count


def test_batches_write_their_own_counts(spark, tmp_path):
    frame = spark.createDataFrame([r[1:4] for r in pairs(100, 2)], "file_nr int, ord long, seq string")
    p = Params(d=1, k=9, C=3, N=-1)
    start = lambda s: N.batched(s, p, str(tmp_path / "out"), str(tmp_path / "counts"), str(tmp_path / "c"), every=2)
    streamed(spark, frame, tmp_path / "in", [F.col("file_nr") == i for i in range(5)], start)
    counts, want = None, []
    for i in range(5):
        v, counts = normalize_batch(frame.where(F.col("file_nr") == i), counts, p)
        want += [(r.ord, r.kept) for r in v.collect()]
    assert sorted((r.ord, r.kept) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)
    key = lambda rows: sorted((r.canon, r.d) for r in rows.collect())
    assert key(N.counts_before(spark, str(tmp_path / "counts"), 5, 2)) == key(counts)
    assert sorted(x.name for x in (tmp_path / "counts").iterdir() if x.is_dir()) == ["base=4", "batch=2", "batch=3", "batch=4"] or sorted(x.name for x in (tmp_path / "counts").iterdir() if x.is_dir()) == ["base=2", "base=4", "batch=2", "batch=3", "batch=4"]
    many = spark.createDataFrame([("A", 200), ("A", 100), ("C", 1)], "canon string, d int")
    assert key(add_counts(many, many)) == [("A", 253), ("C", 2)]


def test_names_end_at_any_blank(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(b"@r1 one two\r\nACGT\r\n+\r\nIIII\r\n@r2\tx y\r\nACGT\r\n+\r\nIIII\r\n@r3\r\nAC\r\n+\r\nII\r\n")
    want = [("r1", "one two"), ("r2", "x y"), ("r3", "")]
    for four in (False, True):
        got = R.read_fastx(spark, [str(tmp_path / "a.fq")], four_lines=four).orderBy("ord").collect()
        assert [(r.name, r.comment) for r in got] == want and [r.seq for r in got] == ["ACGT", "ACGT", "AC"] and [len(r.qual) for r in got] == [4, 4, 2]
    (tmp_path / "b.fa").write_bytes(b">r1 one two\r\nAC\r\nGT\r\n>r2\tx y\r\nAC\r\n>r3\r\nA\r\n")
    got = R.read_fasta_split(spark, [str(tmp_path / "b.fa")]).orderBy("at").collect()
    assert [(r.name, r.comment) for r in got] == want and [r.seq for r in got] == ["ACGT", "AC", "A"]


def test_a_dataset_without_one_of_its_truths_is_left_out(spark, tmp_path, capsys):
    for level in ("genus", "species"):
        for folder in ("truth", "eval/tool"):
            (tmp_path / folder / level).mkdir(parents=True)
        for d in ("one", "two"):
            (tmp_path / "eval/tool" / level / f"{d}_tool.txt").write_text("7\t1\t3\tgenus\tA\n")
        (tmp_path / "truth" / level / "one_TRUTH.txt").write_text("7\t1\t3\tgenus\tA\n")
    (tmp_path / "truth/genus/two_TRUTH.txt").write_text("7\t1\t3\tgenus\tA\n")
    s = runs.evaluate(spark, str(tmp_path / "eval"), str(tmp_path / "truth")).collect()
    assert [(r.tool, r.n_datasets, r.genus_f1_mean) for r in s] == [("tool", 1, 1.0)] and "two_TRUTH.txt" in capsys.readouterr().out
