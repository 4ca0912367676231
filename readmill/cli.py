"""Command line: normalize, sweep, classify, evaluate, and background to run any command detached."""

from __future__ import annotations

import argparse
import os
import re
import subprocess
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readmill")
    sub = p.add_subparsers(dest="command", required=True)
    n = sub.add_parser("normalize", help="drop redundant reads", add_help=False)
    n.add_argument("--help", action="help")
    n.add_argument("-v", dest="louder", action="count", default=0, help="say more")
    n.add_argument("-q", dest="quieter", action="count", default=0, help="say less")
    n.add_argument("-u", action="append", default=[], help="unpaired input")
    n.add_argument("-1", dest="first", action="append", default=[], help="first mates")
    n.add_argument("-2", dest="second", action="append", default=[], help="second mates")
    for flag, name, default, what in (
        ("-k", "k", 32, "k-mer size"), ("-0", "qbase", 33, "quality base"), ("-Q", "Q", 20, "least quality"), ("-d", "d", 6, "decision"), ("-A", "A", 3, "rare below"), ("-B", "B", 3, "more than so many middling"),
        ("-C", "C", 20, "middling below"), ("-N", "N", -1, "most Ns; -1: any"), ("-t", "t", 0, "sketch rows; 0: by memory"), ("-m", "m", 0, "MiB a row; 0: by memory"), ("-h", "hash_set", 1, "hash set; 0: random"), ("-s", "strategy", 1, "memory: 0 GiB of -M, 1 an executor's, 2 free, 3 all"), ("-o", "detail", 0, "above 0: write k-mer counts"),
    ):
        n.add_argument(flag, dest=name, type=int, default=default, help=what)
    n.add_argument("-M", dest="memory", type=float, default=0.9, help="share of memory, or GiB with -s 0")
    n.add_argument("-b", dest="both", action="store_true", help="taken and ignored: decisions 3 and 4 tell")
    n.add_argument("-D", dest="dump", nargs="?", const="CM.dump", help="write the sketch")
    n.add_argument("--max-len", type=int, default=300)
    n.add_argument("--four-lines", action="store_true", help="FASTQ with four lines a record: split within files")
    n.add_argument("-f", dest="fasta", action="store_true", help="write FASTA")
    n.add_argument("-n", dest="count_n", action="store_true", help="count k-mers with N")
    n.add_argument("-H", dest="histogram", action="store_true", help="print the sketch's histogram")
    n.add_argument("-r", dest="rejected", action="store_true", help="write rejected reads too")
    n.add_argument("-z", dest="gzip", action="store_true")
    n.add_argument("--compat", action="store_true", help="first k-mer takes the smaller strand")
    n.add_argument("--out", required=True)
    s = sub.add_parser("sweep", help="normalise under every parameter set")
    s.add_argument("--folder", required=True)
    s.add_argument("--file")
    s.add_argument("--baseline-only", action="store_true")
    s.add_argument("--experiment-dir", required=True)
    s.add_argument("--param-prefix", default="", help="put before the names of parameter sets")
    s.add_argument("--skip-done", action="store_true", help="leave out what the summary has")
    s.add_argument("--no-reads", action="store_true", help="write no kept reads")
    s.add_argument("--reads-to", help="folder for kept reads, else that of the input")
    s.add_argument("--four-lines", action="store_true", help="FASTQ with four lines a record: split within files")
    s.add_argument("-t", type=int, default=10)
    s.add_argument("-m", type=int, default=1)
    c = sub.add_parser("classify", help="classify each dataset's reads by k-mers")
    c.add_argument("--folder", required=True, help="read files")
    c.add_argument("--ground-truth-dir", required=True)
    c.add_argument("--references", required=True, help="Parquet (taxid, seq)")
    c.add_argument("--taxonomy", required=True, help="Parquet (taxid, parent, rank, name)")
    c.add_argument("-k", type=int, default=31)
    c.add_argument("--tool", default="readmill")
    c.add_argument("--method-suffix", default="", help="only files that end with .<suffix>.gz")
    c.add_argument("--quick", action="store_true")
    c.add_argument("--preload-size", default="", help="part of the output folder's name")
    c.add_argument("--datasets-to-classify", nargs="+")
    c.add_argument("--four-lines", action="store_true", help="FASTQ with four lines a record: split within files")
    c.add_argument("--out", required=True, help="folder of tools' folders")
    e = sub.add_parser("evaluate", help="precision, recall, F1 and AUPR")
    e.add_argument("--ground-truth-dir", required=True)
    e.add_argument("--eval-dir", required=True)
    e.add_argument("--experiments-dir", help="where sweep wrote its summary")
    e.add_argument("--files-to-evaluate", nargs="+")
    e.add_argument("--only-tools", help="folders whose names hold this")
    e.add_argument("--report-suffix", default=".report.tsv")
    e.add_argument("--log-suffix", default=".fastq.log")
    b = sub.add_parser("background", help="run a command detached, with a log")
    b.add_argument("--log-dir", default="process_logs")
    b.add_argument("args", nargs=argparse.REMAINDER)
    return p


def sketch_size(megabytes: float, t: int = 0, m: int = 0) -> tuple[int, int]:
    """(rows, MiB a row) of a sketch in so much memory; a given t or m (rounded down to a power of two) stays. Rows are 4 to 10, if not given."""
    from readmill.functions.hashing import floor_power_of_two

    if t > 25:
        print("25 rows at most", file=sys.stderr)
        t = 25
    if m:
        m = floor_power_of_two(m)
        if not t:
            t = min(10, int(megabytes // m))
            if t < 4:
                raise SystemExit(f"rows of {m} MiB are too wide for {megabytes:.0f} MiB")
    elif t:
        m = floor_power_of_two(int(megabytes // t)) if megabytes >= t else 0
        if m < 32:
            raise SystemExit(f"{t} rows are too many for {megabytes:.0f} MiB")
    else:
        # ten rows of up to 4096 MiB where 256 fit, else the widest that leave room for more than five
        large = megabytes >= 2560
        m = floor_power_of_two(max(1, int(megabytes // 10))) if large else floor_power_of_two(max(1, min(256, -(-int(megabytes) // 5) - 1)))
        m = min(m, 4096)
        t = max(1, min(10, int(megabytes // m)))
    return t, m


def memory_mb(spark: SparkSession, strategy: int, fraction: float) -> float:
    """Memory for a sketch: `fraction` GiB (0), or that share of what an executor is given for Python, else for all (1), or of what this machine has free (2) or in all (3)."""
    if strategy == 0:
        return fraction * 1024
    if strategy == 1:
        conf = spark.sparkContext.getConf()
        given = conf.get("spark.executor.pyspark.memory", None) or conf.get("spark.driver.memory" if spark.sparkContext.master.startswith("local[") else "spark.executor.memory", "1g")
        number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", given.lower()).groups()
        return int(number) * {"k": 1 / 1024, "": 1, "m": 1, "g": 1024, "t": 1 << 20}[unit] * fraction
    names = {2: "MemFree", 3: "MemTotal"}
    if strategy not in names:
        raise SystemExit("-s is 0 to 3")
    with open("/proc/meminfo") as f:
        return next(int(x.split()[1]) for x in f if x.startswith(names[strategy])) / 1024 * fraction


def extra_bits(m: int) -> int:
    """Bits of a row of m MiB, rounded down to a power of two, above those of 1 MiB."""
    from readmill.functions.hashing import floor_power_of_two

    return floor_power_of_two(max(1, m)).bit_length() - 1


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    from readmill.operators.decide import Params
    from readmill.operators.normalize import normalize_all
    from readmill.sources import reads as R
    from readmill.sources import sinks

    if len(a.first) != len(a.second):
        raise SystemExit("-1 and -2 come in pairs")
    if not a.u and not a.first:
        raise SystemExit("no input")
    if a.k < 15:
        print("k is very small", file=sys.stderr)
    level = 3 + a.louder - a.quieter
    t, m = (a.t, a.m) if a.t and a.m else sketch_size(memory_mb(spark, a.strategy, a.memory), a.t, a.m)
    sides = [R.read_fastx(spark, a.u, four_lines=a.four_lines)] if a.u else []
    if a.first:
        unpaired = sides[0].agg(F.max("file_nr")).first()[0] if a.u else None
        pairs = R.paired(*(R.read_fastx(spark, x, four_lines=a.four_lines) for x in (a.first, a.second)))
        sides.append(pairs.withColumn("file_nr", F.col("file_nr") + (0 if unpaired is None else unpaired + 1)))
    reads = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
    reads = R.clipped(reads, a.max_len).withColumn("run_id", F.lit("0"))
    p = Params(d=a.d, k=a.k, A=a.A, B=a.B, C=a.C, N=a.N, Q=a.Q, qbase=a.qbase)
    began = time.monotonic()
    v, stats, cells = normalize_all(reads, p, t=t, bits=20 + extra_bits(m), hash_set=a.hash_set, max_len=a.max_len, count_n=a.count_n, first_min=a.compat, detail=a.detail > 0, dump=bool(a.dump), progress=level > 2)
    judged = reads.join(v.drop("run_id"), ["file_nr", "ord"])
    for rejected in (False, True)[: 1 + a.rejected]:
        sinks.write_reads(judged, a.out, rejected, a.gzip, a.fasta, a.detail > 0)
    if a.dump:
        sinks.write_sketch(cells, a.dump)
    if level > 0:
        print(stats.select(sinks.statistics_text(a.k, a.N, F.lit(time.monotonic() - began))).first()[0])
    if a.histogram:
        print("Histogram:\n" + "\n".join(f"\t{r.cnt}:\t{r.cells}" for r in sinks.histogram_rows(stats).orderBy("cnt").collect()))


def background(args: list[str], log_dir: str = "process_logs") -> tuple[int, str]:
    """Starts a command that outlives this process; returns its number and the log of all it prints."""
    args = args[1:] if args[:1] == ["--"] else args
    if not args:
        raise SystemExit("no command")
    os.makedirs(log_dir, exist_ok=True)
    log = os.path.join(log_dir, f"{os.path.basename(args[0])}__{time.strftime('%Y%m%d_%H%M%S')}.log")
    with open(log, "w") as f:
        pid = subprocess.Popen(args, stdout=f, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL, start_new_session=True).pid
    print(f"started {' '.join(args)} as {pid}; log: {log}")
    return pid, log


def main(args: list[str] | None = None) -> None:
    from readmill.plans import runs
    from readmill.plans import sweep as P
    from readmill.storage import release

    a = parser().parse_args(args)
    if a.command == "background":
        background(a.args, a.log_dir)
        return
    spark = SparkSession.builder.appName("readmill").getOrCreate()
    try:
        if a.command == "normalize":
            normalize(spark, a)
        elif a.command == "sweep":
            found = runs.experiments(spark, a.folder, a.experiment_dir, a.file, a.baseline_only, a.param_prefix, a.skip_done, not a.no_reads, a.reads_to, a.four_lines, t=a.t, bits=20 + extra_bits(a.m))
            o = P.outcome(found).first()
            print(f"{o.succeeded} of {o.runs} runs succeeded")
        elif a.command == "classify":
            print(runs.classification(spark, a.folder, a.ground_truth_dir, spark.read.parquet(a.references), spark.read.parquet(a.taxonomy), a.out, a.k, a.tool, a.method_suffix, a.quick, a.preload_size, a.datasets_to_classify, a.four_lines))
        else:
            runs.evaluate(spark, a.eval_dir, a.ground_truth_dir, a.experiments_dir, a.files_to_evaluate, a.only_tools, a.report_suffix, a.log_suffix)
    finally:
        release(spark)


if __name__ == "__main__":
    main()
