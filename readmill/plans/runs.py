"""Whole programs over folders of files: experiments, classification and evaluation, with what was done before kept."""

from __future__ import annotations

import re
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import sequences as S
from readmill.operators import classify as C
from readmill.operators import evaluate as E
from readmill.operators.decide import Params
from readmill.operators.normalize import normalize_all
from readmill.operators.relational import first_by_prefix, first_mates
from readmill.sources import reads as R
from readmill.sources import sinks, tables
from readmill.storage import materialized

from . import sweep as P

_FAILED = (PySparkException, Py4JJavaError)  # of a job; some errors of a task come as the latter

# Words in the names of result files that hold no tool's predictions, and endings of truth files
NOT_TOOLS = r"average|max|median|priority"
NOT_PREDICTIONS = r"_(TRUTH|COMMUNITY)\.txt$"


def read_runs(spark: SparkSession, runs: list, four_lines: bool = False) -> DataFrame:
    """Reads of (path, mate) rows: single files, and pairs in lockstep; `path` is the first mate's file. four_lines: if all are FASTQ by name, they have four lines a record, and are split within files."""
    single, double = [r.path for r in runs if not r.mate], [r for r in runs if r.mate]
    four = four_lines and all(re.search(r"\.(fq|fastq)(\.gz)?(\.[^/]*\.gz)?$", p) for r in runs for p in (r.path, r.mate) if p)
    read = lambda paths: R.read_fastx(spark, paths, four_lines=four)
    sides = [read(single)] if single else []
    if double:
        sides.append(R.paired(read([r.path for r in double]), read([r.mate for r in double])).withColumn("file_nr", F.col("file_nr") + len(single)))
    out = sides[0]
    for x in sides[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def experiments(spark: SparkSession, folder: str, experiment_dir: str, only: str | None = None, baseline_only: bool = False, prefix: str = "", skip_done: bool = False, write: bool = True, out: str | None = None, four_lines: bool = False, **options) -> DataFrame:
    """Normalises a folder's read files under every parameter set; returns the results of this run.

    Results replace those of the same dataset and set in `summary.tsv`; skip_done leaves out those
    that are there. `logs` gets a file for each run, and kept reads go beside the input (or into
    `out`) as `<file>.<set>.gz`, those of second mates under their own file's name. A run that fails,
    by a file that can't be read or by its parameters, has exit code 1 and what failed in its log;
    the others go on, and what the summary knew of it stays.
    """
    summary = f"{experiment_dir}/summary.tsv"
    old = materialized(tables.read_sweep(spark, summary)) if sinks.exists(spark, summary) else None
    files, results = R.listing(spark, folder), None
    for fastq in (True, False):
        sets = P.parameter_sets(spark, fastq, baseline_only, prefix)
        runs = P.plan_runs(files.where(S.is_fastq(F.col("path")) == fastq), sets, old if skip_done else None, only)
        runs = materialized(runs.select("path", "mate", "dataset", *sets.columns))
        chosen = runs.select("path", "mate").distinct().orderBy("path").collect()  # names of files only
        if not chosen:
            continue
        broken: dict[str, str] = {}
        try:
            found = _normalized(spark, chosen, runs, four_lines, options)
        except _FAILED:
            broken = _unreadable(spark, chosen)
            if not broken:
                raise
            chosen = [r for r in chosen if r.path not in broken]
            found = _normalized(spark, chosen, runs, four_lines, options) if chosen else None
        if broken:
            errors = spark.createDataFrame(sorted(broken.items()), "path string, error string")
            failed = materialized(runs.select("path", "param_set", "mate", "dataset", "k").join(F.broadcast(errors), "path"))
            _failures(failed, f"{experiment_dir}/logs")
            none = failed.select("dataset", "param_set", *(F.lit(0).cast(t).alias(c) for c, t in (("reads_processed", "long"), ("reads_accepted", "long"), ("reads_kept_pct", "double"), ("fp", "double"), ("runtime_s", "double"))), F.lit(1).alias("exit_code"))
            results = none if results is None else results.unionByName(none)
        if found is None:
            continue
        reads, v, done = found
        fine = done.where("error is null")
        _logs(fine, f"{experiment_dir}/logs")
        _failures(done.where("error is not null"), f"{experiment_dir}/logs")
        if write:
            _kept(reads.join(v.select("run_id", "file_nr", "ord", "kept"), ["run_id", "file_nr", "ord"]).where("kept").join(F.broadcast(fine.select("run_id")), "run_id"), fine, folder, out or folder)
        code = F.when(F.col("error").isNull(), 0).otherwise(1)
        one = done.select("dataset", "param_set", *P.counts_of_run(), F.col("seconds").alias("runtime_s"), code.alias("exit_code"))
        results = one if results is None else results.unionByName(one)
    if results is None:
        return spark.createDataFrame([], "dataset string, param_set string, reads_processed long, reads_accepted long, reads_kept_pct double, fp double, runtime_s double, exit_code int")
    results = materialized(results)
    known = old.withColumn("runtime_s", F.col("runtime_s").cast("double")) if old is not None else results.drop("exit_code").limit(0)
    sinks.write_tsv(sinks.sweep_rows(P.update_summary(known, results)), summary, order=["dataset", "param_set"])
    return results


def _normalized(spark: SparkSession, chosen: list, runs: DataFrame, four_lines: bool, options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, verdicts, a row of figures or an error for each run) of the chosen files under their parameter sets."""
    reads = R.clipped(read_runs(spark, chosen, four_lines)).join(F.broadcast(runs.drop("mate")), "path")  # a row for each file and set
    reads = reads.withColumn("run_id", F.concat_ws("\x1f", "path", "param_set"))
    v, stats, _ = normalize_all(reads.drop("path", "dataset", "param_set"), Params(d=3), catch=True, **options)
    part = F.split("run_id", "\x1f")
    done = stats.withColumns({"path": part[0], "param_set": part[1], "seconds": F.col("millis") / 1000})
    return reads, v, materialized(done.join(runs.select("path", "param_set", "mate", "dataset", "k", "N"), ["path", "param_set"]))


def _unreadable(spark: SparkSession, chosen: list) -> dict[str, str]:
    """What is wrong with each of the files (or its mate) that can't be read to the end, a job for each; asked only after a failure."""
    found = {}
    for r in chosen:
        try:
            spark.read.text([x for x in (r.path, r.mate) if x]).agg(F.sum(F.length("value"))).collect()
        except _FAILED as e:
            lines = [x for x in str(e).split("\n") if x.strip()]
            found[r.path] = next((x.strip() for x in reversed(lines) if "Caused by" in x), lines[0])
    return found


def _failures(failed: DataFrame, folder: str) -> None:
    """A log with what failed for each run."""
    name = F.concat(F.lit(f"{folder}/"), F.regexp_replace("path", "^.*/", ""), F.lit("_"), "param_set", F.lit("_log.txt"))
    text = F.concat(F.lit("Input: "), "path", F.lit("\nParameter set: "), "param_set", F.lit("\nReturn code: 1\n\n"), "error", F.lit("\n"))
    rows = failed.select(name.alias("path"), text.alias("value"))
    sinks.write_files(rows, folder, sorted(r.path for r in rows.select("path").distinct().collect()))  # names only


def _logs(done: DataFrame, folder: str) -> None:
    """A log for each run: its parameters, its statistics and how long it took."""
    name = F.concat(F.lit(f"{folder}/"), F.regexp_replace("path", "^.*/", ""), F.lit("_"), "param_set", F.lit("_log.txt"))
    head = F.concat(F.lit("Input: "), "path", F.when(F.col("mate").isNotNull(), F.concat(F.lit(" "), "mate")).otherwise(""), F.lit("\nParameter set: "), "param_set", F.lit("\nk: "), F.col("k").cast("string"), F.lit("\nReturn code: 0\nElapsed time: "), sinks.fixed(F.col("seconds"), 2), F.lit(" s\n\n"))
    rows = done.select(name.alias("path"), F.concat(head, sinks.statistics_text(F.col("k"), F.col("N"), F.col("seconds"))).alias("value"))
    rows = rows.groupBy("path").agg(F.min("value").alias("value"))
    sinks.write_files(rows, folder, sorted(r.path for r in rows.select("path").collect()))  # names only


def _kept(reads: DataFrame, done: DataFrame, folder: str, out: str) -> None:
    """Kept reads as `<file>.<set>.gz`, in order; a run's reads lie in one partition, as they did in the filter."""
    part = F.split("run_id", "\x1f")
    text = lambda m: sinks.record_text(F.col(f"name{m}"), F.col(f"comment{m}"), F.col(f"seq{m}"), F.col(f"qual{m}"))
    at = lambda c: F.concat(F.lit(f"{out}/"), F.regexp_replace(c, "^.*/", ""), F.lit("."), F.col("param_set"), F.lit(".gz"))
    both = [F.struct(at("path").alias("path"), text("").alias("value"))]
    rows = reads.withColumns({"path": part[0], "param_set": part[1]})
    if "seq2" in reads.columns:
        both.append(F.when(F.col("seq2").isNotNull(), F.struct(at(S.mate_path(F.col("path"))).alias("path"), text("2").alias("value"))))
    rows = rows.select("file_nr", "ord", F.explode(F.array(*both)).alias("x")).where("x is not null").select("x.path", "file_nr", "ord", "x.value")
    names = {r.p for r in done.select(F.explode(F.array(at("path"), F.when(F.col("mate").isNotNull(), at("mate")))).alias("p")).where("p is not null").collect()}
    sinks.write_files(rows, out, sorted(names), ["file_nr", "ord"], gzip=True)


def classification(spark: SparkSession, folder: str, truth_dir: str, references: DataFrame, taxonomy: DataFrame, out: str, k: int = 31, tool: str = "readmill", method_suffix: str = "", quick: bool = False, preload: str = "", datasets: list[str] | None = None, four_lines: bool = False) -> str:
    """Classifies the read files of each dataset of the truth; returns the folder of its reports.

    Of each dataset the first file whose name starts with its name (and ends with
    `.<method_suffix>.gz`) is read, with its second mate. Datasets with a recorded runtime or a
    report are left out; runtimes are recorded after each dataset.
    """
    target = f"{out}/" + spark.range(1).select(S.output_folder(tool, F.lit(method_suffix), F.lit(quick), F.lit(preload))).first()[0]
    runtime_file = f"{target}/runtimes.tsv"
    recorded = tables.read_runtimes(spark, runtime_file).collect() if sinks.exists(spark, runtime_file) else []
    truth = R.listing(spark, f"{truth_dir}/genus").where(~F.col("name").startswith(".") & F.col("name").endswith("_TRUTH.txt"))
    wanted = truth.select(F.regexp_replace("name", r"_TRUTH\.txt$", "").alias("dataset"))
    wanted = wanted.where(F.col("dataset").isin(*datasets)) if datasets else wanted
    files = R.listing(spark, folder)
    files = files.where(F.col("name").endswith(f".{method_suffix}.gz")) if method_suffix else files
    chosen = first_by_prefix(wanted, first_mates(files, "path", S.mate_path(F.col("path"))), "dataset", "name").orderBy("dataset").collect()  # one file for each dataset
    runtimes = {r.dataset: r.runtime_s for r in recorded}
    up = C.closure(taxonomy)
    table = materialized(C.kmer_taxa(references, taxonomy, k, up))
    for r in chosen:
        report = f"{target}/{r.dataset}_REPORT.tsv"
        if r.dataset in runtimes or sinks.exists(spark, report):
            continue
        began = time.monotonic()
        reads = R.clipped(read_runs(spark, [r], four_lines), 1 << 30).withColumn("read_id", F.struct("file_nr", "ord"))
        calls = materialized(C.classify(reads, table, taxonomy, k, quick_hits=1 if quick else 0, up=up))
        sinks.write_file(C.report_lines(C.report(calls, C.clade_kmers(reads, calls, table, k, up), taxonomy, up)), report)
        runtimes[r.dataset] = time.monotonic() - began
        sinks.write_tsv(sinks.runtime_rows(spark.createDataFrame(sorted(runtimes.items()), "dataset string, runtime_s double")), runtime_file, order=["dataset"])
    return target


def convert_reports(spark: SparkSession, folder: str, tool: str, datasets: list[str], suffix: str = ".report.tsv") -> None:
    """Writes a tool's reports (`<dataset>_REPORT.tsv`, else the first `<dataset>*<suffix>`) as `genus` and `species/<dataset>_<tool>.txt`; reports without reads are left out."""
    files = {r.name: r.path for r in R.listing(spark, folder).collect()}
    found = {}
    for d in datasets:
        names = [f"{d}_REPORT.tsv", *sorted(n for n in files if n.startswith(d) and n.endswith(suffix))]
        if name := next((n for n in names if n in files), None):
            found[files[name]] = d
    if not found:
        return
    of = spark.createDataFrame([(R.plain_path(p), d) for p, d in found.items()], "path string, dataset string")
    rows = tables.read_reports(spark, list(found)).withColumn("path", R.plain_column("path")).join(F.broadcast(of), "path")
    totals = E.report_total(rows, ["dataset"]).where("total_reads > 0")
    pred = materialized(C.to_predictions(rows, totals, ["dataset"]).select("dataset", "level", "taxid", "fraction", "abundance", "rank", "name"))
    there = {r.dataset for r in totals.collect()}
    name = F.concat(F.lit(f"{folder}/"), "level", F.lit("/"), "dataset", F.lit(f"_{tool}.txt"))
    value = sinks.tsv([F.col("taxid"), F.col("fraction"), F.col("abundance").cast("bigint"), F.col("rank"), F.col("name")])
    rows = pred.select(name.alias("path"), (-F.col("abundance")).alias("by"), "taxid", value.alias("value"))
    sinks.write_files(rows, folder, [f"{folder}/{level}/{d}_{tool}.txt" for level in ("genus", "species") for d in sorted(there)], ["by", "taxid"])


def evaluate(spark: SparkSession, eval_dir: str, truth_dir: str, experiments_dir: str | None = None, datasets: list[str] | None = None, only_tools: str | None = None, report_suffix: str = ".report.tsv", log_suffix: str = ".fastq.log", detailed: str = "", skip: str = "metrics") -> DataFrame:
    """Judges the predictions in every folder of eval_dir; writes `metrics`, `benchmark_summary.tsv` and plot rows, and returns the summary.

    A folder with reports gets predictions from them first. A tool is judged on a dataset where its
    genus and species files are both there, if they are empty too; datasets whose truth is missing at
    a level are left out. Runtimes come from a folder's
    `runtimes.tsv`, else from its logs; those of preprocessing from the experiments' summary. Files
    of metrics are written for folders whose name holds `detailed`. Folders of one name can't be;
    a tool's name in two folders is told apart by them.
    """
    truths = [{r.name for r in R.listing(spark, f"{truth_dir}/{level}").collect() if not r.name.startswith(".") and r.name.endswith("_TRUTH.txt")} for level in ("genus", "species")]
    names = sorted(truths[0] & truths[1])
    for name in sorted((truths[0] | truths[1]) - set(names)):
        print(f"left out, as its truth is there at one level only: {name}")
    datasets = [d for d in datasets if f"{d}_TRUTH.txt" in names] if datasets else [n.removesuffix("_TRUTH.txt") for n in names]
    if not datasets:
        raise FileNotFoundError(f"no truth for the datasets in {truth_dir}")
    wanted = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    truth = tables.read_predictions(spark, [f"{truth_dir}/{level}/{d}_TRUTH.txt" for level in ("genus", "species") for d in datasets])
    truth = materialized(truth.select(F.regexp_extract("path", r"([^/]+)_TRUTH\.txt$", 1).alias("dataset"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("level"), "taxid"))
    folders = [f for f in R.folders(spark, eval_dir) if f.rsplit("/", 1)[-1] != skip and (not only_tools or only_tools.lower() in f.rsplit("/", 1)[-1].lower())]
    asked, pred, runtimes = [], [], []
    for folder in folders:
        tool = folder.rsplit("/", 1)[-1]
        convert_reports(spark, folder, tool, datasets, report_suffix)
        files = {level: {r.name: r.path for r in R.listing(spark, f"{folder}/{level}").collect() if not re.search(NOT_TOOLS, r.name) and not re.search(NOT_PREDICTIONS, r.name)} for level in ("genus", "species")}
        both = sorted(set(files["genus"]) & set(files["species"]))
        if not both:
            continue
        found = first_by_prefix(wanted, spark.createDataFrame([(n,) for n in both], "name string"), "dataset", "name", sep="_", longest=True)
        found = found.select("name", "dataset", F.concat_ws("/", F.lit(tool), F.nullif(S.tool_name(F.col("name"), F.col("dataset")), F.lit(tool))).alias("tool"))
        rows = tables.read_predictions(spark, [files[level][n] for level in files for n in both])
        rows = rows.withColumns({"name_": F.url_decode(F.regexp_replace("path", "^.*/", "")), "level": F.regexp_extract("path", "([^/]+)/[^/]+$", 1)})
        pred.append(rows.join(F.broadcast(found.withColumnRenamed("name", "name_")), "name_").select("tool", "dataset", "level", "taxid", "abundance"))
        asked.append(found.select("tool", "dataset"))
        times = _runtimes(spark, folder, datasets, log_suffix)
        if times is not None:
            runtimes.append(times.join(F.broadcast(found.select("tool").distinct())))
    if not asked:
        raise FileNotFoundError(f"no predictions in {eval_dir}")
    union = lambda parts: materialized(_union(parts))
    before = f"{experiments_dir}/summary.tsv" if experiments_dir else None
    before = tables.read_sweep(spark, before) if before and sinks.exists(spark, before) else None
    m, summary = P.judged(union(pred), truth, union(runtimes) if runtimes else None, before, union(asked))
    m, summary = materialized(m), materialized(summary)
    rows = sinks.metrics_rows(m.where(F.col("tool").contains(detailed)), ["tool", "dataset"])
    rows = rows.select(F.concat(F.lit(f"{eval_dir}/{skip}/"), F.replace("tool", F.lit("/"), F.lit("_")), F.lit("_"), "dataset", F.lit("_metrics.tsv")).alias("path"), "value")
    sinks.write_files(rows, eval_dir, sorted(r.path for r in rows.select("path").collect()))
    sinks.write_tsv(sinks.summary_rows(summary), f"{eval_dir}/benchmark_summary.tsv", order=["Tool"])
    whole = m.join(summary.select("tool"), "tool", "left_semi")
    sinks.write_tsv(E.metric_plot(whole), f"{eval_dir}/benchmark_metrics_plot.tsv", order=["tool", "level", "value"])
    if runtimes:
        plot = E.runtime_plot(summary.select("tool", F.col("runtime_s_mean").alias("runtime_s"), F.col("preprocess_s_mean").alias("preprocess_s")))
        sinks.write_tsv(plot, f"{eval_dir}/benchmark_runtime_plot.tsv", order=["tool"])
    return summary


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _runtimes(spark: SparkSession, folder: str, datasets: list[str], log_suffix: str) -> DataFrame | None:
    """(dataset, runtime_s) of a folder: its table, else its logs; None where there is neither."""
    if sinks.exists(spark, f"{folder}/runtimes.tsv"):
        return tables.read_runtimes(spark, f"{folder}/runtimes.tsv")
    logs = [r.path for r in R.listing(spark, f"{folder}/log").collect() if r.name.removesuffix(log_suffix) in datasets and r.name.endswith(log_suffix)]
    return tables.runtimes_from_logs(spark, logs, log_suffix) if logs else None
