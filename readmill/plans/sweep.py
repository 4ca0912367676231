"""Parameter sweeps and the plans that tie operators together: normalise, evaluate, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import sequences as S
from readmill.operators import classify as C
from readmill.operators import evaluate as E
from readmill.operators.decide import Params
from readmill.operators.normalize import SEP, run_statistics
from readmill.operators.relational import first_mates, not_done, upsert

# The study's parameter sets for reads with qualities and without (name, k, Q, A, B, C, N)
_FASTQ = [
    ("default", 31, 20, 3, 5, 20, 10),
    ("low_phred", 31, 10, 3, 5, 20, 10),
    ("high_phred", 31, 30, 3, 5, 20, 10),
    ("low_rarity", 31, 20, 2, 5, 20, 10),
    ("high_rarity", 31, 20, 5, 5, 20, 10),
    ("low_contribution", 31, 20, 3, 3, 20, 10),
    ("high_contribution", 31, 20, 3, 10, 20, 10),
    ("low_abundance", 31, 20, 3, 5, 10, 10),
    ("high_abundance", 31, 20, 3, 5, 50, 10),
    ("strict_N", 31, 20, 3, 5, 20, 5),
    ("relaxed_N", 31, 20, 3, 5, 20, 20),
    ("conservative", 31, 30, 5, 10, 50, 5),
    ("permissive", 31, 10, 2, 3, 10, 20),
]
_FASTA = [
    ("default", 31, None, 3, 5, 20, 10),
    ("low_rarity_fasta", 31, None, 2, 5, 20, 10),
    ("high_rarity_fasta", 31, None, 5, 5, 20, 10),
    ("low_contribution_fasta", 31, None, 3, 3, 20, 10),
    ("high_contribution_fasta", 31, None, 3, 10, 20, 10),
    ("low_abundance_fasta", 31, None, 3, 5, 10, 10),
    ("high_abundance_fasta", 31, None, 3, 5, 50, 10),
]


def parameter_sets(spark: SparkSession, fastq: bool = True, baseline_only: bool = False, prefix: str = "") -> DataFrame:
    """(param_set, d, k, Q, A, B, C, N), names with the prefix; FASTA uses decision 3 and no Q."""
    rows = [(prefix + name, 6 if fastq else 3, *values) for name, *values in (_FASTQ if fastq else _FASTA) if not baseline_only or name == "default"]
    return spark.createDataFrame(rows, "param_set string, d int, k int, Q int, A int, B int, C int, N int")


def sweep(reads: DataFrame, params: DataFrame, **options) -> DataFrame:
    """(dataset, param_set, reads_processed, reads_accepted, reads_kept_pct, fp): every dataset under every parameter set.

    reads has dataset, file_nr, ord, seq[, qual, seq2, qual2]; a pair is one read. The parameter
    sets are few and go to every task; reads are shuffled once, by dataset, whatever the number of sets.
    """
    own = [c for c in ("d", "k", "A", "B", "C", "N", "Q") if c in params.columns]
    sets = {r["param_set"]: {c: r[c] for c in own} for r in params.select("param_set", *own).collect()}
    part = F.split("run_id", SEP, 2)
    found = run_statistics(reads.withColumnRenamed("dataset", "run_id"), Params(d=3), sets=sets, **options)
    return found.select(F.get(part, F.lit(1)).alias("dataset"), part[0].alias("param_set"), *counts_of_run())


def counts_of_run() -> list:
    """The columns of a sweep's summary from those of `run_statistics`."""
    both = lambda end: (F.col(f"unpaired_{end}") + F.col(f"paired_{end}"))
    return [both("in").alias("reads_processed"), both("out").alias("reads_accepted"), "reads_kept_pct", "fp"]


def update_summary(old: DataFrame, results: DataFrame) -> DataFrame:
    """old with successful results (exit_code 0) in place of those of the same dataset and parameter set, sorted."""
    new = results.where("exit_code = 0").withColumn("dataset", S.dataset_name(F.col("dataset"))).select(*old.columns)
    return upsert(old, new, ["dataset", "param_set"]).orderBy("dataset", "param_set")


def outcome(results: DataFrame) -> DataFrame:
    """One row: how many runs succeeded (exit_code 0), failed, and in all."""
    return results.agg(F.count_if(F.col("exit_code") == 0).alias("succeeded"), F.count_if(F.coalesce(F.col("exit_code") != 0, F.lit(True))).alias("failed"), F.count(F.lit(1)).alias("runs"))


def plan_runs(files: DataFrame, params: DataFrame, done: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(path, dataset, mate, param_set, ...): read files that aren't outputs, under every parameter set, less those done; a second mate's file stands with the first's, null where there is none."""
    f = files.where(S.is_read_file(F.col("path")) & ~F.col("path").rlike("_keep[^/]*$"))
    f = first_mates(f, "path", S.mate_path(F.col("path"))).where(~F.col("path").rlike(r"_R2[_.][^/]*$"))
    f = f.where(F.col("path") == only) if only else f
    runs = f.withColumn("dataset", S.dataset_name(F.col("path"))).join(F.broadcast(params))
    return not_done(runs, done, ["dataset", "param_set"]) if done is not None else runs


def evaluation(reports: DataFrame, truth: DataFrame, runtimes: DataFrame | None = None, preprocessing: DataFrame | None = None, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, summary) of reports (tool, dataset, taxid, rank, reads, tax_reads, name) against truth (dataset, level, taxid)."""
    keys = ["tool", "dataset"]
    return judged(C.to_predictions(reports, E.report_total(reports, keys), keys), truth, runtimes, preprocessing, asked)


def judged(pred: DataFrame, truth: DataFrame, runtimes: DataFrame | None = None, preprocessing: DataFrame | None = None, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, summary) of predictions (tool, dataset, level, taxid, abundance).

    asked (tool, dataset): what was run, where a tool may have found nothing; else what predictions
    there are. A tool without results for every dataset of the truth has no summary. runtimes
    (tool, dataset, runtime_s) and preprocessing (dataset, param_set, runtime_s, joined by the
    set that the tool's name holds) give means and deviations, where there are any.
    """
    keys = ["tool", "dataset"]
    asked = (pred.select(*keys) if asked is None else asked.select(*keys)).distinct().join(truth.select("dataset").distinct(), "dataset", "left_semi")
    levels = asked.join(truth.select("dataset", "level").distinct(), "dataset")
    m = E.metrics(pred.join(truth.select("dataset").distinct(), "dataset", "left_semi"), truth, asked=levels)
    m = m.join(E.scoring_total(pred, keys), keys, "left").withColumn("total_reads", F.coalesce("total_reads", F.lit(1e6)))
    names = ("precision", "recall", "f1", "aupr")
    wide = m.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("level") == level, F.col(v))), F.lit(0.0)).alias(f"{level}_{v}") for level in ("genus", "species") for v in names))
    n = truth.agg(F.count_distinct("dataset")).first()[0]
    wide = wide.join(E.complete_tools(wide, n).select("tool"), "tool", "left_semi")
    values = [f"{level}_{v}" for level in ("genus", "species") for v in names]
    if runtimes is not None:
        if preprocessing is not None:
            wide = wide.withColumn("param_set", E.param_set_in(F.col("tool"), preprocessing))
        wide = E.with_runtimes(wide, runtimes, preprocessing).withColumn("total_s", F.col("runtime_s") + F.col("preprocess_s"))
        values += ["runtime_s", "preprocess_s", "total_s"]
    return m, E.summary(wide, values)
