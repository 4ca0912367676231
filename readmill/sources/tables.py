"""Classification reports, truth and prediction tables, runtimes, sweep summaries and run logs.

Lines with too few columns are skipped; a line of enough columns with a value of the wrong type is
an error. Where a key comes twice, the later line counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.operators.relational import last_wins


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.rtrim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("value"), F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))


def _fields(rows: DataFrame, least: int) -> DataFrame:
    return rows.withColumn("f", F.split("value", "\t")).where(F.size("f") >= least)


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, percent, reads, tax_reads, kmers, dup, cov, taxid, rank, name, depth)."""
    f = _fields(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line")).where(~F.col("value").rlike("^[#%]")), 9)
    g = lambda i: F.col("f")[i]
    rows = f.select("path", "line", g(0).cast("double").alias("percent"), g(1).cast("bigint").alias("reads"), g(2).cast("bigint").alias("tax_reads"), g(3).cast("bigint").alias("kmers"), g(4).cast("double").alias("dup"), F.nullif(g(5), F.lit("NA")).cast("double").alias("cov"), g(6).cast("bigint").alias("taxid"), F.trim(g(7)).alias("rank"), F.trim(g(8)).alias("name"), F.floor((F.length(g(8)) - F.length(F.ltrim(g(8)))) / 2).cast("int").alias("depth"))
    return last_wins(rows, ["path", "taxid"], [F.col("line")])


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, taxid, fraction, abundance, rank, name) of headerless five-column tables: predictions and truth."""
    f = _fields(_lines(spark, paths), 5)
    g = lambda i: F.col("f")[i]
    rows = f.select("path", "line", g(0).cast("bigint").alias("taxid"), g(1).cast("double").alias("fraction"), g(2).cast("double").alias("abundance"), g(3).alias("rank"), g(4).alias("name"))
    return last_wins(rows, ["path", "taxid"], [F.col("line")]).drop("line")


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, runtime_s), header skipped."""
    f = _fields(_lines(spark, path), 2).where(F.col("f")[0] != "dataset")
    return last_wins(f.select("line", F.col("f")[0].alias("dataset"), F.col("f")[1].cast("double").alias("runtime_s")), ["dataset"], [F.col("line")]).drop("line")


def runtimes_from_logs(spark: SparkSession, paths: str | list[str], suffix: str = ".fastq.log") -> DataFrame:
    """(dataset, runtime_s) from the first `sequences ... processed in N s` line of files named dataset and suffix; others are left out."""
    rows = _lines(spark, paths).where(F.col("value").contains("sequences") & F.col("value").contains("processed in") & F.col("value").contains("s ("))
    rows = rows.withColumn("dataset", F.regexp_extract("path", "([^/]+)" + re.escape(suffix) + "$", 1)).where("dataset <> ''")
    return rows.groupBy("dataset").agg(F.min_by(F.regexp_extract("value", r"processed in ([\d.]+)s", 1), "line").cast("double").alias("runtime_s"))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, param_set, reads_processed, reads_accepted, reads_kept_pct, fp, runtime_s)."""
    f = _fields(_lines(spark, path), 7).where(F.col("f")[0] != "dataset")
    kinds = (("dataset", "string"), ("param_set", "string"), ("reads_processed", "bigint"), ("reads_accepted", "bigint"), ("reads_kept_pct", "double"), ("fp", "double"), ("runtime_s", "bigint"))
    return last_wins(f.select("line", *(F.col("f")[i].cast(t).alias(n) for i, (n, t) in enumerate(kinds))), ["dataset", "param_set"], [F.col("line")]).drop("line")


# The patterns of a normalizer's printed statistics
def statistics_columns(text):
    """The figures of a normalizer's printed statistics, 0 where one is missing."""
    get = lambda pattern, kind: F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast(kind), F.lit(0).cast(kind))
    return [get(r"total\s*:\s*(\d+)", "bigint").alias("reads_processed"), get(r"(?s)Reads accepted:.*?total\s*:\s*(\d+)", "bigint").alias("reads_accepted"), get(r"reads kept:\s*([\d.]+)\s*%", "double").alias("reads_kept_pct"), get(r"fp:\s*([\d.]+)", "double").alias("fp"), get(r"time needed:\s*(\d+)\s*s", "bigint").alias("time_s")]


def read_statistics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, reads_processed, reads_accepted, reads_kept_pct, fp, time_s) of run logs, each read whole."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), *statistics_columns(F.col("value")))
