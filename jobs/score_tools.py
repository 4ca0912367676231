"""Judges tools' predictions against the truth, dataset by dataset, and sums up the tools that have all datasets.

    python -m jobs.score_tools --tables FOLDER --out FOLDER [--config FILE]

Documents are predictions: a tool (source) found a taxon (doc_id) in a dataset (lang), at the level
of genus or species, as often as its length says; those labelled toxic it left out. Documents
labelled as of good quality are true, at both levels. Each dataset's results replace those of an
earlier run in its partition; `datasets` names those to judge (all, if none), and others stay.

    metrics/  tool, level, precision, recall, f1, aupr, tp, fp, fn, total_reads   by dataset   Parquet
    curves/   tool, taxid, abundance, rank, precision, recall, f1                 by dataset, level   ORC
    summary/  tool, n_datasets, means and deviations   by n_datasets   JSON, made from all of metrics/
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.operators import evaluate as E
from readmill.plans import sweep as P
from readmill.storage import materialized

from .common import config, log, session

NAME = "score_tools"
METRICS = "tool string, level string, precision double, recall double, f1 double, aupr double, tp long, fp long, fn long, total_reads double, dataset string"
VALUES = [f"{level}_{v}" for level in ("genus", "species") for v in ("precision", "recall", "f1", "aupr")]
SUMMARY = "tool string, " + ", ".join(f"{v}_{x} double" for v in VALUES for x in ("mean", "std")) + ", n_datasets long"


def predictions(documents: DataFrame, labels: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """(predictions (tool, dataset, level, taxid, abundance), truth (dataset, level, taxid)); rows without id, source or language are none of either."""
    docs = documents.where("doc_id is not null and source is not null and lang is not null").select(
        F.col("source").alias("tool"), F.col("lang").alias("dataset"), F.when(F.col("doc_id") % 2 == 0, "genus").otherwise("species").alias("level"), F.col("doc_id").alias("taxid"), F.floor(F.coalesce("n_chars", F.lit(0)) / unit).cast("double").alias("abundance"))
    of = lambda which: labels.where(which).select(F.col("doc_id").alias("taxid")).distinct()
    truth = docs.join(of("quality = 1"), "taxid", "left_semi").select("dataset", F.explode(F.array(F.lit("genus"), F.lit("species"))).alias("level"), "taxid").distinct()
    return docs.join(of("toxic = 1"), "taxid", "left_anti"), truth


def _written(rows: DataFrame, path: str, by: list[str], kind: str) -> None:
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)


def summed(wide: DataFrame) -> DataFrame:
    """(tool, means and deviations, n_datasets) of values with six places: means are those of decimals, halves rounded up, so that no order of summing tells."""
    exact = wide.withColumns({v: F.col(v).cast("decimal(20,6)") for v in VALUES})
    return E.summary(exact, VALUES).select("tool", *(F.round(f"{v}_{x}", 6).cast("double").alias(f"{v}_{x}") for v in VALUES for x in ("mean", "std")), "n_datasets")


def run(spark: SparkSession, tables: str, out: str, datasets: list[str] | None = None, abundance_unit: int = 50) -> dict[str, int]:
    """Judges the datasets and writes all three tables; returns how many predictions were read and results written."""
    pred, truth = predictions(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"), abundance_unit)
    if datasets:
        pred, truth = (x.where(F.col("dataset").isin(*datasets)) for x in (pred, truth))
    pred, truth = materialized(pred), materialized(truth)
    m, _ = P.judged(pred, truth)
    m = materialized(m)
    _written(m.select("tool", "level", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "aupr")), "tp", "fp", "fn", "total_reads", "dataset"), f"{out}/metrics", ["dataset"], "parquet")
    curve = E.prefix_curve(pred.join(truth.select("dataset").distinct(), "dataset", "left_semi"), truth)
    _written(curve.select("tool", "taxid", "abundance", "rank", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "dataset", "level"), f"{out}/curves", ["dataset", "level"], "orc")
    all_ = spark.read.schema(METRICS).parquet(f"{out}/metrics")
    best = lambda level, v: F.coalesce(F.max(F.when(F.col("level") == level, F.col(v))), F.lit(0.0))
    wide = all_.groupBy("tool", "dataset").agg(*(best(*v.split("_")).alias(v) for v in VALUES))
    whole = E.complete_tools(wide, all_.select("dataset").distinct().count())
    summary = materialized(summed(wide.join(whole.select("tool"), "tool", "left_semi")))
    summary.write.mode("overwrite").partitionBy("n_datasets").json(f"{out}/summary")  # all of it: tools may have come to miss a dataset
    took = {"predictions": pred.count(), "truths": truth.count(), "metrics": m.count(), "tools": summary.count()}
    log.info("read %(predictions)d predictions and %(truths)d truths, wrote %(metrics)d rows of metrics and %(tools)d of the summary", took)
    return took


def output(spark: SparkSession, out: str) -> DataFrame:
    """All rows of metrics, curves and the summary, told apart by `part`."""
    metrics = spark.read.schema(METRICS).parquet(f"{out}/metrics").select(F.lit("metrics").alias("part"), "*")
    curves = spark.read.schema("tool string, taxid long, abundance double, rank int, precision double, recall double, f1 double, dataset string, level string").orc(f"{out}/curves").select(F.lit("curve").alias("part"), "*")
    summary = spark.read.schema(SUMMARY).json(f"{out}/summary").select(F.lit("summary").alias("part"), "*")
    return metrics.unionByName(curves, allowMissingColumns=True).unionByName(summary, allowMissingColumns=True)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--tables", required=True, help="folder with documents.parquet and labels.parquet")
    p.add_argument("--out", required=True, help="folder for results")
    p.add_argument("--config", help="JSON file with settings in place of those beside this file")
    a = p.parse_args(args)
    spark = session(NAME)
    try:
        run(spark, a.tables, a.out, **config(NAME, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
