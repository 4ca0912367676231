"""Classifies reads as their files arrive, and keeps each source's report up to date.

    python -m jobs.classify_new_reads --tables FOLDER --out FOLDER [--config FILE]

A file stream reads the documents (as reads) that came since the last run, as its checkpoint under
`out` says, and ends when they are done. The k-mer table of the references (benchmark items, in the
tree of nations and regions) is written once, in buckets of minimizers; later runs open it. Each
micro-batch writes its calls and their sums by source and taxon into partitions of its own, which it
replaces if it is replayed; a report sums up the sums, so that a run's work is that of its own reads.

    calls/    read_id, taxid, hits      by batch, source   Parquet
    tallies/  taxid, tax_reads          by batch, source   Parquet
    reports/  taxid, rank, name, reads, tax_reads, percent   by source   ORC
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import sequences as S
from readmill.operators import classify as C
from readmill.operators.minimizers import Index
from readmill.storage import materialized

from .common import config, log, references, session, taxonomy, there

NAME = "classify_new_reads"
CALLS = "read_id long, taxid long, hits long, batch int, source string"
TALLIES = "taxid long, tax_reads long, batch int, source string"
_NONE = "none"  # the source of reads that name none


def index_of(spark: SparkSession, tables: str, out: str, tree: DataFrame, up: DataFrame, k: int, m: int, buckets: int) -> Index:
    """The references' k-mer table, made where there is none of these parameters yet."""
    path = f"{out}/index-{k}-{m}-{buckets}"
    if there(spark, path):
        log.info("opened index %s", path)
        return Index(spark, path, k, m, buckets)
    items = references(spark.read.parquet(f"{tables}/benchmark.parquet"))
    made = Index.write(C.kmer_taxa(items, tree, k, up), path, k, m, buckets)
    log.info("read %d references, wrote index %s of %d k-mers", items.count(), path, spark.read.parquet(path).count())
    return made


def _written(rows: DataFrame, path: str) -> None:
    """rows by batch and source; partitions of the same batch and source are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "source").parquet(path)


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)


def report(tallies: DataFrame, tree: DataFrame, up: DataFrame) -> DataFrame:
    """(source, taxid, rank, name, reads, tax_reads, percent) of the taxa with reads, 0 for those not classified."""
    direct = tallies.groupBy("source", "taxid").agg(F.sum("tax_reads").alias("tax_reads"))
    named = C.rollup(direct, tree, up=up, keys=["source"]).join(tree.select("taxid", "rank", "name"), "taxid", "left")
    return named.select("source", "taxid", F.coalesce("rank", F.lit("no rank")).alias("rank"), F.coalesce("name", F.lit("unclassified")).alias("name"), "reads", "tax_reads", F.round("percent", 6).alias("percent"))


def run(spark: SparkSession, tables: str, out: str, k: int = 31, minimizer: int = 13, buckets: int = 16, files_a_batch: int = 8, quick_hits: int = 0) -> dict[str, int]:
    """Takes what is new in documents.parquet of `tables`; returns how many reads and batches this run took.

    A row is a read; one of null id or text is none (null texts are reads without k-mers). Rows of
    one id in a batch share their calls. Without new files nothing changes.
    """
    documents = f"{tables}/documents.parquet"
    tree = materialized(taxonomy(spark.read.parquet(f"{tables}/nation.parquet"), spark.read.parquet(f"{tables}/region.parquet")))
    up = C.closure(tree)
    index = index_of(spark, tables, out, tree, up, k, minimizer, buckets)
    # as a pattern, since a stream's plain path must be a folder, and the table may be a single file
    new = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", files_a_batch).parquet(f"{tables}/documents.parque[t]")
    took = {"reads": 0, "batches": 0}

    def step(batch: DataFrame, number: int) -> None:
        of = batch.sparkSession
        rows = materialized(batch.where("doc_id is not null").select(F.col("doc_id").alias("read_id"), F.coalesce(F.nullif("source", F.lit("")), F.lit(_NONE)).alias("source"), S.pseudo_bases(F.col("text")).alias("seq")))
        own = Index(of, index.path, index.k, index.m, index.buckets)
        calls = C.classify_by_index(rows.select("read_id", "seq").dropDuplicates(["read_id", "seq"]), own, tree, quick_hits, up).distinct()
        _written(rows.select("read_id", "source").join(calls, "read_id").withColumn("batch", F.lit(number)).select("read_id", "taxid", "hits", "batch", "source"), f"{out}/calls")
        mine = of.read.schema(CALLS).parquet(f"{out}/calls").where(F.col("batch") == number)
        sums = mine.groupBy("batch", "source", "taxid").agg(F.count(F.lit(1)).alias("tax_reads"))
        _written(sums.select("taxid", "tax_reads", "batch", "source"), f"{out}/tallies")
        n = rows.count()
        took["reads"] += n
        took["batches"] += 1
        log.info("batch %d: read %d reads of %s, wrote calls and tallies", number, n, documents)

    query = new.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = report(_kept(spark, f"{out}/tallies", TALLIES), tree, up)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").orc(f"{out}/reports")
    log.info("took %(reads)d reads in %(batches)d batches; wrote reports", took)
    return took


def output(spark: SparkSession, out: str) -> DataFrame:
    """(part, source, read_id, taxid, hits, reads, tax_reads, percent): all calls and the lines of all reports."""
    calls = _kept(spark, f"{out}/calls", CALLS).select(F.lit("call").alias("part"), "source", "read_id", "taxid", "hits")
    lines = spark.read.schema("taxid long, rank string, name string, reads long, tax_reads long, percent double, source string").orc(f"{out}/reports")
    return calls.unionByName(lines.select(F.lit("report").alias("part"), "source", "taxid", "reads", "tax_reads", "percent"), allowMissingColumns=True)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--tables", required=True, help="folder with documents.parquet, benchmark.parquet, nation.parquet, region.parquet")
    p.add_argument("--out", required=True, help="folder for results, the index and the checkpoint")
    p.add_argument("--config", help="JSON file with settings in place of those beside this file")
    a = p.parse_args(args)
    spark = session(NAME)
    try:
        run(spark, a.tables, a.out, **config(NAME, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
