"""Writers: kept and rejected reads, sketches, and the tab-separated tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fasta(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def record_text(name: Column, comment: Column, seq: Column, qual: Column | None, force_fasta: bool = False, counts: Column | None = None) -> Column:
    """A read as FASTQ if it has qualities, else (or if forced) as FASTA; counts go between name and comment."""
    detail = F.when(F.size(counts) > 0, F.concat(F.lit(" cnt:"), F.array_join(F.transform(counts, lambda x: x.cast("string")), ";"))).otherwise(F.lit("")) if counts is not None else F.lit("")
    head = F.concat(name, detail, F.when(F.length(comment) > 0, F.concat(F.lit(" "), comment)).otherwise(F.lit("")))
    fasta = _fasta(head, seq)
    if qual is None or force_fasta:
        return fasta
    return F.when(F.length(qual) > 0, F.concat(F.lit("@"), head, F.lit("\n"), seq, F.lit("\n+\n"), qual)).otherwise(fasta)


def write_reads(judged: DataFrame, path: str, rejected: bool = False, gzip: bool = False, force_fasta: bool = False, detail: bool = False) -> None:
    """Kept (or, always as FASTA, rejected) reads of judged (file_nr, ord, kept, name, comment, seq, qual[, counts]) in order.

    A folder for each input file and mate, `file_nr=N/mate=M`: of pairs (columns name2, comment2,
    seq2, qual2[, counts2]) the second mates go to mate=2, in the order of the first.
    """
    rows = judged.where(~F.col("kept") if rejected else F.col("kept"))

    def text(mate: str) -> Column:
        names = [f"{c}{mate}" for c in ("name", "comment", "seq", "qual")]
        cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in names]
        return record_text(F.coalesce(cols[0], F.lit("")), *cols[1:], force_fasta or rejected, F.col(f"counts{mate}") if detail else None)

    mates = [F.struct(F.lit(1).alias("mate"), text("").alias("value"))]
    if "seq2" in rows.columns:
        mates.append(F.when(F.col("seq2").isNotNull(), F.struct(F.lit(2).alias("mate"), text("2").alias("value"))))
    rows = rows.select("file_nr", "ord", F.explode(F.array(*mates)).alias("x")).where("x is not null").select("file_nr", "x.mate", "ord", "x.value")
    rows = rows.repartitionByRange("file_nr", "mate", "ord").sortWithinPartitions("file_nr", "mate", "ord").select("file_nr", "mate", "value")
    rows.write.mode("overwrite").partitionBy("file_nr", "mate").option("compression", "gzip" if gzip else "none").text(f"{path}_{'rej' if rejected else 'keep'}")


def write_sketch(cells: DataFrame, path: str) -> None:
    """The sketch of `normalize_all` (run_id, row, part, cells), or a relational one (row, cell, cnt)."""
    cells.write.mode("overwrite").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def _moved(spark: SparkSession, folder: str, target: str, gzip: bool = False) -> None:
    """The one part file of a written folder, if there is one, under a name of its own; else an empty file."""
    (part, fs), (to, _) = _hadoop(spark, folder), _hadoop(spark, target)
    found = [x.getPath() for x in fs.listStatus(part) if x.getPath().getName().startswith("part-")] if fs.exists(part) else []
    if len(found) > 1:
        raise ValueError(f"rows of {target} lie in several partitions")
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    fs.delete(to, False)
    if found:
        fs.rename(found[0], to)
    elif gzip:
        spark.sparkContext._jvm.java.util.zip.GZIPOutputStream(fs.create(to)).close()
    else:
        fs.create(to).close()
    if to.getParent() is not None and fs.getScheme() == "file":  # checksums of a local file would forbid to edit it
        fs.getRawFileSystem().delete(_hadoop(spark, f"{to.getParent().toString()}/.{to.getName()}.crc")[0], False)


def write_file(lines: DataFrame, path: str) -> None:
    """A DataFrame of one text column, in its order, as one file of exactly this name; for tables of summaries and logs."""
    spark, at = lines.sparkSession, f"{path}-writing-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(at)
    _moved(spark, at, path)
    top, fs = _hadoop(spark, at)
    fs.delete(top, True)


def write_files(rows: DataFrame, folder: str, paths: list[str], order: list[str] | None = None, gzip: bool = False) -> None:
    """rows (path, value, ...) in order as a text file for each path, which must be one of paths; those without rows become empty. Files of that name are replaced."""
    spark, at = rows.sparkSession, f"{folder}/_writing-{uuid.uuid4().hex}"
    if not paths:
        return
    numbers = spark.createDataFrame(list(enumerate(paths)), "nr int, path string")
    numbered = rows.join(F.broadcast(numbers), "path").repartition("nr").sortWithinPartitions("nr", *(order or []))
    numbered.select("nr", "value").write.partitionBy("nr").option("compression", "gzip" if gzip else "none").text(at)
    for i, path in enumerate(paths):
        _moved(spark, f"{at}/nr={i}", path, gzip)
    top, fs = _hadoop(spark, at)
    fs.delete(top, True)


def tsv(cols: list[Column]) -> Column:
    """Tab-separated text of the columns; nulls are empty."""
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))


def write_tsv(df: DataFrame, path: str, header: bool = True, order: list[str] | None = None) -> None:
    """One file of that name, sorted by `order` (all columns, if not given); for tables of summaries."""
    by = [f"_{i}" for i in range(len(order or df.columns))]
    rows = df.select(F.lit(1).alias("_o"), *(F.col(c).alias(n) for c, n in zip(order or df.columns, by, strict=True)), tsv([F.col(c) for c in df.columns]).alias("value"))
    if header:
        none = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in by]
        rows = df.sparkSession.range(1).select(F.lit(0).alias("_o"), *none, F.lit("\t".join(df.columns)).alias("value")).unionByName(rows)
    write_file(rows.coalesce(1).sortWithinPartitions("_o", *by).select("value"), path)


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, as text, without group marks."""
    return F.format_string(f"%.{places}f", value.cast("double"))


# The labels of the printed statistics, which `tables.statistics_columns` and other readers look for
def statistics_text(k: int | Column, max_n: int | Column, seconds: Column | None = None) -> Column:
    """The printed statistics of a run, from the columns of `run_statistics`; `tables.read_statistics` reads them back."""
    k, max_n = (x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in (k, max_n))
    c = lambda name: F.col(name).cast("string")
    total = lambda end: (F.col(f"unpaired_{end}") + F.col(f"paired_{end}")).cast("string")
    block = lambda title, end: [F.lit(f"{title}:\n\tunpaired: "), c(f"unpaired_{end}"), F.lit("\n\tpaired  : "), c(f"paired_{end}"), F.lit("\n\t----------\n\ttotal   : "), total(end), F.lit("\n\n")]
    parts = [*block("Reads processed", "in"), F.lit("Reads shorter than k ("), k, F.lit("): "), c("too_short")]
    parts += [F.when(max_n.cast("int") >= 0, F.concat(F.lit("\nReads containing more than "), max_n, F.lit(" Ns: "), c("too_many_n"))).otherwise("")]
    parts += [F.lit("\nK-mers containing N: "), c("kmers_with_n"), F.lit("\nK-mers processed: "), c("kmers"), F.lit(" (at least "), c("new_kmers"), F.lit(" different)\n"), *block("Reads accepted", "out")]
    parts += [F.lit("n_occupied:\t"), c("n_occupied"), F.lit("\nhist 0:\t"), (F.col("total_cells") - F.col("n_occupied")).cast("string"), F.lit("\nSum over all counters: "), c("counter_sum")]
    parts += [F.lit("\nfp:\t"), fixed(F.col("fp"), 3), F.lit(" (base: "), fixed(F.col("base"), 3), F.lit(")\nreads kept: "), fixed(F.col("reads_kept_pct"), 2), F.lit(" %\n")]
    return F.concat(*parts, *([F.lit("time needed: "), fixed(seconds, 0), F.lit(" s\n")] if seconds is not None else []))


def histogram_rows(stats: DataFrame) -> DataFrame:
    """(run_id, cnt, cells) of a run's counter histogram, without empty entries."""
    return stats.select("run_id", F.posexplode("histogram").alias("cnt", "cells")).where("cells > 0")


# The names of metrics and columns in the written tables
_METRICS = [("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("AUPR", "aupr")]


def metrics_rows(m: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the lines of a table Metric, Genus, Species for each key, from rows (keys, level, precision, recall, f1, aupr, total_reads), in one partition for each key."""
    of = lambda c, level: F.max(F.when(F.col("level") == level, F.col(c)))
    wide = m.groupBy(*keys).agg(*(F.coalesce(of(c, level), F.lit(0.0)).alias(f"{c}_{level}") for _, c in _METRICS for level in ("genus", "species")), F.max("total_reads").cast("bigint").cast("string").alias("n"))
    line = lambda name, a, b: F.concat_ws("\t", F.lit(name), a, b)
    lines = [line("Metric", F.lit("Genus"), F.lit("Species")), *(line(n, fixed(F.col(f"{c}_genus"), 4), fixed(F.col(f"{c}_species"), 4)) for n, c in _METRICS), line("Total_Reads", F.col("n"), F.col("n"))]
    return wide.select(*keys, F.array_join(F.array(*lines), "\n").alias("value"))


def summary_rows(s: DataFrame) -> DataFrame:
    """`evaluate.summary` with the columns and places of the written benchmark summary."""
    names = [(f"{level}_{c}", f"{level.capitalize()}_{n}") for level in ("genus", "species") for n, c in _METRICS]
    return s.select(F.col("tool").alias("Tool"), F.col("n_datasets").alias("N_Datasets"), *(fixed(F.col(f"{c}_{x}"), 4).alias(f"{n}_{x.capitalize()}") for c, n in names for x in ("mean", "std")))


def sweep_rows(s: DataFrame) -> DataFrame:
    """Sweep results with the places of the written summary."""
    return s.select("dataset", "param_set", "reads_processed", "reads_accepted", fixed(F.col("reads_kept_pct"), 2).alias("reads_kept_pct"), fixed(F.col("fp"), 3).alias("fp"), fixed(F.bround("runtime_s", 0), 0).alias("runtime_s"))


def runtime_rows(r: DataFrame) -> DataFrame:
    """(dataset, runtime_s) in whole seconds, halves to the even one."""
    return r.select("dataset", fixed(F.bround("runtime_s", 0), 0).alias("runtime_s"))
