"""Read files: FASTA and FASTQ, plain or gzip, single or in pairs.

Lines come from Spark's text reader, so any store that Spark reads will do. A file is parsed as one
stream in constant memory; files are parsed in parallel. FASTA that is large and not compressed can
be split within files, as its records can be told apart by line ends alone, and so can FASTQ whose
records have four lines each, once the lines of its splits are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readmill.functions import sequences as S
from readmill.operators.reads import zip_mates

_READ = "path string, ord long, name string, comment string, seq string, qual string"


def _files(spark: SparkSession, path: str) -> list:
    """The status of each file that a path, pattern or folder stands for, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = p.getFileSystem(conf), []
    for found in fs.globStatus(p) or []:
        out += [x for x in fs.listStatus(found.getPath()) if x.isFile() and x.getPath().getName()[:1] not in "._"] if found.isDirectory() else [found]
    return sorted(out, key=lambda x: x.getPath().toString())


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that are there, in order, without duplicates; patterns and folders are left to the reader."""
    return [p for p in dict.fromkeys(paths) if _files(spark, p)]


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files that a path stands for; 0 where there is none."""
    return sum(x.getLen() for x in _files(spark, path))


def _numbered(spark: SparkSession, paths: list[str], missing_ok: bool) -> DataFrame | None:
    """(uri, file_nr, path) of all files in the order of paths and, in folders and patterns, of names; a file named twice counts once."""
    there = existing(spark, paths)
    if gone := [p for p in paths if p not in there]:
        if not missing_ok:
            raise FileNotFoundError(", ".join(gone))
    files = dict.fromkeys((x.getPath().toUri().toString(), x.getPath().toString()) for p in there for x in _files(spark, p))
    return spark.createDataFrame([(_local(u), i, p) for i, (u, p) in enumerate(files)], "uri string, file_nr int, path string") if files else None


def _local(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def _of_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (uri, ...) with file_nr and path; files has a row for each file, which the driver has listed."""
    return rows.join(F.broadcast(files), "uri").drop("uri")


def _uri():
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("uri")


_BLANK = r"[ \t\x0b\f\r]"  # ends a name; what follows is the comment


def _head(line: str) -> tuple[str, str, str]:
    """(name, blank, comment) of a record's first line behind its mark."""
    line = line.rstrip("\r")
    at = re.search(_BLANK, line)
    return (line, "", "") if at is None else (line[: at.start()], at.group(), line[at.end() :])


def _name(head: Column) -> Column:
    return F.regexp_extract(head, f"^{_BLANK.replace('[', '[^', 1)}*", 0)


def _comment(head: Column) -> Column:
    return F.regexp_extract(head, f"(?s)^{_BLANK.replace('[', '[^', 1)}*{_BLANK}(.*)$", 1)


def parse(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of FASTA and FASTQ records, mixed and over several lines; qual is null for FASTA.

    A FASTQ record whose quality is of another length than its sequence ends the file, as does
    the end of input within a record.
    """
    line = next(lines, None)
    while line is not None:
        if not line or line[0] not in ">@":
            line = next(lines, None)
            continue
        name, _, comment = _head(line[1:])
        seq = []
        while (line := next(lines, None)) is not None and line[:1] not in (">", "@", "+"):
            seq.append(line.strip())
        bases = "".join(seq)
        if line is None or line[0] != "+":
            yield name, comment, bases, None
            continue
        qual, n = [], 0
        while n < len(bases) and (line := next(lines, None)) is not None:
            qual.append(line.rstrip("\r"))
            n += len(qual[-1])
        if n != len(bases):
            return
        yield name, comment, bases, "".join(qual)
        line = next(lines, None)


def read_fastx(spark: SparkSession, paths: list[str], missing_ok: bool = False, four_lines: bool = False) -> DataFrame:
    """(file_nr, path, ord, name, comment, seq, qual): records in the order of files and within them.

    Folders and patterns stand for their files by name; each file has a number of its own. With
    four_lines all files are FASTQ with four lines a record, and are split within files.
    """
    files = _numbered(spark, paths, missing_ok)
    if files is None:
        return spark.createDataFrame([], "file_nr int, " + _READ)
    lines = spark.read.text([r.path for r in files.select("path").collect()])
    lines = lines.select("value", _uri(), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    if four_lines:
        return _of_file(_four_lines(lines), files).select("file_nr", *(x.split()[0] for x in _READ.split(", ")))
    lines = lines.repartition("uri").sortWithinPartitions("uri", "at", "n").select(F.col("uri").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True)

        it = rows()
        held = [next(it, None)]
        while held[0] is not None:
            path = held[0][0]

            def own():
                while held[0] is not None and held[0][0] == path:
                    value = held[0][1]
                    held[0] = next(it, None)
                    yield value

            source, out, n = own(), [], 0
            for record in parse(source):
                out.append((path, n, *record))
                n += 1
                if len(out) == 5000:
                    yield _batch(out)
                    out = []
            for _ in source:  # what follows a broken record
                pass
            yield _batch(out)

    found = lines.mapInArrow(run, _READ).withColumnRenamed("path", "uri")
    return _of_file(found, files).select("file_nr", *(x.split()[0] for x in _READ.split(", ")))


def _four_lines(lines: DataFrame) -> DataFrame:
    """Records of four lines each: the lines of each split are counted, then each line has its number in the file."""
    splits = lines.groupBy("uri", "at").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n0"))  # a row for each split
    before = Window.partitionBy("uri").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("uri", "at", "n0", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    line = F.col("base") + F.col("n") - F.col("n0")
    rows = lines.join(splits, ["uri", "at"]).select("uri", F.floor(line / 4).alias("ord"), (line % 4).alias("i"), F.rtrim("value").alias("value"))
    of = lambda i: F.max(F.when(F.col("i") == i, F.col("value")))
    r = rows.groupBy("uri", "ord").agg(*(of(i).alias(c) for i, c in enumerate(("head", "seq", "plus", "qual"))))
    r = r.where("head <> '' or seq <> ''")  # blank lines at the end
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    head = F.when(F.coalesce(good, F.lit(False)), F.substring("head", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("not a record of four lines: "), F.coalesce("head", F.lit("")))))
    return r.withColumn("head", head).select("uri", "ord", _name(F.col("head")).alias("name"), _comment(F.col("head")).alias("comment"), "seq", "qual")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], [f.split()[0] for f in _READ.split(", ")])


def read_fasta_split(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, at, name, comment, seq) of large plain FASTA files, split within files; `at` orders records."""
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.regexp_replace("value", "^>", "").alias("r"))
    head, body = F.regexp_replace(F.substring_index("r", "\n", 1), "\r+$", ""), F.regexp_replace("r", "^[^\n]*\n?", "")
    return rows.select("path", "at", _name(head).alias("name"), _comment(head).alias("comment"), F.regexp_replace(body, r"\s", "").alias("seq"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two lists of files in lockstep, with the first one's path; the shorter file of a pair ends it."""
    both = zip_mates(first, second.drop("path"), ["file_nr", "ord"])
    return both.withColumnsRenamed({f"{c}1": c for c in ("path", "name", "comment", "seq", "qual")})


def clipped(reads: DataFrame, max_len: int = S.MAX_LEN) -> DataFrame:
    """Sequences and qualities cut at max_len, names at 49 and comments at 199 characters."""
    cut = {"seq": max_len, "qual": max_len, "seq2": max_len, "qual2": max_len, "name": S.MAX_NAME, "name2": S.MAX_NAME, "comment": S.MAX_COMMENT, "comment2": S.MAX_COMMENT}
    return reads.withColumns({c: F.substring(c, 1, n) for c, n in cut.items() if c in reads.columns})


def count_reads(spark: SparkSession, path: str) -> int:
    """Records of a file: lines / 4 in FASTQ, lines that start with > in FASTA, told apart by the name's ending, else by the first character; 0 where it can't be read."""
    try:
        lines = spark.read.text(path)
        first = lines.first()
    except PySparkException as e:  # not there, or not readable
        print(f"could not count reads in {path}: {e.getCondition()}")
        return 0
    if first is None:
        return 0
    fastq = re.search(r"\.(fq|fastq)(\.gz)?$", path) or not re.search(r"\.(fa|fasta)(\.gz)?$", path) and first.value.startswith("@")
    return lines.count() // 4 if fastq else lines.where(F.col("value").startswith(">")).count()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size) of a folder's files by name; contents aren't read. An empty or missing folder gives none."""
    files = [(x.getPath().toString(), x.getPath().getName(), x.getLen()) for x in _files(spark, path)]
    return spark.createDataFrame(files, "path string, name string, size long")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in a folder, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().toString() for x in p.getFileSystem(conf).listStatus(p) if x.isDirectory() and not x.getPath().getName().startswith("."))


def plain_path(path: str) -> str:
    """A file's URI or path in one form, to compare them."""
    return _local(path)


def plain_column(column: str):
    """The same for a column of URIs as `_metadata.file_path` has them."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(column, r"\+", "%2B")), "^file:/+", "file:/")
