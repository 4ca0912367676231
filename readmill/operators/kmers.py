"""k-mer tables, document frequencies, count histograms and relational sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions import sequences as S


PIECE = 128  # windows cut from one part of a read


def _pieces(reads: DataFrame, k: int, seq: str, qual: str | None, keys: tuple[str, ...]) -> DataFrame:
    """(keys, at, s[, q]): consecutive parts of each sequence, upper case and N for other letters, with the k - 1 bases that follow; `at` is where a part begins."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cols = {"s": S.clean_bases(F.col(seq))} | ({"q": F.coalesce(F.col(qual), F.lit(""))} if qual else {})
    parts = reads.select(*keys, *(cut(v).alias(f"_{c}") for c, v in cols.items()))
    # a part and the one behind it side by side, so that no part is cut again for its neighbour
    beside = [x for c in cols for x in (F.col(f"_{c}"), F.concat(F.slice(f"_{c}", 2, F.greatest(F.size(f"_{c}"), F.lit(1))), F.array(F.lit(""))))]
    names = [x for c in cols for x in (c, f"{c}_next")]
    rows = parts.select(*keys, F.posexplode(F.arrays_zip(*(x.alias(n) for x, n in zip(beside, names, strict=True)))).alias("_i", "_x")).where(F.col("_x")["s"].isNotNull())
    return rows.select(*keys, (F.col("_i") * PIECE).alias("at"), *(F.concat(F.col("_x")[c], F.left(F.coalesce(F.col("_x")[f"{c}_next"], F.lit("")), F.lit(k - 1))).alias(c) for c in cols))


def kmer_rows(reads: DataFrame, k: int, seq: str = "seq", qual: str | None = None, keys: tuple[str, ...] = ("read_id",), coded: bool = False) -> DataFrame:
    """(keys, pos, canon, has_n[, min_qual]): a row for each k-mer of each read, letters but A, C, G, T (in either case) as N.

    Strands are turned once for a part of a read, not for each k-mer. k is at most PIECE. coded:
    canon is a number (see `code`), which shuffles and joins faster; k is at most 31. A k-mer
    without qualities of its own has a min_qual above all.
    """
    one = F.translate("s", "N", "A")
    digits = (lambda c: F.translate(c, "ACGT", "0123")) if coded else lambda c: c  # the order is the same
    # bytes, as a window of a string is found by walking through its characters
    cols = {"f": digits(one), "r": digits(S.reverse_complement(one)), "s": F.col("s")} | ({"q": F.col("q")} if qual else {})
    parts = _pieces(reads, k, seq, qual, keys).select(*keys, "at", F.length("s").alias("n"), S.has_n(F.col("s")).alias("any_n"), *(c.cast("binary").alias(x) for x, c in cols.items()))
    i, n = F.col("i"), F.col("n")
    many = F.least(n - k + 1, F.lit(PIECE))  # n isn't null, as least would pass it over
    rows = parts.select("*", F.explode(F.when(many > 0, F.sequence(F.lit(1), many))).alias("i"))
    window = lambda c, at: F.substring(c, at, F.lit(k))
    canon = F.greatest(window("f", i), window("r", n - k - i + 2)).cast("string")
    cols = [(F.col("at") + i - 1).alias("pos"), (number(canon, k) if coded else canon).alias("canon"), (F.col("any_n") & S.has_n(window("s", i).cast("string"))).alias("has_n")]
    if qual:
        cols.append(F.when(F.length(window("q", i)) == k, S.least_quality(window("q", i).cast("string"))).otherwise(F.lit(1 << 20)).alias("min_qual"))
    return rows.select(*keys, *cols)


def number(digits: Column, k: int) -> Column:
    """k digits 0 to 3 as one number: read as decimal while that fits, else to the base of 4."""
    return digits.cast("bigint") if k <= 18 else F.conv(digits, 4, 10).cast("bigint")


def code(canon: Column, k: int) -> Column:
    """The number of a k-mer in rows that are `coded`."""
    return number(F.translate(canon, "ACGT", "0123"), k)


def decoded(number: Column, k: int) -> Column:
    """The k-mer of such a number."""
    digits = number.cast("string") if k <= 18 else F.conv(number.cast("string"), 10, 4)
    return F.translate(F.lpad(digits, k, "0"), "0123", "ACGT")


def kmer_counts(reads: DataFrame, k: int, seq: str = "seq", key: str = "read_id") -> DataFrame:
    """(canon, n, d): occurrences, and reads that hold the k-mer. Occurrences in a read are summed before the first shuffle, those of a k-mer before the second."""
    rows = kmer_rows(reads, k, seq, keys=(key,), coded=k <= 31).where(~F.col("has_n"))
    found = rows.groupBy("canon", key).agg(F.count(F.lit(1)).alias("n")).groupBy("canon").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    return found.withColumn("canon", decoded(F.col("canon"), k)) if k <= 31 else found


def document_frequency(rows: DataFrame, read: str = "read_id", with_n: bool = False) -> DataFrame:
    """(canon, d): reads in which a k-mer occurs, cut at the counter's limit. A read's k-mers are held at once; the filter's reads are short."""
    rows = rows if with_n else rows.where(~F.col("has_n"))
    sets = rows.groupBy(read).agg(F.collect_list("canon").alias("x")).select(F.explode(F.array_distinct("x")).alias("canon"))
    return sets.groupBy("canon").agg(F.least(F.count(F.lit(1)), F.lit(S.COUNT_MAX)).cast("int").alias("d"))


def is_small(k: int, few: int = 1 << 21) -> bool:
    """Whether a table of all canonical k-mers has at most `few` rows, whatever the input."""
    return 4**k // 2 <= few


def counts_by_read(rows: DataFrame, df: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """(keys, counts[, quals]): the counts of a read's k-mers in order; those not in df are 0. small: df is bounded (`is_small`) and goes to every task, so that rows are shuffled by read only."""
    df = F.broadcast(df) if small else df
    x = [F.col("pos"), F.coalesce("d", F.lit(0)).alias("c"), *([F.col("min_qual")] if "min_qual" in rows.columns else [])]
    found = rows.join(df, "canon", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*x))).alias("x"))
    return found.select(*keys, F.col("x.c").alias("counts"), *([F.col("x.min_qual").alias("quals")] if "min_qual" in rows.columns else []))


def count_histogram(counts: DataFrame, count: str = "d") -> DataFrame:
    return counts.groupBy(F.least(F.col(count), F.lit(S.COUNT_MAX)).cast("int").alias("cnt")).agg(F.count(F.lit(1)).alias("kmers"))


def row_cell(code: Column, row: Column, cells: int) -> Column:
    """Cell of a k-mer code in a row of a relational sketch: a multiply-add modulo a prime, small enough for 64 bits."""
    prime = 2147483647
    return F.pmod(F.pmod(F.pmod(code, F.lit(prime)) * (1103515245 + 12345 * row) % prime + 7919 * (row + 1), F.lit(prime)), F.lit(cells))


def sketch(rows: DataFrame, t: int, cells: int, read: str = "read_id") -> DataFrame:
    """(row, cell, cnt): a count-min sketch as a relation; a read adds one to a cell at most.

    A read's k-mers are held at once (the filter's reads are short), and its cells are made distinct
    there, so that k-mers are shuffled once; sums of cells are made in each task first.
    """
    each = rows.where(~F.col("has_n")).select(read, S.code(F.col("canon")).alias("code"))
    at = lambda c: F.array(*((row_cell(c, F.lit(r), cells) + r * cells).cast("int") for r in range(t)))
    sets = each.groupBy(read).agg(F.collect_list("code").alias("x")).select(F.array_distinct(F.flatten(F.transform("x", at))).alias("c"))
    found = sets.select(F.explode("c").alias("c")).groupBy("c").agg(F.least(F.count(F.lit(1)), F.lit(S.COUNT_MAX)).cast("int").alias("cnt"))
    return found.select(F.floor(F.col("c") / cells).cast("int").alias("row"), (F.col("c") % cells).alias("cell"), "cnt")


def estimates(kmers: DataFrame, table: DataFrame, t: int, cells: int, few: int = 1 << 22) -> DataFrame:
    """(canon, est): the least cell of each distinct k-mer. A table of at most `few` cells goes to every task, so that k-mers are shuffled once."""
    each = kmers.select("canon").distinct()
    at = F.array(*(F.struct(F.lit(r).alias("row"), row_cell(S.code(F.col("canon")), F.lit(r), cells).cast("int").alias("cell")) for r in range(t)))
    each = each.select("canon", F.explode(at).alias("x")).select("canon", "x.row", "x.cell")
    table = F.broadcast(table) if t * cells <= few else table
    return each.join(table, ["row", "cell"], "left").groupBy("canon").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))


def occupancy(table: DataFrame, t: int, cells: int) -> DataFrame:
    """One row: occupied and empty cells, sum of counters, base rate and false-positive rate."""
    one = table.agg(F.count_if(F.col("cnt") > 0).alias("n_occupied"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("counter_sum"))
    base = F.col("n_occupied") / F.lit(t * cells)
    return one.select("n_occupied", (F.lit(t * cells) - F.col("n_occupied")).alias("hist0"), "counter_sum", F.round(base, 6).alias("base"), F.round(F.pow(base, t), 6).alias("fp"))
