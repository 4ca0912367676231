"""Column builders over reads: k-mers, reverse complements, qualities, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEN, MAX_NAME, MAX_COMMENT, COUNT_MAX = 300, 49, 199, 253


def truncated(seq: Column, max_len: int = MAX_LEN) -> Column:
    return F.substring(seq, 1, max_len)


def clean_bases(seq: Column) -> Column:
    """Upper case; anything but A, C, G, T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def count_n(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The larger of a k-mer and its reverse complement, N read as A; string order equals the order of 2-bit codes."""
    kmer = F.translate(kmer, "N", "A")
    return F.greatest(kmer, reverse_complement(kmer))


def windows(seq: Column, k: int) -> Column:
    """All k-mers in order; an empty array for shorter reads."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical_kmers(seq: Column, k: int, first_min: bool = False) -> Column:
    """Canonical k-mers in order. first_min: the first one takes the smaller strand instead (compatibility)."""
    both = F.transform(windows(seq, k), canonical)
    if not first_min:
        return both
    first = F.translate(F.substring(seq, 1, k), "N", "A")
    low = F.least(first, reverse_complement(first))
    return F.transform(both, lambda x, i: F.when(i == 0, low).otherwise(x))


def has_n(kmer: Column) -> Column:
    return F.instr(kmer, "N") > 0


def code(kmer: Column) -> Column:
    """2-bit code of a k-mer of up to 31 bases as BIGINT."""
    return F.conv(F.translate(kmer, "ACGTN", "01230"), 4, 10).cast("bigint")


def decoded(kmer_code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(kmer_code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def least_quality(qual: Column, base: int = 33) -> Column:
    """The least quality of a string of them; characters order as their codes do."""
    return F.ascii(F.array_min(F.split(qual, ""))) - base


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1_score(p: Column, r: Column) -> Column:
    return safe_ratio(2 * p * r, p + r)


def false_positive_rate(occupied: Column, cells: Column, rows: Column | int) -> Column:
    return F.pow(occupied / cells, rows)


def duration_label(seconds: Column) -> Column:
    """`1h, 2m, 3s`; hours and minutes only where there are any."""
    s = F.floor(seconds).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.concat_ws(", ", F.when(h > 0, part(h, "h")), F.when((h > 0) | (m > 0), part(m, "m")), part(s % 60, "s"))


def dataset_name(path: Column) -> Column:
    """A read file's name without folder, format suffixes and mate mark."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.regexp_replace(F.regexp_replace(name, r"\.(fq|fastq|fa|fasta)(\.gz)?$", ""), "_R[12]$", "")


def mate_path(path: Column) -> Column:
    """The second mate's file: the mark in the file name only, not in accessions that hold `R1`."""
    return F.regexp_replace(path, r"_R1(?=[_.][^/]*$)", "_R2")


def tool_name(file_name: Column, dataset: Column) -> Column:
    return F.regexp_replace(F.substring(file_name, F.length(dataset) + 2, F.length(file_name)), r"\.txt$", "")


def param_set_of(folder: Column, prefix: str) -> Column:
    """The parameter set that a result folder's name holds: the prefix and what follows, without the mark of quick runs."""
    return F.replace(F.regexp_extract(folder, prefix + r"(\w+)", 0), F.lit("_quick"), F.lit(""))


def output_folder(tool: str, suffix: Column, quick: Column, preload: Column) -> Column:
    """tool[_suffix][_quick][_preload-size-N]"""
    return F.concat_ws("_", F.lit(tool), F.nullif(suffix, F.lit("")), F.when(quick, F.lit("quick")), F.when(F.length(preload) > 0, F.concat(F.lit("preload-size-"), preload)))


def is_read_file(path: Column) -> Column:
    return path.rlike(r"\.(fq|fastq|fa|fasta)(\.gz)?$")


def is_fastq(path: Column, first_char: Column | None = None) -> Column:
    """By suffix, else by the first character, else FASTQ."""
    return F.when(path.rlike(r"\.(fq|fastq)(\.gz)?$"), True).when(path.rlike(r"\.(fa|fasta)(\.gz)?$"), False).otherwise(F.coalesce(first_char == "@", F.lit(True)) if first_char is not None else F.lit(True))


# How letters of a text stand for bases
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN"


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def pseudo_bases(text: Column) -> Column:
    """A text's letters a to z (in either case) as bases."""
    return F.translate(letters_only(text), LETTERS, BASES)
