"""k-mer classification: a k-mer to taxon table, best root-to-leaf path for each read, and the tree report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readmill.functions import sequences as S
from readmill.storage import materialized

from . import kmers as K
from .minimizers import Index, looked_up


def closure(taxonomy: DataFrame) -> DataFrame:
    """(taxid, ancestor, up): every taxon with itself (0) and its ancestors.

    Paths double in length with each round, so there are as many rounds as the depth's logarithm.
    """
    parent = F.when(F.col("parent") != F.col("taxid"), F.col("parent"))
    paths = materialized(taxonomy.select("taxid", F.array("taxid").alias("path"), parent.alias("next")))
    for _ in range(32):
        if paths.where("next is not null").isEmpty():
            break
        further = paths.select(F.col("taxid").alias("next"), F.col("path").alias("more"), F.col("next").alias("then"))
        paths = materialized(paths.join(further, "next", "left").select("taxid", F.concat("path", F.coalesce("more", F.array().cast("array<bigint>"))).alias("path"), F.col("then").alias("next")))
    else:
        raise ValueError("a taxon is its own ancestor")
    return materialized(paths.select("taxid", F.posexplode("path").alias("up", "ancestor")).select("taxid", "ancestor", "up"))


def preorder_parents(report: DataFrame, keys: list[str]) -> DataFrame:
    """report (keys, line, depth, taxid) in pre-order with `parent`: the last line before it at one depth less."""
    rows = report.select("*", F.explode(F.array(F.struct(F.col("depth").alias("_level"), F.lit(0).alias("_asks")), F.struct((F.col("depth") - 1).alias("_level"), F.lit(1).alias("_asks")))).alias("_x")).select("*", "_x.*").drop("_x")
    w = Window.partitionBy(*keys, "_level").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("parent", F.last(F.when(F.col("_asks") == 0, F.col("taxid")), ignorenulls=True).over(w)).where("_asks = 1").drop("_asks", "_level")


def _coded(reads: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """k-mers without N of reads (keys, seq[, seq2]); a pair's second mate comes behind the first."""
    rows = K.kmer_rows(reads, k, keys=keys, coded=k <= 31)
    if "seq2" in reads.columns:
        second = K.kmer_rows(reads.where("seq2 is not null"), k, seq="seq2", keys=keys, coded=k <= 31)
        rows = rows.unionByName(second.withColumn("pos", F.col("pos") + (1 << 30)))
    return rows.where(~F.col("has_n"))


def kmer_taxa(references: DataFrame, taxonomy: DataFrame, k: int, up: DataFrame | None = None) -> DataFrame:
    """(canon, taxid): each k-mer's lowest common ancestor over the references (taxid, seq) that hold it; canon as in `kmers.kmer_rows`, coded up to k = 31."""
    rows = _coded(references, k, ("taxid",)).select("canon", "taxid").distinct()
    up = closure(taxonomy) if up is None else up
    one = rows.groupBy("canon").agg(F.count(F.lit(1)).alias("n"), F.min("taxid").alias("taxid"))
    # most k-mers belong to one taxon, which is its own ancestor; only the others go through the tree
    several = rows.join(one.where("n > 1").select("canon", "n"), "canon")
    shared = several.join(up, "taxid").groupBy("canon", "ancestor", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n")
    depth = up.groupBy("taxid").agg(F.max("up").alias("depth")).withColumnRenamed("taxid", "ancestor")
    common = shared.join(depth, "ancestor").groupBy("canon").agg(F.max_by("ancestor", F.struct(F.col("depth"), -F.col("ancestor"))).alias("taxid"))
    alone = one.where("n = 1").select("canon", "taxid").join(up.where("up = 0").select("taxid"), "taxid", "left_semi")
    return alone.select("canon", "taxid").unionByName(common)


def classify(reads: DataFrame, table: DataFrame, taxonomy: DataFrame, k: int, quick_hits: int = 0, up: DataFrame | None = None, few: int = 1_000_000) -> DataFrame:
    """(read_id, taxid, hits) for every read (read_id, seq[, seq2]); taxid 0 where no k-mer is known.

    A table of at most `few` k-mers (16 bytes each) goes to every task; a larger one is joined by a
    shuffle on the k-mer. quick_hits > 0: only the first hits of a read count.
    """
    return _calls(reads, _hits(_known(reads, table, k, few), quick_hits), closure(taxonomy) if up is None else up)


def _known(reads: DataFrame, table: DataFrame, k: int, few: int = 1_000_000) -> DataFrame:
    """k-mers of reads that the table has, with its columns; a table of at most `few` goes to every task, where they are looked up."""
    if table.limit(few + 1).count() > few:
        return _coded(reads, k, ("read_id",)).join(table, "canon")
    if k > 31:
        return _coded(reads, k, ("read_id",)).join(F.broadcast(table), "canon")
    rows = looked_up(reads, table, k)
    if "seq2" in reads.columns:
        rows = rows.unionByName(looked_up(reads.where("seq2 is not null"), table, k, seq="seq2").withColumn("pos", F.col("pos") + (1 << 30)))
    return rows


def classify_by_index(reads: DataFrame, index: Index, taxonomy: DataFrame, quick_hits: int = 0, up: DataFrame | None = None) -> DataFrame:
    """The same, with a table in buckets of minimizers (`minimizers.Index`), of any size, which isn't shuffled."""
    each = reads.select("read_id", F.lit(0).alias("mate"), "seq")
    if "seq2" in reads.columns:
        each = each.unionByName(reads.where("seq2 is not null").select("read_id", F.lit(1).alias("mate"), F.col("seq2").alias("seq")))
    with index.opened() as table:
        rows = index.matched(each, ("read_id", "mate"), table)
        hits = _hits(rows.withColumn("pos", F.col("pos") + F.col("mate") * (1 << 30)), quick_hits)
    return _calls(reads, hits, closure(taxonomy) if up is None else up)


def _hits(rows: DataFrame, quick_hits: int) -> DataFrame:
    """(read_id, taxid, hits) of known k-mers (read_id, pos, taxid)."""
    if quick_hits:
        w = Window.partitionBy("read_id").orderBy("pos")
        rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quick_hits)
    return materialized(rows.groupBy("read_id", "taxid").agg(F.count(F.lit(1)).alias("hits")))


def _calls(reads: DataFrame, hits: DataFrame, up: DataFrame) -> DataFrame:
    """(read_id, taxid, hits): for each read the taxon whose path to the root has most hits."""
    path = hits.select("read_id", "taxid").join(up, "taxid").join(hits.select("read_id", F.col("taxid").alias("ancestor"), "hits"), ["read_id", "ancestor"])
    scores = path.groupBy("read_id", "taxid").agg(F.sum("hits").alias("hits"))
    best = scores.withColumn("_m", F.max("hits").over(Window.partitionBy("read_id"))).where("hits = _m")
    n = best.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.max("hits").alias("hits"), F.min("taxid").alias("taxid"))
    # one best taxon is the answer; ties go to their lowest common ancestor
    tied = best.select("read_id", "taxid").join(n.where("n > 1").select("read_id", "n", F.col("hits").alias("h")), "read_id")
    depth = up.groupBy("taxid").agg(F.max("up").alias("depth")).withColumnRenamed("taxid", "ancestor")
    lca = tied.join(up, "taxid").groupBy("read_id", "ancestor", "n", "h").agg(F.count(F.lit(1)).alias("c")).where("c = n").join(depth, "ancestor")
    lca = lca.groupBy("read_id").agg(F.max_by("ancestor", F.struct(F.col("depth"), -F.col("ancestor"))).alias("taxid"), F.max("h").alias("hits"))
    found = n.where("n = 1").select("read_id", "taxid", "hits").unionByName(lca)
    return reads.select("read_id").join(found, "read_id", "left").select("read_id", F.coalesce("taxid", F.lit(0)).alias("taxid"), F.coalesce("hits", F.lit(0)).alias("hits"))


def clade_kmers(reads: DataFrame, calls: DataFrame, table: DataFrame, k: int, up: DataFrame, exact: bool = False, lg_k: int = 14) -> DataFrame:
    """(taxid, kmers, dup, cov) of each clade whose k-mers occur in classified reads.

    kmers are the distinct known k-mers of the clade, dup their occurrences for each, and cov their
    share of all k-mers that the table has of the clade. Each taxon's k-mers become a HyperLogLog
    sketch where they are, and the sketches are united up the tree: kmers is right within 1 % (a
    standard error of 0.65 % for lg_k = 14), and a taxon's k-mers are never gathered. exact counts them
    by a shuffle of (clade, k-mer) instead.
    """
    rows = _known(reads, table, k).join(calls.where("taxid > 0").select("read_id"), "read_id", "left_semi").select("taxid", "canon")
    climb = lambda x: x.join(up.select("taxid", "ancestor"), "taxid").drop("taxid").withColumnRenamed("ancestor", "taxid")
    genome = climb(table.groupBy("taxid").agg(F.count(F.lit(1)).alias("n"))).groupBy("taxid").agg(F.sum("n").alias("genome"))
    if exact:
        each = climb(rows.groupBy("taxid", "canon").agg(F.count(F.lit(1)).alias("n"))).groupBy("taxid", "canon").agg(F.sum("n").alias("n"))
        found = each.groupBy("taxid").agg(F.count(F.lit(1)).alias("kmers"), F.sum("n").alias("n"))
    else:
        own = rows.groupBy("taxid").agg(F.hll_sketch_agg("canon", lg_k).alias("s"), F.count(F.lit(1)).alias("n"))
        found = climb(own).groupBy("taxid").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("kmers"), F.sum("n").alias("n"))
    share = F.least(F.col("kmers") / F.col("genome"), F.lit(1.0))  # an estimate may be above the whole
    return found.join(genome, "taxid").select("taxid", "kmers", (F.col("n") / F.col("kmers")).alias("dup"), share.alias("cov"))


def report(calls: DataFrame, kmers: DataFrame, taxonomy: DataFrame, up: DataFrame) -> DataFrame:
    """(order, depth, percent, reads, tax_reads, kmers, dup, cov, taxid, rank, name) of all taxa with reads, in pre-order: children of a taxon by id.

    kmers (taxid, kmers, dup, cov) are those of clades; a taxon without any has 0, 0 and null.
    """
    direct = calls.groupBy("taxid").agg(F.count(F.lit(1)).alias("tax_reads"))
    rows = rollup(direct, taxonomy, up=up)
    way = up.groupBy("taxid").agg(F.transform(F.sort_array(F.collect_list(F.struct("up", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("order"))  # as long as the tree is deep
    named = rows.join(taxonomy.select("taxid", "rank", "name"), "taxid", "left").join(way, "taxid", "left").join(kmers, "taxid", "left")
    none = F.col("taxid") == 0
    return named.select(F.coalesce("order", F.array(F.lit(-1).cast("bigint"))).alias("order"), F.coalesce(F.size("order") - 1, F.lit(0)).alias("depth"), "percent", "reads", "tax_reads", F.coalesce("kmers", F.lit(0)).alias("kmers"), F.coalesce("dup", F.lit(0.0)).alias("dup"), "cov", "taxid", F.when(none, "no rank").otherwise(F.coalesce("rank", F.lit("no rank"))).alias("rank"), F.when(none, "unclassified").otherwise(F.coalesce("name", F.lit(""))).alias("name"))


# Fixed value: the columns of a written report
REPORT_COLUMNS = ["%", "reads", "taxReads", "kmers", "dup", "cov", "taxID", "rank", "taxName"]


def report_lines(r: DataFrame) -> DataFrame:
    """A report as the text lines of its file, one partition in order; names are indented by their depth."""
    name = F.concat(F.repeat(F.lit("  "), F.col("depth")), "name")
    number = lambda c, places: F.format_string(f"%.{places}g", F.col(c))
    text = F.concat_ws("\t", number("percent", 4), *(F.col(c).cast("string") for c in ("reads", "tax_reads", "kmers")), number("dup", 3), F.when(F.col("cov").isNotNull(), number("cov", 4)).otherwise("NA"), F.col("taxid").cast("string"), "rank", name)
    head = r.sparkSession.range(1).select(F.array(F.lit(-2).cast("bigint")).alias("order"), F.lit("\t".join(REPORT_COLUMNS)).alias("value"))
    return head.unionByName(r.select("order", text.alias("value"))).coalesce(1).sortWithinPartitions("order").select("value")


def rollup(direct: DataFrame, taxonomy: DataFrame, value: str = "tax_reads", up: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """([keys, ]taxid, value, reads, percent): clade sums over ([keys, ]taxid, value); percent of all (of a key), unclassified (0) included."""
    up, keys = closure(taxonomy) if up is None else up, keys or []
    clade = direct.join(up, "taxid").groupBy(*keys, "ancestor").agg(F.sum(value).alias("reads")).withColumnRenamed("ancestor", "taxid")
    own = direct.groupBy(*keys, "taxid").agg(F.sum(value).alias(value))
    rows = clade.join(own, [*keys, "taxid"], "left").unionByName(own.where("taxid = 0").withColumn("reads", F.col(value)))
    total = direct.groupBy(*keys).agg(F.sum(value).alias("_t"))
    rows = rows.join(total, keys) if keys else rows.join(F.broadcast(total))
    return rows.select(*keys, "taxid", F.coalesce(value, F.lit(0)).alias(value), "reads", (100 * F.col("reads") / F.col("_t")).alias("percent"))


def extract_ranks(report: DataFrame, ranks: list[str]) -> DataFrame:
    """Rows of exactly these ranks with reads of their own."""
    return report.where(F.col("rank").isin(*ranks) & (F.col("tax_reads") > 0))


def to_predictions(report: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, taxid, fraction, abundance, rank, name) at genus and species."""
    x = extract_ranks(report, ["genus", "species"]).join(totals, keys)
    return x.select(*keys, F.col("rank").alias("level"), "taxid", S.safe_ratio(F.col("tax_reads"), F.col("total_reads")).alias("fraction"), F.col("tax_reads").cast("double").alias("abundance"), "rank", "name")
