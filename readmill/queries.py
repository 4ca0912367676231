"""Queries over the driver's tables, one for each operator or group of operators, with the same in DuckDB SQL.

`documents` are read as pseudo reads: letters a to z become bases, each with a pseudo quality.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import sequences as S
from readmill.operators import classify as C
from readmill.operators import dense as D
from readmill.operators import evaluate as E
from readmill.operators import kmers as K
from readmill.operators import minimizers as Z
from readmill.operators import reads as R
from readmill.operators import sketches
from readmill.operators.decide import Params
from readmill.operators.normalize import normalize, normalize_batch, run_statistics
from readmill.operators.parallel_filter import normalize_parallel
from readmill.operators.relational import first_by_prefix, last_wins, not_done, upsert
from readmill.plans import sweep as P
from readmill.sources.tables import statistics_columns
from readmill.storage import materialized, scratch

_LETTERS, _BASES = S.LETTERS, S.BASES
_QUALS = "".join(chr(33 + ord(c) % 41) for c in _LETTERS)
K_ = 21

_sql: dict[str, str] = {}
_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _letters(text: str = "text"):
    return S.letters_only(F.col(text))


def letters(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, seq, qual) of all letters of a document."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), _letters().alias("x"))
    return docs.select("read_id", F.translate("x", _LETTERS, _BASES).alias("seq"), F.translate("x", _LETTERS, _QUALS).alias("qual"))


def _parts(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows with `nth`: each cut into consecutive parts of at most 300 letters, together in all cols; without letters, one empty part."""
    most = F.greatest(*(F.coalesce(F.ceil(F.length(c) / S.MAX_LEN), F.lit(0)) for c in cols), F.lit(1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), (most - 1).cast("int"))).alias("nth"))
    # bytes, as a part of a string is found by walking through its characters; letters are one byte each
    return rows.withColumns({c: F.substr(F.col(c).cast("binary"), F.col("nth") * S.MAX_LEN + 1, F.lit(S.MAX_LEN)).cast("string") for c in cols})


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, seq, qual) of every document's letters as reads of at most 300 bases; read_id is (read_id, nth)."""
    r = _parts(letters(spark, d), ["seq", "qual"])
    return r.select(F.struct("read_id", "nth").alias("read_id"), "seq", "qual")


def _mates(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("pair"), "role", F.translate(_letters(), _LETTERS, _BASES).alias("seq"))
    whole = R.zip_mates(c.where("role = 'user'").drop("role"), c.where("role = 'assistant'").drop("role"), ["conv_id", "pair"])
    return _parts(whole, ["seq1", "seq2"])


_LETTERS_SQL = f"""
letters AS (SELECT doc_id AS read_id, lang, translate(x, '{_LETTERS}', '{_BASES}') AS seq, translate(x, '{_LETTERS}', '{_QUALS}') AS qual
  FROM (SELECT doc_id, lang, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM documents))"""
_READS = f"""{_LETTERS_SQL},
reads AS (SELECT read_id, lang, CAST(nth AS INTEGER) AS nth, substring(seq, nth * 300 + 1, 300) AS seq, substring(qual, nth * 300 + 1, 300) AS qual
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(seq) / 300) AS BIGINT)))) AS nth FROM letters))"""


def _kmers_sql(k: int, source: str = "reads", keys: str = "read_id, nth", name: str = "kmers") -> str:
    return f"""
{name}_s AS (SELECT {keys}, i * 300 AS base, substring(seq, i * 300 + 1, {300 + k - 1}) AS s FROM (SELECT {keys}, seq, unnest(range(0, CAST(ceil(length(seq) / 300) AS BIGINT))) AS i FROM {source})),
{name}_w AS (SELECT {keys}, base + p - 1 AS pos, substring(s, p, {k}) AS w FROM (SELECT *, unnest(range(1, least(301, length(s) - {k} + 2))) AS p FROM {name}_s)),
{name} AS (SELECT {keys}, pos, w LIKE '%N%' AS has_n, greatest(translate(w, 'N', 'A'), reverse(translate(translate(w, 'N', 'A'), 'ACGT', 'TGCA'))) AS canon FROM {name}_w)"""


_WHOLE = f"{_LETTERS_SQL}, {_kmers_sql(K_, 'letters', 'read_id')}"


@_query(f"WITH {_WHOLE} SELECT canon, count(*) AS n, count(DISTINCT read_id) AS d FROM kmers WHERE NOT has_n GROUP BY canon")
def kmer_count(spark: SparkSession, d: str) -> DataFrame:
    return Z.kmer_counts(letters(spark, d), K_)


@_query(f"WITH {_WHOLE} SELECT canon, count(*) AS n FROM kmers WHERE NOT has_n GROUP BY canon ORDER BY n DESC, canon LIMIT 100")
def kmer_top(spark: SparkSession, d: str) -> DataFrame:
    top = Z.counted(letters(spark, d), K_).select("canon", "n").orderBy(F.desc("n"), "canon").limit(100)  # codes order as letters do
    return top.select(S.decoded(F.col("canon"), K_).alias("canon"), "n")


@_query(f"""WITH {_READS}, r AS (SELECT seq, CASE WHEN length(seq) < {K_} THEN 'too_short' WHEN length(seq) - length(replace(seq, 'N', '')) > 4 THEN 'too_many_n' END AS why FROM reads)
SELECT count(*) AS reads_in, count(*) FILTER (why = 'too_short') AS too_short, count(*) FILTER (why = 'too_many_n') AS too_many_n, count(*) FILTER (why IS NULL) AS reads_ok,
 CAST(coalesce(sum(CASE WHEN why IS NULL THEN length(seq) - {K_} + 1 ELSE 0 END), 0) AS BIGINT) AS kmers, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bases FROM r""")
def read_qc(spark: SparkSession, d: str) -> DataFrame:
    return R.qc_counters(reads(spark, d), K_, 4)


@_query(f"WITH {_WHOLE}, c AS (SELECT canon, least(count(DISTINCT read_id), 253) AS d FROM kmers WHERE NOT has_n GROUP BY canon) SELECT CAST(d AS INTEGER) AS cnt, count(*) AS kmers FROM c GROUP BY d")
def kmer_hist(spark: SparkSession, d: str) -> DataFrame:
    return K.count_histogram(Z.counted(letters(spark, d), K_))


_CODE_SQL = "CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 13), lambda i: CAST(strpos('ACGT', substring(canon, i, 1)) - 1 AS BIGINT))), lambda a, x: a * 4 + x) AS BIGINT)"
_CELL_SQL = "((((code % 2147483647) * (1103515245 + 12345 * r) % 2147483647 + 7919 * (r + 1)) % 2147483647) % 65536)"
_SKETCH_SQL = f"""WITH {_READS}, {_kmers_sql(12)}, u AS (SELECT DISTINCT read_id, nth, canon FROM kmers WHERE NOT has_n), k AS (SELECT canon, {_CODE_SQL} AS code FROM (SELECT DISTINCT canon FROM u)),
cells AS (SELECT canon, r AS "row", CAST({_CELL_SQL} AS INTEGER) AS cell FROM k, (SELECT unnest(range(0, 4)) AS r)),
sk AS (SELECT "row", cell, least(count(DISTINCT (read_id, nth)), 253) AS cnt FROM u JOIN cells USING (canon) GROUP BY "row", cell)"""


@_query(_SKETCH_SQL + ' SELECT canon, CAST(min(cnt) AS INTEGER) AS est FROM cells JOIN sk USING ("row", cell) GROUP BY canon')
def cms_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sketches.estimates(reads(spark, d), 12, 4, 1 << 16)


@_query(_SKETCH_SQL + " SELECT n_occupied, 262144 - n_occupied AS hist0, counter_sum, round(n_occupied / 262144, 6) AS base, round(pow(n_occupied / 262144, 4), 6) AS fp FROM (SELECT count(*) AS n_occupied, CAST(sum(cnt) AS BIGINT) AS counter_sum FROM sk)")
def sketch_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return K.occupancy(sketches.sketch(reads(spark, d), 12, 4, 1 << 16), 4, 1 << 16)


_D = Params(d=1, k=11, A=3, B=60, C=6, N=10, Q=17)
_DECIDE = f"WITH {_READS}, {_kmers_sql(11)}, df AS (SELECT canon, least(count(DISTINCT (read_id, nth)), 253) AS d FROM kmers WHERE NOT has_n GROUP BY canon), c AS (SELECT read_id, nth, pos, coalesce(d, 0) AS c FROM kmers LEFT JOIN df USING (canon))"
_RARE, _MID = f"count(*) FILTER (c < {_D.A})", f"count(*) FILTER (c >= {_D.A} AND c < {_D.C})"


def _decided(spark: SparkSession, d: str, number: int, qual: bool = False) -> DataFrame:
    """Each row of `documents` by the counts of all; its k-mers are short, so that no k-mer leaves its task."""
    r = reads(spark, d)
    counts = D.table(D.frequencies(r, _D.k), _D.k)
    found = D.judged(r, counts, replace(_D, d=number), ("read_id",), quals=("qual",) if qual else ())
    return found.where("n > 0").select("read_id.*", "kept")


@_query(f"{_DECIDE} SELECT read_id, nth, list_sort(list(c))[CAST(count(*) // 2 AS BIGINT) + 1] <= {_D.C} AS kept FROM c GROUP BY read_id, nth")
def decide_d1(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, 1)


@_query(f"{_DECIDE} SELECT read_id, nth, list_sort(list(c))[CAST(count(*) // 4 AS BIGINT) + 1] <= {_D.C} AS kept FROM c GROUP BY read_id, nth")
def decide_d2(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, 2)


_MATES = f"""
m AS (SELECT conv_id, turn // 2 AS pair, role, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS seq FROM conversations),
whole AS (SELECT u.conv_id, u.pair, u.seq AS seq1, a.seq AS seq2 FROM m u JOIN m a ON u.conv_id = a.conv_id AND u.pair = a.pair AND u.role = 'user' AND a.role = 'assistant'),
mates AS (SELECT conv_id, pair, CAST(nth AS INTEGER) AS nth, substring(seq1, nth * 300 + 1, 300) AS seq1, substring(seq2, nth * 300 + 1, 300) AS seq2
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(seq1) / 300) AS BIGINT), CAST(ceil(length(seq2) / 300) AS BIGINT)))) AS nth FROM whole))"""
_PAIR = "conv_id, pair, nth"
_PAIR_DECIDE = f"""WITH {_MATES}, both_mates AS (SELECT {_PAIR}, 1 AS mate, seq1 AS seq FROM mates UNION ALL SELECT {_PAIR}, 2 AS mate, seq2 AS seq FROM mates),
{_kmers_sql(11, "both_mates", f"{_PAIR}, mate")}, df AS (SELECT canon, least(count(DISTINCT ({_PAIR})), 253) AS d FROM kmers WHERE NOT has_n GROUP BY canon),
c AS (SELECT {_PAIR}, mate, coalesce(d, 0) AS c FROM kmers LEFT JOIN df USING (canon)),
x AS (SELECT {_PAIR}, mate, {_RARE} AS rare, {_MID} AS mid FROM c GROUP BY {_PAIR}, mate)"""


def _pair_decided(spark: SparkSession, d: str, number: int) -> DataFrame:
    pairs = _mates(spark, d).withColumn("read_id", F.struct("conv_id", "pair", "nth"))
    counts = D.table(D.frequencies(pairs, _D.k, ("seq1", "seq2")), _D.k)
    found = D.judged(pairs, counts, replace(_D, d=number), ("read_id",), ("seq1", "seq2"))
    return found.where("n > 0 and n2 > 0").select("read_id.*", "kept")


@_query(f"{_PAIR_DECIDE} SELECT {_PAIR}, bool_and(rare > {_D.k} OR mid > {_D.B}) AS kept FROM x GROUP BY {_PAIR} HAVING count(*) = 2")
def decide_d3_paired(spark: SparkSession, d: str) -> DataFrame:
    return _pair_decided(spark, d, 3)


@_query(f"{_PAIR_DECIDE} SELECT {_PAIR}, bool_or(rare > {_D.k} OR mid > {_D.B}) AS kept FROM x GROUP BY {_PAIR} HAVING count(*) = 2")
def decide_d4_paired(spark: SparkSession, d: str) -> DataFrame:
    return _pair_decided(spark, d, 4)


@_query(f"{_PAIR_DECIDE} SELECT {_PAIR}, sum(rare) > {_D.k} OR sum(mid) > {_D.B} AS kept FROM x GROUP BY {_PAIR} HAVING count(*) = 2")
def decide_d5_paired(spark: SparkSession, d: str) -> DataFrame:
    return _pair_decided(spark, d, 5)


@_query(f"{_DECIDE} SELECT read_id, nth, {_RARE} > {_D.k} OR {_MID} > {_D.B} AS kept FROM c GROUP BY read_id, nth")
def decide_d3(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, 3)


_QUALITY = "q AS (SELECT read_id, nth, p - 1 AS pos, list_min(list_transform(range(p, p + 11), lambda i: ascii(substring(qual, i, 1)) - 33)) AS mq FROM (SELECT read_id, nth, qual, unnest(range(1, length(qual) - 11 + 2)) AS p FROM reads))"
_GOOD_RARE, _GOOD_MID = f"count(*) FILTER (c < {_D.A} AND mq >= {_D.Q})", f"count(*) FILTER (c >= {_D.A} AND c < {_D.C} AND mq >= {_D.Q})"


@_query(f"{_DECIDE}, {_QUALITY} SELECT read_id, nth, {_GOOD_RARE} > {_D.k} OR {_GOOD_MID} > {_D.B} AS kept FROM c JOIN q USING (read_id, nth, pos) GROUP BY read_id, nth")
def decide_d6(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, 6, qual=True)


@_query(f"WITH {_MATES} SELECT {_PAIR}, CAST(length(seq1) AS INTEGER) AS n1, CAST(length(seq2) AS INTEGER) AS n2, CASE WHEN length(seq1) < 21 OR length(seq2) < 21 THEN 'too_short' WHEN length(seq1 || seq2) - length(replace(seq1 || seq2, 'N', '')) > 4 THEN 'too_many_n' END AS reason FROM mates")
def paired_zip(spark: SparkSession, d: str) -> DataFrame:
    return _mates(spark, d).select("conv_id", "pair", "nth", F.length("seq1").alias("n1"), F.length("seq2").alias("n2"), R.reject_reason(F.col("seq1"), 21, 4, F.col("seq2")).alias("reason"))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions: documents of a source at a level, by length, but for those labelled toxic; truth: those of good quality, toxic ones too."""
    docs = _table(spark, d, "documents").select(F.col("source").alias("tool"), F.col("lang").alias("dataset"), F.col("doc_id").alias("taxid"), F.when(F.col("doc_id") % 2 == 0, "genus").otherwise("species").alias("level"), F.floor(F.col("n_chars") / 50).cast("double").alias("abundance"))
    labels = _table(spark, d, "labels").withColumnRenamed("doc_id", "taxid")
    truth = docs.join(labels.where("quality = 1"), "taxid", "left_semi").select("tool", "dataset", "level", "taxid")
    return docs.join(labels.where("toxic = 1"), "taxid", "left_anti"), truth


_SCORED = """docs AS (SELECT source AS tool, lang AS dataset, doc_id AS taxid, CASE WHEN doc_id % 2 = 0 THEN 'genus' ELSE 'species' END AS level, floor(n_chars / 50) AS abundance FROM documents),
truth AS (SELECT DISTINCT tool, dataset, level, taxid FROM docs WHERE taxid IN (SELECT doc_id FROM labels WHERE quality = 1)), pred AS (SELECT * FROM docs WHERE taxid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
size AS (SELECT tool, dataset, level, count(*) AS n_truth FROM truth GROUP BY ALL),
h AS (SELECT pred.*, coalesce(n_truth, 0) AS n_truth, CASE WHEN truth.taxid IS NULL THEN 0 ELSE 1 END AS hit FROM pred LEFT JOIN truth USING (tool, dataset, level, taxid) LEFT JOIN size USING (tool, dataset, level)),
cv AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER w AS tp FROM h WINDOW w AS (PARTITION BY tool, dataset, level ORDER BY abundance DESC, taxid ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / rank AS p, CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 0 END AS r FROM cv), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""


_REPEATED = _SCORED.replace("pred AS (SELECT * FROM docs WHERE taxid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))", "pred AS (SELECT tool, dataset, level, taxid, max(abundance) AS abundance FROM (SELECT * FROM docs WHERE taxid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT tool, dataset, level, taxid, taxid % 100 FROM docs) GROUP BY ALL)")


@_query(f"WITH {_REPEATED}, b AS (SELECT *, row_number() OVER (PARTITION BY tool, dataset, level ORDER BY round(f1, 12) DESC, rank) AS best FROM f) SELECT tool, dataset, level, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(tp AS BIGINT) AS tp, CAST(n_truth - tp AS BIGINT) AS fn FROM b WHERE best = 1")
def metrics_repeated_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every document predicted once more, with another abundance; the larger one counts."""
    pred, truth = _scored(spark, d)
    all_ = _table(spark, d, "documents").select(F.col("source").alias("tool"), F.col("lang").alias("dataset"), F.col("doc_id").alias("taxid"), F.when(F.col("doc_id") % 2 == 0, "genus").otherwise("species").alias("level"), (F.col("doc_id") % 100).cast("double").alias("abundance"))
    b = E.best_f1(E.prefix_curve(pred.unionByName(all_), truth).withColumn("f1", F.round("f1", 12)))
    return b.select(*E.KEYS, *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "tp", "fn")


@_query(f"WITH {_SCORED} SELECT tool, dataset, level, taxid, CAST(rank AS INTEGER) AS rank, CAST(tp AS BIGINT) AS tp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    c = E.prefix_curve(*_scored(spark, d))
    return c.select(*E.KEYS, "taxid", "rank", "tp", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@_query(f"""WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY tool, dataset, level ORDER BY round(f1, 12) DESC, rank) AS best FROM f)
SELECT tool, dataset, level, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(tp AS BIGINT) AS tp, CAST(rank - tp AS BIGINT) AS fp, CAST(n_truth - tp AS BIGINT) AS fn FROM b WHERE best = 1""")
def max_f1(spark: SparkSession, d: str) -> DataFrame:
    b = E.best_f1(E.prefix_curve(*_scored(spark, d)).withColumn("f1", F.round("f1", 12)))
    return b.select(*E.KEYS, *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "tp", "fp", "fn")


@_query(f"""WITH {_SCORED}, u AS (SELECT coalesce(pred.tool, truth.tool) AS tool, coalesce(pred.dataset, truth.dataset) AS dataset, coalesce(pred.level, truth.level) AS level, coalesce(abundance, 0) AS s, CASE WHEN truth.taxid IS NULL THEN 0 ELSE 1 END AS y
  FROM pred FULL JOIN truth ON pred.tool = truth.tool AND pred.dataset = truth.dataset AND pred.level = truth.level AND pred.taxid = truth.taxid),
g AS (SELECT tool, dataset, level, s, sum(y) AS y, count(*) AS n FROM u GROUP BY ALL),
w AS (SELECT *, sum(y) OVER o AS tp, sum(n) OVER o AS k, sum(y) OVER (PARTITION BY tool, dataset, level) AS al FROM g WINDOW o AS (PARTITION BY tool, dataset, level ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, tp / k AS p, CASE WHEN al > 0 THEN tp / al ELSE 0 END AS r FROM w),
a AS (SELECT tool, dataset, level, (r - coalesce(lag(r) OVER o, 0)) * (p + coalesce(lag(p) OVER o, 1)) / 2 AS x FROM z WINDOW o AS (PARTITION BY tool, dataset, level ORDER BY s DESC))
SELECT tool, dataset, level, round(sum(x), 6) AS aupr FROM a GROUP BY tool, dataset, level""")
def aupr(spark: SparkSession, d: str) -> DataFrame:
    return E.aupr(*_scored(spark, d)).withColumn("aupr", F.round("aupr", 6))


@_query(f"WITH {_SCORED}, j AS (SELECT coalesce(pred.dataset, truth.dataset) AS dataset, pred.taxid AS p, truth.taxid AS t FROM pred FULL JOIN truth ON pred.dataset = truth.dataset AND pred.taxid = truth.taxid) SELECT dataset, count(*) FILTER (p IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY dataset")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(*_scored(spark, d), ["dataset"])


@_query("SELECT l_returnflag AS tool, count(*) AS n_datasets, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY 1")
def summary_mean_std(spark: SparkSession, d: str) -> DataFrame:
    s = E.summary(_table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "tool"), ["l_quantity", "l_discount"])
    return s.select("tool", "n_datasets", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@_query("SELECT o_custkey AS tool, count(DISTINCT o_orderpriority) AS n_datasets FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def complete_tools(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(F.col("o_custkey").alias("tool"), F.col("o_orderpriority").alias("dataset"))
    return E.complete_tools(o, o.agg(F.count_distinct("dataset")).first()[0])


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """region, nation and customer as a taxonomy below a root (1)."""
    node = lambda t, i, p, rank, name: _table(spark, d, t).select((F.col(i) + F.lit(base[t])).cast("bigint").alias("taxid"), p.cast("bigint").alias("parent"), F.lit(rank).alias("rank"), F.col(name).alias("name"))
    base = {"region": 10, "nation": 100, "customer": 1000}
    root = spark.createDataFrame([(1, None, "no rank", "root")], "taxid bigint, parent bigint, rank string, name string")
    return root.unionByName(node("region", "r_regionkey", F.lit(1), "family", "r_name")).unionByName(node("nation", "n_nationkey", F.col("n_regionkey") + 10, "genus", "n_name")).unionByName(node("customer", "c_custkey", F.col("c_nationkey") + 100, "species", "c_name"))


@_query("""WITH direct AS (SELECT o_custkey + 1000 AS taxid, count(*) AS tax_reads FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), up AS (SELECT c_custkey + 1000 AS s, n_nationkey + 100 AS g, r_regionkey + 10 AS f FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
j AS (SELECT * FROM direct JOIN up ON s = taxid), a AS (SELECT taxid AS t, tax_reads FROM j UNION ALL SELECT g, tax_reads FROM j UNION ALL SELECT f, tax_reads FROM j UNION ALL SELECT 1, tax_reads FROM j)
SELECT CAST(a.t AS BIGINT) AS taxid, CAST(coalesce(max(d.tax_reads), 0) AS BIGINT) AS tax_reads, CAST(sum(a.tax_reads) AS BIGINT) AS reads, round(100 * sum(a.tax_reads) / (SELECT sum(tax_reads) FROM direct), 6) AS percent FROM a LEFT JOIN direct d ON d.taxid = a.t GROUP BY a.t""")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    direct = _table(spark, d, "orders").groupBy((F.col("o_custkey") + 1000).alias("taxid")).agg(F.count(F.lit(1)).alias("tax_reads"))
    return C.rollup(direct.join(_tree(spark, d).select("taxid"), "taxid", "left_semi"), _tree(spark, d)).withColumn("percent", F.round("percent", 6))


@_query("""WITH t AS (SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey NULLS FIRST) AS line, * FROM (SELECT r_regionkey, NULL AS n_nationkey, 1 AS depth, r_regionkey + 10 AS taxid FROM region UNION ALL SELECT n_regionkey, n_nationkey, 2, n_nationkey + 100 FROM nation))
SELECT CAST(taxid AS BIGINT) AS taxid, depth, CASE WHEN depth = 2 THEN CAST(r_regionkey + 10 AS BIGINT) END AS parent FROM t""")
def preorder_parents(spark: SparkSession, d: str) -> DataFrame:
    r = _table(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.lit(-1).alias("b"), F.lit(1).alias("depth"), (F.col("r_regionkey") + 10).cast("bigint").alias("taxid"))
    n = _table(spark, d, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.lit(2).alias("depth"), (F.col("n_nationkey") + 100).cast("bigint").alias("taxid"))
    report = r.unionByName(n).select(F.lit("t").alias("path"), F.struct("a", "b").alias("line"), "depth", "taxid")
    return C.preorder_parents(report, ["path"]).select("taxid", "depth", "parent")


@_query("WITH n AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS dataset FROM part), f AS (SELECT DISTINCT p_type AS file FROM part) SELECT dataset, min(file) AS file FROM n JOIN f ON starts_with(file, dataset) GROUP BY dataset")
def prefix_join_first(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    names = p.select(F.split("p_type", " ")[0].alias("dataset")).distinct()
    return first_by_prefix(names, p.select(F.col("p_type").alias("file")).distinct(), "dataset", "file")


@_query("WITH n AS (SELECT DISTINCT user_id % 50 AS u, 'user_' || (user_id % 50) AS dataset FROM events), f AS (SELECT DISTINCT 'user_' || (user_id % 50) || '_' || event_type || '.txt' AS file FROM events) SELECT file, dataset, replace(substring(file, length(dataset) + 2), '.txt', '') AS tool FROM f JOIN n ON starts_with(file, dataset || '_')")
def tool_of_file(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select(F.concat(F.lit("user_"), (F.col("user_id") % 50).cast("string")).alias("dataset"), "event_type").distinct()
    files = e.select(F.concat("dataset", F.lit("_"), "event_type", F.lit(".txt")).alias("file")).distinct()
    return first_by_prefix(e.select("dataset").distinct(), files, "dataset", "file", sep="_", longest=True).select("file", "dataset", S.tool_name(F.col("file"), F.col("dataset")).alias("tool"))


@_query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = last_wins(_table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return e.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@_query("WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT * FROM f) THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_acctbal >= 0 OR c_custkey IN (SELECT * FROM f)")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Customers in credit, upserted by those with a finished order."""
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    f = _table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return upsert(c.where("c_acctbal >= 0").select("k", F.lit("old").alias("v")), c.join(f, "k", "left_semi").select("k", F.lit("new").alias("v")), ["k"])


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    done = _table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return not_done(_table(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name")


@_query("SELECT n_name AS dataset, c_mktsegment AS param_set, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS runtime_s FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1, 2")
def runtime_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers as datasets, with the runtimes (finished orders' prices) of each, by nation and segment."""
    c = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    results = c.select(F.col("c_custkey").alias("dataset"), "n_name", "c_mktsegment")
    runtimes = _table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("dataset"), F.col("o_totalprice").alias("runtime_s"))
    j = E.with_runtimes(results, runtimes).groupBy(F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("param_set"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("runtime_s"), F.lit(0.0)), 2).alias("runtime_s"))


@_query("SELECT page_id, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages WHERE contains(html, 'lang=') AND contains(url, 'example')")
def log_regex(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages").where(F.col("html").contains("lang=") & F.col("url").contains("example"))
    return p.select("page_id", F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))




def _log(lit: Callable, cat: Callable, text: Callable):
    return cat(lit("Reads processed:\n\ttotal   : "), text("o_orderkey"), lit("\n\nReads accepted:\n\tunpaired: 0 \n\ttotal   : "), text("o_custkey"), lit("\n\nfp:\t0.0"), text("o_custkey % 90 + 10"), lit(" (base: 0.344)\nreads kept: "), text("o_custkey % 100"), lit(".25 %\ntime needed: "), text("o_orderkey % 1000"), lit(" s"))


@_query("SELECT o_orderkey, o_orderkey AS reads_processed, CAST(o_custkey AS BIGINT) AS reads_accepted, o_custkey % 100 + 0.25::DOUBLE AS reads_kept_pct, CAST('0.0' || (o_custkey % 90 + 10) AS DOUBLE) AS fp, o_orderkey % 1000 AS time_s FROM orders")
def stdout_parse(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select("o_orderkey", _log(F.lit, F.concat, lambda e: F.expr(f"cast({e} as string)")).alias("t"))
    return o.select("o_orderkey", *statistics_columns(F.col("t")))


@_query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h, ' ELSE '' END || CASE WHEN s >= 60 THEN (s % 3600 // 60) || 'm, ' ELSE '' END || (s % 60) || 's' AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)")
def duration_labels(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", S.duration_label(F.floor("o_totalprice")).alias("label"))


@_query("""WITH f AS (SELECT p_partkey, '/data/' || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '_R1' WHEN 1 THEN '_R2' ELSE '' END || CASE p_size % 4 WHEN 0 THEN '.fastq.gz' WHEN 1 THEN '.fa' WHEN 2 THEN '.fq' ELSE '.txt' END AS path FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.(fq|fastq|fa|fasta)(\\.gz)?$', ''), '_R[12]$', '') AS dataset, regexp_matches(path, '\\.(fq|fastq|fa|fasta)(\\.gz)?$') AS is_reads, CASE WHEN regexp_matches(path, '\\.fa$') THEN false ELSE true END AS is_fastq, replace(path, '_R1.', '_R2.') AS mate FROM f""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    path = F.concat(F.lit("/data/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.when(size % 3 == 0, "_R1").when(size % 3 == 1, "_R2").otherwise(""), F.when(size % 4 == 0, ".fastq.gz").when(size % 4 == 1, ".fa").when(size % 4 == 2, ".fq").otherwise(".txt"))
    p = _table(spark, d, "part").select("p_partkey", path.alias("path"))
    return p.select("p_partkey", S.dataset_name(F.col("path")).alias("dataset"), S.is_read_file(F.col("path")).alias("is_reads"), S.is_fastq(F.col("path")).alias("is_fastq"), S.mate_path(F.col("path")).alias("mate"))


@_query("SELECT l_shipmode_set AS param_set, count(*) AS runs FROM (SELECT s_suppkey, unnest(['default', 'low_rarity_fasta', 'high_rarity_fasta', 'low_contribution_fasta', 'high_contribution_fasta', 'low_abundance_fasta', 'high_abundance_fasta']) AS l_shipmode_set FROM supplier) GROUP BY 1")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "supplier").select(F.concat(F.lit("/data/s"), F.col("s_suppkey").cast("string"), F.lit(".fa")).alias("path"))
    return P.plan_runs(files, P.parameter_sets(spark, fastq=False)).groupBy("param_set").agg(F.count(F.lit(1)).alias("runs"))


@_query(f"WITH {_LETTERS_SQL} SELECT read_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, length(seq) - length(replace(seq, 'N', '')) AS n_count FROM letters")
def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return letters(spark, d).select("read_id", "seq", S.reverse_complement(F.col("seq")).alias("rc"), S.count_n(F.col("seq")).cast("bigint").alias("n_count"))


def _runs(spark: SparkSession, d: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Every document's letters as consecutive reads of at most 300 bases: `ord` is the document, `nth` the read in it; with more columns of the documents."""
    docs = _table(spark, d, "documents").select("doc_id", "source", *also, _letters().alias("x"))
    whole = docs.select("doc_id", "source", *also, F.translate("x", _LETTERS, _BASES).alias("seq"), F.translate("x", _LETTERS, _QUALS).alias("qual"))
    r = _parts(whole, ["seq", "qual"])
    return r.select(F.col("source").alias("run_id"), F.lit(0).alias("file_nr"), F.col("doc_id").alias("ord"), "nth", "seq", "qual", *also)


@_query()
def greedy_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Each source is a run; the order is that of the ids, and of the reads in a document."""
    return normalize(_runs(spark, d), Params(d=3, k=21, A=3, B=200, C=2, N=10), t=4, bits=18).select("run_id", "ord", "nth", "kept", "reason")


@_query()
def parallel_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The same reads by exact counts, in parallel rounds; its verdicts are those of `normalize(kind="exact")`."""
    return normalize_parallel(_runs(spark, d), Params(d=3, k=21, A=3, B=200, C=2, N=10))


@_query()
def normalize_statistics(spark: SparkSession, d: str) -> DataFrame:
    return run_statistics(_runs(spark, d), Params(d=3, k=21, A=3, B=200, C=2, N=10), t=4, bits=18).drop("histogram", "millis")


def _two_batches(spark: SparkSession, d: str, p: Params) -> DataFrame:
    """English documents first, then the others by the counts of the reads kept of those."""
    r = _runs(spark, d, ("lang",)).drop("run_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    first, counts = normalize_batch(r.where(english), None, p)
    second, _ = normalize_batch(r.where(~english), counts, p, last=True)
    return first.unionByName(second)


@_query()
def batched_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _two_batches(spark, d, Params(d=3, k=21, A=3, B=200, C=2, N=10))


_FINE = f"(SELECT read_id, nth FROM reads WHERE length(seq) >= {_D.k} AND length(seq) - length(replace(seq, 'N', '')) <= {_D.N})"


@_query(f"""WITH {_READS}, {_kmers_sql(11)}, {_QUALITY}, k AS (SELECT * FROM kmers JOIN q USING (read_id, nth, pos) JOIN {_FINE} USING (read_id, nth) JOIN (SELECT read_id, nth, coalesce(lang = 'en', false) AS early FROM reads) USING (read_id, nth)),
one AS (SELECT read_id, nth FROM (SELECT *, 0 AS c FROM k WHERE early) GROUP BY read_id, nth HAVING {_GOOD_RARE} > {_D.k} OR {_GOOD_MID} > {_D.B}),
df AS (SELECT canon, least(count(DISTINCT (read_id, nth)), 253) AS d FROM k JOIN one USING (read_id, nth) WHERE NOT has_n GROUP BY canon),
two AS (SELECT read_id, nth FROM (SELECT k.*, coalesce(d, 0) AS c FROM k LEFT JOIN df USING (canon) WHERE NOT early) GROUP BY read_id, nth HAVING {_GOOD_RARE} > {_D.k} OR {_GOOD_MID} > {_D.B})
SELECT 0 AS file_nr, read_id AS ord, nth, (read_id, nth) IN (SELECT (read_id, nth) FROM one UNION ALL SELECT (read_id, nth) FROM two) AS kept FROM reads""")
def batched_d6(spark: SparkSession, d: str) -> DataFrame:
    """Decision 6 in two batches; qualities count."""
    return _two_batches(spark, d, replace(_D, d=6))


@_query(f"""WITH docs AS (SELECT source AS tool, lang AS dataset, 'genus' AS level, doc_id AS taxid, floor(n_chars / 50) AS abundance FROM documents),
truth AS (SELECT DISTINCT dataset, v.level, taxid FROM docs, (VALUES ('genus'), ('species')) v(level) WHERE taxid IN (SELECT doc_id FROM labels WHERE quality = 1)), pred AS (SELECT * FROM docs WHERE taxid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
size AS (SELECT dataset, level, count(*) AS n_truth FROM truth GROUP BY ALL),
q AS (SELECT DISTINCT tool, dataset, level FROM (SELECT DISTINCT tool, dataset FROM pred) JOIN (SELECT DISTINCT dataset, level FROM truth) USING (dataset) UNION SELECT DISTINCT tool, dataset, level FROM pred),
h AS (SELECT pred.*, coalesce(n_truth, 0) AS n_truth, CASE WHEN truth.taxid IS NULL THEN 0 ELSE 1 END AS hit FROM pred LEFT JOIN truth USING (dataset, level, taxid) LEFT JOIN size USING (dataset, level)),
cv AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER w AS tp FROM h WINDOW w AS (PARTITION BY tool, dataset, level ORDER BY abundance DESC, taxid ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / rank AS p, CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 0 END AS r FROM cv), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool, dataset, level ORDER BY f1 DESC, rank) AS best FROM f) WHERE best = 1)
SELECT tool, dataset, level, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(size.n_truth, 0) - coalesce(tp, 0) AS BIGINT) AS fn
FROM q LEFT JOIN b USING (tool, dataset, level) LEFT JOIN size USING (dataset, level)""")
def metrics_no_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Tools that predict genera only, judged at species too."""
    docs = _table(spark, d, "documents").select(F.col("source").alias("tool"), F.col("lang").alias("dataset"), F.lit("genus").alias("level"), F.col("doc_id").alias("taxid"), F.floor(F.col("n_chars") / 50).cast("double").alias("abundance"))
    labels = _table(spark, d, "labels").withColumnRenamed("doc_id", "taxid")
    truth = docs.join(labels.where("quality = 1"), "taxid", "left_semi").select("dataset", F.explode(F.array(F.lit("genus"), F.lit("species"))).alias("level"), "taxid")
    m = E.metrics(docs.join(labels.where("toxic = 1"), "taxid", "left_anti"), truth)
    return m.select(*E.KEYS, *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "tp", "fn")


@_query()
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).withColumn("dataset", F.concat(F.lit("d"), F.substring("run_id", -1, 1)))
    return P.sweep(r.drop("run_id"), P.parameter_sets(spark), t=4, bits=16).withColumn("reads_kept_pct", F.round("reads_kept_pct", 6))


_CALLS_SQL = f"""WITH {_LETTERS_SQL}, items AS (SELECT CAST(item_id % 25 + 100 AS BIGINT) AS taxid, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS seq FROM benchmark),
{_kmers_sql(31, "letters", "read_id", "rk")}, {_kmers_sql(31, "items", "taxid", "ik")},
refs AS (SELECT DISTINCT canon, taxid, n_regionkey + 10 AS region FROM ik JOIN nation ON n_nationkey + 100 = taxid WHERE NOT has_n),
tab AS (SELECT canon, CASE WHEN count(DISTINCT taxid) = 1 THEN min(taxid) WHEN count(DISTINCT region) = 1 THEN min(region) ELSE 1 END AS taxid FROM refs GROUP BY canon),
h AS (SELECT read_id, taxid, count(*) AS hits FROM rk JOIN tab USING (canon) WHERE NOT has_n GROUP BY 1, 2),
up AS (SELECT n_nationkey + 100 AS taxid, unnest([n_nationkey + 100, n_regionkey + 10, 1]) AS anc FROM nation UNION ALL SELECT r_regionkey + 10, unnest([r_regionkey + 10, 1]) FROM region UNION ALL SELECT 1, 1),
sc AS (SELECT h.read_id, h.taxid, sum(a.hits) AS score FROM h JOIN up USING (taxid) JOIN h a ON a.read_id = h.read_id AND a.taxid = up.anc GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY read_id) AS m FROM sc) WHERE score = m),
c AS (SELECT read_id, anc, count(*) AS c, max(m) AS m FROM best JOIN up USING (taxid) GROUP BY 1, 2), n AS (SELECT read_id, count(*) AS n FROM best GROUP BY 1),
calls AS (SELECT read_id, max(anc) AS taxid, max(m) AS hits FROM c JOIN n USING (read_id) WHERE c = n GROUP BY read_id)"""
CLASSIFY_SQL = f"""{_CALLS_SQL}
SELECT letters.read_id, CAST(coalesce(taxid, 0) AS BIGINT) AS taxid, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM letters LEFT JOIN calls USING (read_id)"""


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(items as references of nations, the tree of regions)."""
    items = _table(spark, d, "benchmark").select((F.col("item_id") % 25 + 100).cast("bigint").alias("taxid"), F.translate(_letters(), _LETTERS, _BASES).alias("seq"))
    return items, _tree(spark, d).where("rank <> 'species'")


@_query(CLASSIFY_SQL)
def classify_reads(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as reads, benchmark items as references of nations in the tree of regions."""
    items, tree = _references(spark, d)
    up = C.closure(tree)
    return C.classify(letters(spark, d), materialized(C.kmer_taxa(items, tree, 31, up)), tree, 31, up=up)


@_query(CLASSIFY_SQL)
def classify_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The same calls through a table in buckets of minimizers, which isn't shuffled."""
    items, tree = _references(spark, d)
    up = C.closure(tree)
    index = Z.Index.write(C.kmer_taxa(items, tree, 31, up), scratch(spark), 31, buckets=16)
    return C.classify_by_index(letters(spark, d), index, tree, up=up)


@_query(f"""{_CALLS_SQL}, known AS (SELECT canon, tab.taxid FROM rk JOIN tab USING (canon) JOIN calls ON calls.read_id = rk.read_id WHERE NOT has_n), genome AS (SELECT anc, count(*) AS g FROM tab JOIN up USING (taxid) GROUP BY anc)
SELECT CAST(anc AS BIGINT) AS taxid, count(DISTINCT canon) AS kmers, round(count(*) / count(DISTINCT canon), 6) AS dup, round(count(DISTINCT canon) / g, 6) AS cov FROM known JOIN up USING (taxid) JOIN genome USING (anc) GROUP BY anc, g""")
def clade_kmers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct k-mers of classified reads by clade, counted exactly."""
    items, tree = _references(spark, d)
    up, whole = C.closure(tree), materialized(letters(spark, d))
    table = materialized(C.kmer_taxa(items, tree, 31, up))
    found = C.clade_kmers(whole, materialized(C.classify(whole, table, tree, 31, up=up)), table, 31, up, exact=True)
    return found.select("taxid", "kmers", F.round("dup", 6).alias("dup"), F.round("cov", 6).alias("cov"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Canonical k-mer counts."""
    return kmer_count(spark, d)
