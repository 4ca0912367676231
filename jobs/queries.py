"""The jobs as queries over the driver's tables: each runs twice into a new folder and gives its whole output; and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readmill.queries import CLASSIFY_SQL
from readmill.storage import shared_dir

from . import classify_new_reads, score_tools
from .common import config


def _twice(spark: SparkSession, sf_dir: str, job) -> DataFrame:
    out = f"{shared_dir(spark)}/{job.NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, sf_dir, out, **config(job.NAME))
    return job.output(spark, out)


def job1_classify_new_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir, classify_new_reads)


def job2_score_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir, score_tools)


JOB1_SQL = f"""
WITH called AS ({CLASSIFY_SQL}),
k AS (SELECT coalesce(nullif(source, ''), 'none') AS source, read_id, taxid, hits FROM called JOIN documents ON doc_id = read_id),
anc AS (SELECT n_nationkey + 100 AS taxid, unnest([n_nationkey + 100, n_regionkey + 10, 1]) AS a FROM nation UNION ALL SELECT r_regionkey + 10, unnest([r_regionkey + 10, 1]) FROM region UNION ALL SELECT 1, 1 UNION ALL SELECT 0, 0),
t AS (SELECT source, taxid, count(*) AS tax_reads FROM k GROUP BY 1, 2),
r AS (SELECT source, a AS taxid, CAST(sum(tax_reads) AS BIGINT) AS reads, CAST(coalesce(sum(tax_reads) FILTER (a = t.taxid), 0) AS BIGINT) AS tax_reads FROM t JOIN anc USING (taxid) GROUP BY source, a)
SELECT 'call' AS part, source, read_id, taxid, hits, NULL::BIGINT AS reads, NULL::BIGINT AS tax_reads, NULL::DOUBLE AS percent FROM k
UNION ALL SELECT 'report', source, NULL, CAST(taxid AS BIGINT), NULL, reads, tax_reads, round(100 * reads / (SELECT count(*) FROM k WHERE k.source = r.source), 6) FROM r
"""

_VALUES = score_tools.VALUES
_STATS = ", ".join(f"round({f}({v}), 6) AS {v}_{x}" for v in _VALUES for f, x in (("avg", "mean"), ("stddev_pop", "std")))
JOB2_SQL = f"""
WITH docs AS (SELECT source AS tool, lang AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'genus' ELSE 'species' END AS level, doc_id AS taxid, floor(coalesce(n_chars, 0) / 50) AS abundance FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
truth AS (SELECT DISTINCT dataset, v.level, taxid FROM docs, (VALUES ('genus'), ('species')) v(level) WHERE taxid IN (SELECT doc_id FROM labels WHERE quality = 1)),
pred AS (SELECT tool, dataset, level, taxid, max(abundance) AS abundance FROM docs WHERE taxid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AND dataset IN (SELECT dataset FROM truth) GROUP BY ALL),
size AS (SELECT dataset, level, count(*) AS n_truth FROM truth GROUP BY ALL),
q AS (SELECT tool, dataset, level FROM (SELECT DISTINCT tool, dataset FROM pred) JOIN (SELECT DISTINCT dataset, level FROM truth) USING (dataset)),
h AS (SELECT pred.*, coalesce(n_truth, 0) AS n_truth, CASE WHEN truth.taxid IS NULL THEN 0 ELSE 1 END AS hit FROM pred LEFT JOIN truth USING (dataset, level, taxid) LEFT JOIN size USING (dataset, level)),
cv AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER w AS tp FROM h WINDOW w AS (PARTITION BY tool, dataset, level ORDER BY abundance DESC, taxid ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / rank AS p, CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 0 END AS r FROM cv), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool, dataset, level ORDER BY f1 DESC, rank) AS best FROM f) WHERE best = 1),
u AS (SELECT q.tool, q.dataset, q.level, coalesce(pred.abundance, 0) AS s, CASE WHEN truth.taxid IS NULL THEN 0 ELSE 1 END AS y
  FROM (SELECT tool, dataset, level, taxid FROM pred UNION SELECT q.tool, q.dataset, q.level, truth.taxid FROM q JOIN truth USING (dataset, level)) x JOIN q USING (tool, dataset, level) LEFT JOIN pred USING (tool, dataset, level, taxid) LEFT JOIN truth ON truth.dataset = q.dataset AND truth.level = q.level AND truth.taxid = x.taxid),
g AS (SELECT tool, dataset, level, s, sum(y) AS y, count(*) AS n FROM u GROUP BY ALL),
w AS (SELECT *, sum(y) OVER o AS tp, sum(n) OVER o AS k, sum(y) OVER (PARTITION BY tool, dataset, level) AS al FROM g WINDOW o AS (PARTITION BY tool, dataset, level ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, tp / k AS p, CASE WHEN al > 0 THEN tp / al ELSE 0 END AS r FROM w),
a AS (SELECT tool, dataset, level, (r - coalesce(lag(r) OVER o, 0)) * (p + coalesce(lag(p) OVER o, 1)) / 2 AS x FROM z WINDOW o AS (PARTITION BY tool, dataset, level ORDER BY s DESC)),
ar AS (SELECT tool, dataset, level, sum(x) AS aupr FROM a GROUP BY ALL),
tot AS (SELECT tool, dataset, coalesce(nullif(sum(abundance) FILTER (level = 'genus'), 0), nullif(sum(abundance) FILTER (level = 'species'), 0), 1000000) AS total_reads FROM pred GROUP BY ALL),
m AS (SELECT q.tool, q.dataset, q.level, coalesce(b.p, 0) AS precision, coalesce(b.r, 0) AS recall, coalesce(b.f1, 0) AS f1, CASE WHEN b.p IS NULL THEN 0 ELSE coalesce(aupr, 0) END AS aupr,
  CAST(coalesce(b.tp, 0) AS BIGINT) AS tp, CAST(coalesce(b.rank - b.tp, 0) AS BIGINT) AS fp, CAST(coalesce(size.n_truth, 0) - coalesce(b.tp, 0) AS BIGINT) AS fn, coalesce(total_reads, 1000000) AS total_reads
  FROM q LEFT JOIN b USING (tool, dataset, level) LEFT JOIN ar USING (tool, dataset, level) LEFT JOIN size USING (dataset, level) LEFT JOIN tot USING (tool, dataset)),
wide AS (SELECT tool, dataset, {", ".join(f"coalesce(max(round({v.split('_')[1]}, 6)) FILTER (level = '{v.split('_')[0]}'), 0) AS {v}" for v in _VALUES)} FROM m GROUP BY ALL),
s AS (SELECT tool, {_STATS}, count(*) AS n_datasets FROM wide GROUP BY tool HAVING count(*) = (SELECT count(DISTINCT dataset) FROM m)),
d AS (SELECT 'metrics' AS part, tool, level, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(aupr, 6) AS aupr, tp, fp, fn, CAST(total_reads AS DOUBLE) AS total_reads, dataset FROM m),
c AS (SELECT 'curve' AS part, tool, taxid, CAST(abundance AS DOUBLE) AS abundance, CAST(rank AS INTEGER) AS rank, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, dataset, level FROM f)
SELECT * FROM d UNION ALL BY NAME SELECT * FROM c UNION ALL BY NAME SELECT 'summary' AS part, * FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_classify_new_reads, job2_score_tools)}


def oracle_sql() -> dict[str, str]:
    return {"job1_classify_new_reads": JOB1_SQL, "job2_score_tools": JOB2_SQL}
