"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from .decontaminate import op7_decontamination
from .jaccard_join import op9_jaccard_join
from .language_id import op5_language_id
from .line_dedup import OP11_SQL, op11_line_dedup
from .packing import op2_packing
from .pii_surrogates import op6_pii_surrogates
from .repeats import op10_repeats
from .secret_scan import op8_secret_scan
from .token_counts import op1_token_counts
from .topk_search import OP3_SQL, op3_topk_search
from .warc import op4_warc
from .whitening import op12_embedding_whitening


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_token_counts, op2_packing, op3_topk_search, op4_warc, op5_language_id, op6_pii_surrogates, op7_decontamination, op8_secret_scan, op9_jaccard_join, op10_repeats, op11_line_dedup, op12_embedding_whitening)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL)),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM b WHERE n > 0)),
t AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, p, n, item FROM t JOIN g USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, w, least(5, len(w)) AS k FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents)),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d WHERE k > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, p, md5_number(substring(h, 2 * p + 1, 400)) AS k FROM (SELECT *, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400)),
r AS (SELECT row, p, CASE WHEN p - lag(p) OVER (PARTITION BY row ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
s AS (SELECT row, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM r) GROUP BY row, g),
e AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS z FROM s),
k AS (SELECT row, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d USING (row) GROUP BY row)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_repeats": OP10_SQL, "op11_line_dedup": OP11_SQL, "op3_topk_search": OP3_SQL, "op7_decontamination": OP7_SQL, "op9_jaccard_join": OP9_SQL}
