"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP1 = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS x, hex(x) AS h, CAST(octet_length(x) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS p, x FROM d WHERE n >= 50),
g AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY x[p + 1 : p + 50]) AS first_id FROM w),
s AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM g WHERE first_id < doc_id),
k AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM s),
r AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM k GROUP BY doc_id, k),
c AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last_e FROM r GROUP BY doc_id),
f AS (
  SELECT r.doc_id, string_agg(substr(d.h, 2 * before_e + 1, 2 * (b - before_e)), '' ORDER BY b) AS h
  FROM (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before_e FROM r) r JOIN d USING (doc_id)
  GROUP BY r.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(f.h, '') || substr(d.h, 2 * coalesce(c.last_e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""

OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id,
       CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
n AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS size FROM v),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.98),
reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id LEFT JOIN l ON l.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": OP1,
        "op3_warc": OP3,
        "op5_vector_dedup": OP5,
    }
