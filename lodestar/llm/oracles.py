"""SQL that gives the rows of those queries which SQL can express."""

OP8_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""

OP6_SUFFIX_ARRAY = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, z, h[2 * z + 1 : 2 * z + 2398] AS h, n FROM (SELECT doc_id, h, n, unnest(range(0, n, 1000)) AS z FROM d)),
w AS (SELECT doc_id, z + q AS p, md5_number(h[2 * q + 1 : 2 * q + 400]) AS g FROM (SELECT doc_id, z, h, unnest(range(0, least(1000, n - 199 - z))) AS q FROM b WHERE n - z >= 200)),
s AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
o AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM s),
i AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o) GROUP BY doc_id, k),
e AS (SELECT doc_id, lo, hi FROM i UNION ALL SELECT doc_id, n, n FROM d),
f AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS z FROM e),
x AS (SELECT f.doc_id, string_agg(CASE WHEN lo > z THEN h[2 * z + 1 : 2 * lo] ELSE '' END, '' ORDER BY lo, z) AS rest FROM f JOIN d USING (doc_id) GROUP BY f.doc_id),
c AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM i GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES = {"op6_suffix_array": OP6_SUFFIX_ARRAY, "op8_embeddings": OP8_EMBEDDINGS}
