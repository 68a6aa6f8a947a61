"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

_JACCARD = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  runs AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
  one AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM runs),
  links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  walk AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM walk JOIN links ON node = x)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM runs JOIN (SELECT node AS doc_id, min(root) AS component_id FROM walk GROUP BY node) USING (doc_id)"""

_REPEATS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS p FROM t)),
  late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
  runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM late)),
  spans AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
  pieces AS (SELECT doc_id, s, e, substr(h, 2 * b + 1, 2 * (s - b)) AS piece FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM spans) JOIN t USING (doc_id)),
  cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS e, string_agg(piece, '' ORDER BY s) AS head FROM pieces GROUP BY doc_id)
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id)"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
  walk AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT y, root FROM walk JOIN links ON node = x),
  c AS (SELECT node AS vec_id, min(root) AS component_id FROM walk GROUP BY node)
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)"""

ORACLE_SQL = {"op3_ngram_jaccard": _JACCARD, "op4_suffix_dedup": _REPEATS, "op6_embedding_dedup": _VECTORS}
