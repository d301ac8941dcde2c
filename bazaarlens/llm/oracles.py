"""The same results in DuckDB SQL where SQL expresses them."""

from __future__ import annotations

__all__ = ["ORACLES"]

EXACT = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                  length(coalesce(text, '')) AS chars FROM documents),
     g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)"""

LINES = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents),
     f AS (SELECT doc_id, unnest(range(len(line))) AS i, unnest(line) AS raw FROM l),
     t AS (SELECT doc_id, i, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS tidy FROM f),
     w AS (SELECT doc_id, i, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3,
                  tidy || chr(10) || lead(tidy) OVER o || chr(10) || lead(tidy, 2) OVER o AS words
           FROM t WHERE tidy <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     k AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS k FROM w WHERE words IS NOT NULL),
     gone AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM k WHERE k > 1)
SELECT t.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       coalesce(string_agg(t.raw, chr(10) ORDER BY t.i) FILTER (WHERE gone.i IS NULL), '') AS text
FROM t LEFT JOIN gone USING (doc_id, i) GROUP BY t.doc_id"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s),
 c AS (SELECT min(doc_id) AS doc_id, list(doc_id) AS copies, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM c),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS t, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (t - k)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
 o AS (SELECT unnest(copies) AS doc_id, component_id FROM c JOIN m ON m.a = c.doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(o.component_id, n.doc_id) AS component_id, n.doc_id = coalesce(o.component_id, n.doc_id) AS kept
FROM n LEFT JOIN o USING (doc_id)"""

def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round of the clustering as two steps: nearest centroid over all pairs, then floor of the means."""
    out = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})"""]
    for t in range(rounds + 1):
        out.append(f"""
 a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(j, (d, j)) AS j FROM (
   SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{t}) GROUP BY r)""")
        if t < rounds:
            out.append(f"""
 m{t} AS MATERIALIZED (SELECT j, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS i FROM a{t}) GROUP BY j, i),
 c{t + 1} AS MATERIALIZED (SELECT j, coalesce(n.c, c{t}.c) AS c FROM c{t} LEFT JOIN (SELECT j, list(x ORDER BY i) AS c FROM m{t} GROUP BY j) n USING (j))""")
    return ",".join(out) + f"""
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)"""


TOP_K = """
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM k q JOIN k c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

ORACLES = {"op11_centroid_clusters": clusters_sql(), "op12_exact_top_k": TOP_K, "op1_near_dedup": NEAR, "op3_line_dedup": LINES, "op7_exact_dedup": EXACT}
