"""The same results in DuckDB SQL, where it can express them."""

from __future__ import annotations

OP1 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunk AS (  -- short strings: cutting a gram out of one does not walk through a whole text
  SELECT doc_id, length(h) // 2 AS n, c * 256 AS base, substr(h, 512 * c + 1, 612) AS h
  FROM (SELECT *, unnest(range(0, (length(h) // 2 + 255) // 256)) AS c FROM d)
),
pos AS (SELECT doc_id, n, base + q AS p, substr(h, 2 * q + 1, 2) AS b, substr(h, 2 * q + 1, 100) AS g
        FROM (SELECT *, unnest(range(0, least(256, n - base))) AS q FROM chunk)),
grams AS (SELECT doc_id, p, g FROM pos WHERE p + 50 <= n),
least AS (SELECT g, min(doc_id) AS first_id FROM grams GROUP BY g),
hits AS (SELECT doc_id, p FROM grams JOIN least USING (g) WHERE doc_id > first_id),
bytes AS (
  SELECT pos.doc_id, pos.p, pos.b,
         max(hits.p) OVER (PARTITION BY pos.doc_id ORDER BY pos.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM pos LEFT JOIN hits ON pos.doc_id = hits.doc_id AND pos.p = hits.p
),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM bytes),
sums AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, link.y FROM reach JOIN link ON reach.r = link.x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON vec_id = x GROUP BY vec_id
"""

OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
),
bag AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY doc_id, g),
size AS (SELECT doc_id, sum(n) AS n FROM bag GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS c FROM bag a JOIN bag b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE c::DOUBLE / (sx.n + sy.n - c) >= 0.8),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.r = link.x),
part AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, component_id, count(*) OVER (PARTITION BY component_id) AS group_size, doc_id = component_id AS kept FROM part
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
held AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
         FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term, n_docs),
asked AS (SELECT q, any_value(item_id) AS item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY q, term),
scored AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term), totals GROUP BY q, r
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE: dict[str, str] = {"op1_cuckoo_dedup": OP1, "op2_suffix_dedup": OP2, "op8_ego_join": OP8, "op9_bagminhash": OP9, "op12_document_tree_search": OP12}
