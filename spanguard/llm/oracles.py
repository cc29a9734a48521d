"""The queries of this folder in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(regexp_extract_all({_SMALL}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n_shingles FROM s
), e AS (SELECT doc_id, unnest(s) AS g FROM s
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)
), r AS (SELECT doc_id, doc_id AS there FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.there)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(there) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    "op5_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
), g AS (
    SELECT vec_id, e FROM v
    WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (SELECT vec_id, vec_id AS there FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.there
), c AS (SELECT vec_id, min(there) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = c.vec_id), 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (SELECT item_id, coalesce(regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
), h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)
), p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
        list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)])::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
), p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
    SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT a AS anchor_id, b AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5""",
    "op13_exact_dedup": r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents
), k AS (
    SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept
    FROM t
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM k""",
}
