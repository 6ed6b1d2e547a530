"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
     g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM d JOIN g USING (body)
"""

MIXING = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens, count(*) AS documents FROM d GROUP BY source),
r AS (SELECT max(tokens) / min(tokens) AS ratio, count(*) AS sources, max(documents) AS most FROM t),
halved(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1,
           CASE WHEN pow(ratio, 1 - (low + high) / 2) > 2.0 THEN (low + high) / 2 ELSE low END,
           CASE WHEN pow(ratio, 1 - (low + high) / 2) > 2.0 THEN high ELSE (low + high) / 2 END
    FROM halved, r WHERE step < 40),
a AS (SELECT low AS a, ceil(log2(most) / 2)::INT AS bits FROM halved, r WHERE step = 40),
w AS (SELECT source, tokens, pow(tokens, a) AS power, bits FROM t, a),
q AS (SELECT source, tokens::BIGINT AS tokens, power / sum(power) OVER () AS weight, bits,
             round(power * max(tokens / power) OVER ())::BIGINT AS quota FROM w),
e AS (SELECT *, quota // tokens AS epochs, quota - (quota // tokens) * tokens AS rest FROM q),
n AS (SELECT d.doc_id, d.source, d.n_tokens, e.weight, e.epochs, e.rest,
             (('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT >> (32 - bits)) AS block
      FROM d JOIN e USING (source)),
copies AS (SELECT *, unnest(range(epochs + 1)) AS epoch FROM n),
ordered AS (SELECT *, md5('mix:' || source || ':' || epoch || ':' || block) || md5('mix:' || epoch || ':' || doc_id) AS place FROM copies),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place) AS filled FROM ordered)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, epoch, block, place
FROM summed WHERE epoch < epochs OR (rest > 0 AND filled <= rest)
"""

METRIC_JOIN = r"""
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
           WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a),
component AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM linked GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN component c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

SENTENCE_SPANS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t]|\n)', '\1' || chr(1), 'g'), chr(1)),
                                      lambda s: s <> '') AS parts FROM documents),
p AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM d),
s AS (SELECT doc_id, pos, lower(trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g'))) AS plain FROM p),
w AS (SELECT doc_id, pos, plain, len(string_split(plain, ' ')) AS words FROM s WHERE plain <> ''),
r AS (SELECT doc_id, pos, plain, words,
             lead(pos, 1) OVER o AS pos2, lead(plain, 1) OVER o AS plain2, lead(words, 1) OVER o AS words2,
             lead(pos, 2) OVER o AS pos3, lead(plain, 2) OVER o AS plain3, lead(words, 2) OVER o AS words3
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
spans AS (
    SELECT doc_id, pos, pos AS until, plain AS body FROM r WHERE words >= 30
    UNION ALL SELECT doc_id, pos, pos2, plain || chr(10) || plain2 FROM r WHERE words + words2 >= 30
    UNION ALL SELECT doc_id, pos, pos3, plain || chr(10) || plain2 || chr(10) || plain3 FROM r WHERE words + words2 + words3 >= 10),
seen AS (SELECT doc_id, pos, until, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos, until) AS nth FROM spans),
cut AS (SELECT DISTINCT doc_id, unnest(range(pos, until + 1)) AS pos FROM seen WHERE nth > 1),
n AS (SELECT doc_id, count(*) AS n_removed, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM cut GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(part, '' ORDER BY pos) AS body FROM p ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(body, '')) AS text_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

HARD_NEGATIVES = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
      FROM r AS a, r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
       row_number() OVER w::INT AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""

ORACLES = {
    "op5_sentence_spans": SENTENCE_SPANS,
    "op6_metric_join": METRIC_JOIN,
    "op7_mixing": MIXING,
    "op8_exact_dedup": EXACT_DEDUP,
    "op11_hard_negatives": HARD_NEGATIVES,
}
