"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# The definition, word for word: integer vectors, all scores, the 20 best.
OP2 = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.ints[i] * c.ints[i] for i in range(1, len(q.ints) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# All scores of the anchors; a row number tells rows that share an id apart.
OP11 = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.n, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
         CAST(list_sum([a.ints[i] * c.ints[i] for i in range(1, len(a.ints) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.n <> c.n
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same
), r AS (
  SELECT p.n, p.anchor_id, p.positive_id, p.place, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.n, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.n = s.n
  WHERE p.place <= 5 AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""

# Dense: every kept term for every group, with a count of zero where there is none.
OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT id, lang, source, term, count(*) AS c FROM (SELECT id, lang, source, unnest(words) AS term FROM d) u GROUP BY ALL
), k AS (
  SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM w GROUP BY lang, term HAVING count(*) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT w.lang, w.source, w.term, CAST(sum(w.c) AS HUGEINT) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term
), v AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang
), t AS (
  SELECT g.lang, g.source, coalesce(sum(n.c), 0) AS n FROM g LEFT JOIN n ON g.lang = n.lang AND g.source = n.source GROUP BY g.lang, g.source
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(n.c, 0) AS c,
         CAST(1 + (1000000000 * (coalesce(n.c, 0) + 5)) // (t.n + 5 * v.v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (k.c + 5)) // (v.n + 5 * v.v) AS BIGINT) AS q
  FROM t JOIN k ON t.lang = k.lang JOIN v ON t.lang = v.lang
       LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""

# Every window of 13 words, the smallest document that holds it, and what that covers.
OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT id, doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM d WHERE len(words) >= 13
), x AS (
  SELECT id, doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS win FROM w
), m AS (
  SELECT win, min(doc_id) AS lo, max(coalesce(doc_id, 9223372036854775807)) AS hi FROM x GROUP BY win
), c AS (
  SELECT DISTINCT x.id, unnest(range(x.pos, x.pos + 13)) AS pos FROM x JOIN m ON x.win = m.win
  WHERE m.lo < coalesce(x.doc_id, 9223372036854775807)
), u AS (
  SELECT id, doc_id, pos, words[pos] AS word FROM (SELECT id, doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d) z
), e AS (
  SELECT u.id, string_agg(u.word, ' ' ORDER BY u.pos) AS kept, count(*) AS n
  FROM u LEFT JOIN c ON u.id = c.id AND u.pos = c.pos WHERE c.pos IS NULL GROUP BY u.id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(e.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(e.kept, '')) AS kept_sha256
FROM d LEFT JOIN e ON d.id = e.id
"""

ORACLE_SQL = {"op2_topk": OP2, "op11_hard_negatives": OP11, "op12_divergence": OP12, "op13_phrase_dedup": OP13}
