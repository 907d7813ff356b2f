"""DuckDB SQL of the queries that SQL can express."""

SEARCH = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id,
           CAST(list_sum(list_transform(list_zip(q.vec, v.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS place
    FROM documents
), sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS flow
    FROM sized GROUP BY source
), caps AS (
    SELECT *, CASE flow % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM sums
), levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (
               ORDER BY cap / weight, flow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY cap / weight, flow ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM caps
), targets AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (
               SELECT level FROM levels WHERE cap >= level * weight ORDER BY cap / weight, flow LIMIT 1)) AS target
    FROM levels
), queued AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
           CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM sized AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
    SELECT *, CASE WHEN source_size > 0 THEN goal // source_size * size
                   + greatest(0, least(size, goal - goal // source_size * source_size - before)) ELSE 0 END AS taken
    FROM queued
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(least(1.0, (before + size) / target), 9) END AS first_finish
FROM mixed
"""

PREFERENCES = r"""
WITH turns AS (
    SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), links AS (
    SELECT conv_id AS pair_id, half, coalesce(lead(conv_id) OVER (ORDER BY conv_id DESC), max(conv_id) OVER ()) AS rejected_id
    FROM (SELECT conv_id, floor((max(turn) + 2) / 2) AS half FROM turns GROUP BY conv_id)
), rows AS (
    SELECT pair_id, true AS is_chosen, turn, role, text FROM turns JOIN links ON conv_id = pair_id
    UNION ALL SELECT pair_id, false, turn, role, text FROM turns JOIN links ON conv_id = pair_id WHERE turn < half
    UNION ALL SELECT pair_id, false, turn, role, text FROM turns JOIN links ON conv_id = rejected_id WHERE turn >= half
), single AS (
    SELECT pair_id, is_chosen, turn, s.role AS role, s.text AS text
    FROM (SELECT pair_id, is_chosen, turn, min({'role': role, 'text': text}) AS s FROM rows GROUP BY ALL)
), firsts AS (
    SELECT pair_id, min(turn) FILTER (differ) AS first FROM (
        SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn,
               c.turn IS NULL OR r.turn IS NULL OR c.role <> r.role OR c.text <> r.text AS differ
        FROM (SELECT * FROM single WHERE is_chosen) AS c
        FULL JOIN (SELECT * FROM single WHERE NOT is_chosen) AS r ON c.pair_id = r.pair_id AND c.turn = r.turn
    ) GROUP BY pair_id
), parts AS (
    SELECT pair_id, turn, role, text, '<|' || role || '|>' || chr(10) AS head,
           CASE WHEN first IS NULL OR turn < first THEN 'prompt' WHEN is_chosen THEN 'chosen' ELSE 'rejected' END AS part
    FROM single JOIN firsts USING (pair_id)
    WHERE is_chosen OR NOT (first IS NULL OR turn < first)
), placed AS (
    SELECT *, head || text || '<|end|>' || chr(10) AS whole, CAST(length(head) + coalesce(sum(length(head) + length(text) + 8) OVER (
               PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM parts
), spans AS (SELECT *, start || ':' || (start + length(text) + 7) AS span FROM placed)
SELECT pair_id, count(*) FILTER (part = 'prompt') AS n_prompt_turns,
       coalesce(string_agg(whole, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(whole, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(whole, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY turn) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(span, ',' ORDER BY turn) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_spans
FROM spans GROUP BY pair_id
"""

NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike,
           CAST(list_sum(list_transform(list_zip(a.vec, v.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

TRIE = r"""
WITH convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS first, count(*) AS n, xor(list_reduce(
        list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(
            [xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))
        )), 4294967295) % 4 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
    SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM convs
    UNION ALL
    SELECT c.conv_id, t.place, key, words FROM convs AS c JOIN turns AS t ON t.conv_id = c.first AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(f.n, 0)), key, words
    FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN convs AS f ON f.conv_id = c.first
), paths AS (
    SELECT conv_id, depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
           max(depth) OVER (PARTITION BY conv_id) AS length
    FROM steps
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
           sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
    FROM paths GROUP BY path, depth
), children AS (
    SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes AS n LEFT JOIN children AS c ON c.path = n.path
), sums AS (
    SELECT left(path, 32 * above) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted AS n JOIN sums AS s ON s.path = n.path
LEFT JOIN nodes AS p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preference_pairs": PREFERENCES, "op3_maxscore_search": SEARCH, "op6_source_mixing": MIXING,
        "op12_hard_negatives": NEGATIVES, "op13_prefix_trie": TRIE,
    }
