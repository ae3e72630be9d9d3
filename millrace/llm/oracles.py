"""SQL that gives the rows of the registered queries, where SQL can."""

from __future__ import annotations

SQL = {
    "op1_url_filter": r"""
        WITH cut AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM cut)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op10_topk": r"""
        WITH whole AS (
            SELECT row_number() OVER () AS number, vec_id,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.number, q.vec_id AS query_id, x.vec_id,
                CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
            FROM whole q JOIN whole x ON q.number <> x.number
            WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_collocations": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (
            SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
            FROM texts),
        starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces),
        spans AS (SELECT lang, words, pos, unnest(range(1, least(4, len(words) - pos + 1) + 1)) AS length FROM starts),
        counts AS (
            SELECT lang, words[pos:pos + length - 1] AS words, length, count(*) AS f
            FROM spans GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE length = 1 GROUP BY lang),
        phrases AS (SELECT lang, words, length, f AS a FROM counts WHERE length > 1 AND f >= 30),
        cuts AS (SELECT *, unnest(range(1, length)) AS k FROM phrases),
        scored AS (
            SELECT c.lang, c.words, c.length, c.a, k, x.f AS l, y.f AS r,
                2000000 * CAST(c.a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS score
            FROM cuts c
            JOIN counts x ON x.lang = c.lang AND x.words = c.words[1:k]
            JOIN counts y ON y.lang = c.lang AND y.words = c.words[k + 1:]),
        weakest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
        inner_starts AS (SELECT *, unnest(range(2, length)) AS many FROM phrases WHERE length > 2),
        inner_spans AS (SELECT *, unnest(range(1, length - many + 2)) AS pos FROM inner_starts),
        longer AS (
            SELECT lang, words[pos:pos + many - 1] AS words, max(a) AS f FROM inner_spans GROUP BY ALL),
        ranked AS (
            SELECT w.lang, row_number() OVER (
                    PARTITION BY w.lang ORDER BY score DESC, a DESC, array_to_string(w.words, ' ')) AS rank,
                array_to_string(w.words, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
            FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.words = w.words
            WHERE g.f IS NULL OR 100 * g.f < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_minhash_dedup": r"""
        WITH RECURSIVE cut AS (
            SELECT row_number() OVER () AS number, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        sets AS (
            SELECT number, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
            FROM cut),
        hashed AS (SELECT number, len(s) AS n, unnest(s) AS shingle FROM sets),
        shared AS (
            SELECT x.number AS a, y.number AS b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb
            FROM hashed x JOIN hashed y ON x.shingle = y.shingle AND x.number < y.number GROUP BY ALL),
        near AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
        links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reached AS (
            SELECT number AS start, number AS reach FROM sets
            UNION
            SELECT start, b FROM reached JOIN links ON a = reach),
        lowest AS (
            SELECT start, min(doc_id) AS component_id FROM reached JOIN sets ON number = reach GROUP BY start)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id,
            doc_id IS NOT DISTINCT FROM component_id AS kept
        FROM sets JOIN lowest ON start = number""",
}
