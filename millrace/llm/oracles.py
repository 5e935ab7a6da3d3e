"""The SQL whose rows a query of this package must give, where SQL can express it."""

from __future__ import annotations

#: The words of every whole text, parted by ASCII white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = rf"""
WITH docs AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), windows AS (
    SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS run
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM docs)
), firsts AS (
    SELECT run, min({{'doc_id': doc_id, 'k': k}}) AS first FROM windows GROUP BY run HAVING count(*) > 1
), gone AS (
    SELECT doc_id, list(DISTINCT spot) AS gone
    FROM (SELECT doc_id, unnest(range(k, k + 20)) AS spot FROM windows JOIN firsts USING (run)
          WHERE first <> {{'doc_id': doc_id, 'k': k}})
    GROUP BY doc_id
), kept AS (
    SELECT doc_id, w, coalesce(gone, []) AS gone FROM docs LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1),
           lambda k: NOT list_contains(gone, k)), lambda k: w[k]), ' ')) AS kept_sha256
FROM kept
"""

ORACLES["op5_line_dedup"] = rf"""
WITH docs AS (
    SELECT doc_id, string_split(text, chr(10)) AS every FROM documents
), filled AS (
    SELECT doc_id, every, list_filter(range(1, len(every) + 1),
        lambda p: regexp_matches(every[p], '[^\x20\x09-\x0D]')) AS places
    FROM docs
), lines AS (
    SELECT doc_id, every, places, list_transform(places, lambda p: every[p]) AS l FROM filled
), suffixes AS (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM lines
), runs AS (
    SELECT doc_id, k, size, md5(array_to_string(l[k:k + size - 1], chr(10))) AS run, l
    FROM (SELECT *, unnest([1, 2, 3, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) AS size FROM suffixes)
    WHERE k + size - 1 <= len(l)
), firsts AS (
    SELECT size, run, min({{'doc_id': doc_id, 'k': k}}) AS first FROM runs GROUP BY size, run HAVING count(*) > 1
), later AS (
    SELECT r.doc_id, r.k, r.size, f.first, r.l FROM runs r JOIN firsts f USING (size, run)
    WHERE f.first <> {{'doc_id': r.doc_id, 'k': r.k}}
), gone AS (
    SELECT doc_id, list(DISTINCT n) AS gone
    FROM (SELECT doc_id, unnest(range(k, k + size)) AS n FROM later
          WHERE size = 3 OR (size < 3 AND len(regexp_extract_all(
              array_to_string(l[k:k + size - 1], chr(10)), '[^\x20\x09-\x0D]+')) >= 20))
    GROUP BY doc_id
), best AS (
    SELECT doc_id, k, arg_max(first, size) AS first, max(size) AS size
    FROM later WHERE size <> 3 GROUP BY doc_id, k
), common AS (
    SELECT b.doc_id, max(n) AS longest
    FROM (SELECT *, unnest(range(size, 2 * size)) AS n FROM best) b
    JOIN lines x ON x.doc_id = b.doc_id
    JOIN lines y ON y.doc_id = b.first.doc_id
    WHERE b.k + n - 1 <= len(x.l) AND b.first.k + n - 1 <= len(y.l)
      AND x.l[b.k:b.k + n - 1] = y.l[b.first.k:b.first.k + n - 1]
    GROUP BY b.doc_id
)
SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, CAST(len(coalesce(g.gone, [])) AS BIGINT) AS n_removed,
       CAST(CASE WHEN g.gone IS NULL THEN 0 ELSE c.longest END AS BIGINT) AS longest_run,
       sha256(array_to_string(list_transform(list_filter(range(1, len(d.every) + 1),
           lambda p: g.gone IS NULL OR NOT list_contains(list_transform(g.gone, lambda n: d.places[n]), p)),
           lambda p: d.every[p]), chr(10))) AS kept_sha256
FROM lines d LEFT JOIN gone g USING (doc_id) LEFT JOIN common c USING (doc_id)
"""

ORACLES["op9_exact_top_k"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS terms
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op10_ngram_jaccard_join"] = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s
    FROM docs
), heads AS (  -- equal sets are linked, so one of them stands for all
    SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM heads
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, doc_id FROM heads
), reached AS (
    SELECT a, b FROM ways
    UNION
    SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a
), lowest AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
), classes AS (
    SELECT h.s AS s, l.component_id FROM heads h JOIN lowest l USING (doc_id)
)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, t.doc_id) AS component_id
FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s)
"""

ORACLES["op12_phrase_collocations"] = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k
          FROM words CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size))
), counts AS (
    SELECT lang, phrase, size, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, phrase, size
    HAVING count(*) >= 100
), candidates AS (
    SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1
), cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, 1000 * c.a * t.n // (l.f * r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')
    JOIN totals t ON t.lang = c.lang
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS around
    FROM (SELECT *, unnest(range(1, size - m + 2)) AS s
          FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates))
    GROUP BY 1, 2
), kept AS (
    SELECT l.* FROM lowest l LEFT JOIN inner_parts i ON i.lang = l.lang AND i.phrase = l.phrase
    WHERE i.around IS NULL OR 100 * i.around < 100 * l.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

#: The checksum of a string of ASCII signs, bit by bit; 3988292384 is the reversed polynomial.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, len({s}) + 1), lambda i: CAST(ascii(substr({s}, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384 + y))), 4294967295)"""

ORACLES["op13_conversation_prefix_trie"] = f"""
WITH own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), marked AS (
    SELECT conv_id, t, CAST(conv_id AS VARCHAR) AS s FROM own
), taken AS (
    SELECT conv_id, t, {_CRC32.format(s="s")} % 9 AS h FROM marked
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(d.t[1:c.h], c.t[1:0]), c.t[c.h + 1:len(c.t)]) AS t
    FROM taken c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 5
), members AS (
    SELECT conv_id, d AS depth, t[1:d] AS key, len(t) = d AS ends
    FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
    FROM members GROUP BY key, depth
), children AS (
    SELECT key[1:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), weighed AS (
    SELECT n.key, n.depth, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf,
           CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.key[n.depth].text) END AS saved
    FROM nodes n LEFT JOIN children c ON c.key = n.key
), below AS (
    SELECT key[1:d] AS key, sum(leaf) AS n_leaves, sum(saved) AS saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM weighed) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id,
       CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
       sha256(n.ended) AS ends_sha256
FROM nodes n
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
LEFT JOIN children c ON c.key = n.key
JOIN below b ON b.key = n.key
"""
