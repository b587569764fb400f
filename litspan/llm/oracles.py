"""SQL for DuckDB that gives the same rows as the queries that SQL can express: all pairs, all places, no method."""

from __future__ import annotations

from litspan.llm.licenses import BASE, COVER, DRIFT, GRAM, NEAR, TEMPLATES, words_of
from litspan.llm.urls import ORACLE as URLS

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
walk AS (SELECT vec_id AS x, vec_id AS node FROM v UNION SELECT w.x, p.y FROM walk w JOIN p ON p.x = w.node),
c AS (SELECT x, min(node) AS component_id FROM walk GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

DOCUMENTS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS grams FROM w),
c AS (SELECT grams, min(doc_id) AS class_id, count(*) AS copies FROM s WHERE len(grams) > 0 GROUP BY grams),
u AS (SELECT class_id, copies, len(grams) AS size, unnest(grams) AS gram FROM c),
j AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS shared, any_value(a.size) AS m, any_value(b.size) AS n, any_value(b.copies) AS copies FROM u a JOIN u b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY ALL),
p AS (SELECT * FROM j WHERE 5 * shared >= 4 * (m + n - shared)),
walk AS (SELECT class_id AS x, class_id AS node FROM c UNION SELECT w.x, p.y FROM walk w JOIN p ON p.x = w.node),
g AS (SELECT x, min(node) AS component_id FROM walk GROUP BY x), l AS (SELECT x, sum(copies) AS more FROM p GROUP BY x)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, CAST(coalesce(c.copies - 1 + coalesce(l.more, 0), 0) AS BIGINT) AS n_links, coalesce(g.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(g.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.grams = s.grams LEFT JOIN g ON g.x = c.class_id LEFT JOIN l ON l.x = c.class_id
"""


def _licenses() -> str:
    grams = []
    for label, text in TEMPLATES.items():
        words = words_of(text)
        grams += [f"('{label}', {i}, {len(words) - GRAM + 1}, '{' '.join(words[i : i + GRAM])}')" for i in range(len(words) - GRAM + 1)]
    places = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label FROM g WHERE " + " AND ".join(f"w{k} = '{word}'" for k, word in enumerate(phrase.split())) for phrase, label in BASE.items()
    )
    return rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS line FROM documents),
s AS (SELECT doc_id, CASE WHEN line = '' THEN [] ELSE string_split(line, ' ') END AS words FROM t),
g AS (SELECT doc_id, unnest(range(0, len(words))) AS pos, unnest(words) AS w0, unnest(words[2:] || ['']) AS w1, unnest(words[3:] || ['', '']) AS w2 FROM s WHERE len(words) > 2
    UNION ALL SELECT doc_id, 0, words[1], coalesce(words[2], ''), '' FROM s WHERE len(words) IN (1, 2)),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM ({places}) GROUP BY doc_id),
m(label, place, size, gram) AS (VALUES {", ".join(grams)}),
votes AS (SELECT doc_id, label, pos - place AS diagonal, any_value(size) AS size, min(pos) AS lo, max(pos) AS hi, list(DISTINCT place) AS places FROM g JOIN m ON gram = w0 || ' ' || w1 || ' ' || w2 GROUP BY doc_id, label, diagonal),
apart AS (SELECT *, CASE WHEN lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {DRIFT} OR lo > lag(hi) OVER o + size OR hi + size < lag(lo) OVER o THEN 1 ELSE 0 END AS new FROM votes WINDOW o AS (PARTITION BY doc_id, label ORDER BY diagonal)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS run FROM apart),
merged AS (SELECT doc_id, label, any_value(size) AS size, min(lo) AS lo, max(hi) AS hi, len(list_distinct(flatten(list(places)))) AS voted FROM runs GROUP BY doc_id, label, run),
fits AS (SELECT *, voted / size AS cover FROM merged WHERE voted / size >= {COVER} AND voted / (hi - lo + 1) >= 0.5),
best AS (SELECT *, max(cover) OVER (PARTITION BY doc_id ORDER BY lo RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) AS most FROM fits),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover FROM best WHERE cover >= most GROUP BY doc_id)
SELECT s.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, array_to_string(coalesce(base.labels, []), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(more.labels, []))), ',') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(cover, 0) END AS DOUBLE) AS score
FROM s LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""

AUDIT = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS k FROM documents),
w AS (SELECT lang, source, k, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
full_p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.terms) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 2)) // (v.total + 2 * v.terms) AS q
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
best AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM full_p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM every
    UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM best) WHERE rank <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
SEARCH = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES = {"op1_embedding_near_dedup": VECTORS, "op2_url_filter": URLS, "op3_license_scan": _licenses(), "op8_jaccard_join": DOCUMENTS, "op12_source_divergence": AUDIT, "op13_lexical_search": SEARCH}
