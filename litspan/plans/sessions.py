"""Conversations replayed through a session's handlers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspan.operators import handlers
from litspan.plans.navigation import TITLE
from litspan.plans.registering import query
from litspan.settings import Settings
from litspan.sources.tables import table

SMALL = Settings(prefetch=7, page_size=4, loaded_most=25)  # so that short lists are loaded in parts, too
KIND = "(conv_id * 7 + turn * turn + turn * (conv_id % 5)) % 10"
LANGS = ("en", "de", "fr", "es", "xx")
#: More rows loaded, in chunks of seven, until ``{n}`` are there or all.
ENSURED = "CASE WHEN {n} > loaded AND loaded < fin THEN least(fin, loaded + 7 * CAST(ceil(({n} - loaded) / 7.0) AS INT)) ELSE loaded END"


def _replayed() -> str:
    """DuckDB: the same sessions by recursion, with a list as arrays and what a title or an author needs as counts over them."""
    new = "least(7, 25, coalesce(nt, 0))"
    page = "greatest(0, least(4, {loaded} - {start}))"
    ahead = ENSURED.format(n="(cur + 8)")
    at = ENSURED.format(n="idx")
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, lang, source, substring(text, 1, 30) AS title, {TITLE.format(x='substring(text, 1, 30)')} AS k FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS position FROM (SELECT 'lang:' || lang AS query, * FROM d UNION ALL SELECT DISTINCT ON (doc_id, query) 'source:' || unnest([source, source[:4]]) AS query, * FROM d)),
    lists AS (SELECT query, count(*)::INT AS total, list(CAST(doc_id AS VARCHAR) ORDER BY position) FILTER (position <= 25) AS papers, list(k ORDER BY position) FILTER (position <= 25) AS keys, list(source ORDER BY position) FILTER (position <= 25) AS names FROM l GROUP BY query),
    turns AS (SELECT conv_id, turn, kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE kind WHEN 7 THEN 'yes' WHEN 8 THEN 'no' ELSE 'other' END AS answer, CASE WHEN kind < 2 THEN 'search' WHEN kind < 4 THEN 'next' WHEN kind < 7 THEN 'open' ELSE 'chat' END AS action,
        CASE WHEN kind < 2 THEN 'lang:' || ({list(LANGS)!r})[CAST((conv_id + turn) % 5 AS INT) + 1] WHEN kind = 6 THEN 'source:src' || (conv_id + turn) % 23 END AS query, CASE WHEN kind = 6 THEN 'src' || (conv_id + turn) % 23 END AS author,
        CASE WHEN kind = 4 THEN CAST(1 + (turn * 5 + conv_id) % 30 AS INT) END AS idx, CASE WHEN kind = 5 THEN {TITLE.format(x='substring(t.text, 3, 12)')} END AS wanted
        FROM (SELECT *, CAST({KIND} AS INT) AS kind FROM conversations) c LEFT JOIN (SELECT doc_id, text FROM documents) t ON t.doc_id = (c.conv_id * 3 + c.turn) % 200),
    walk AS (SELECT conv_id, 0::BIGINT AS n, NULL::BIGINT AS turn, NULL::VARCHAR AS q, 0::INT AS total, 0::INT AS loaded, 0::INT AS cur, 0::INT AS plen, NULL::VARCHAR AS pend, ''::VARCHAR AS outcome, NULL::VARCHAR AS paper, NULL::INT AS start, 0::INT AS shown FROM (SELECT DISTINCT conv_id FROM turns)
        UNION ALL
        SELECT conv_id, n, turn, CASE WHEN ev IN ('run', 'search') THEN nq ELSE q END, CASE WHEN ev IN ('run', 'search') THEN coalesce(nt, 0) ELSE total END,
            CASE ev WHEN 'run' THEN {new} WHEN 'search' THEN {new} WHEN 'next' THEN CASE WHEN cur + 4 >= total THEN loaded ELSE ahead END WHEN 'index' THEN CASE WHEN idx <= plen THEN loaded ELSE reach END WHEN 'title' THEN CASE WHEN wanted = '' THEN loaded ELSE l1 END ELSE loaded END,
            CASE WHEN ev IN ('run', 'search') THEN 0 WHEN ev = 'next' AND cur + 4 < total AND cur + 4 < ahead THEN cur + 4 ELSE cur END,
            CASE WHEN ev IN ('run', 'search') THEN {page.format(loaded=new, start='0')} WHEN ev = 'next' AND cur + 4 < total AND cur + 4 < ahead THEN {page.format(loaded='ahead', start='(cur + 4)')} ELSE plen END,
            CASE WHEN ev = 'context' AND pc = 0 AND lc = 0 THEN query END,
            CASE ev WHEN 'run' THEN 'list' WHEN 'search' THEN 'list' WHEN 'next' THEN CASE WHEN cur + 4 >= total OR cur + 4 >= ahead THEN 'no-more' ELSE 'list' END WHEN 'index' THEN CASE WHEN idx <= plen OR idx <= reach THEN 'open' ELSE 'beyond' END
                WHEN 'title' THEN CASE WHEN wanted = '' THEN 'usage' WHEN NOT hit THEN 'no-title' WHEN e0 <= l1 OR within = 1 THEN 'open' ELSE 'choices' END
                WHEN 'context' THEN CASE WHEN pc = 1 OR (pc = 0 AND lc = 1) THEN 'open' WHEN pc + lc = 0 THEN 'ask-new' ELSE 'choices' END ELSE ev END,
            CASE ev WHEN 'index' THEN CASE WHEN idx <= plen THEN papers[cur + idx] WHEN idx <= reach THEN papers[idx] END WHEN 'title' THEN CASE WHEN wanted <> '' AND hit THEN CASE WHEN e0 <= l1 THEN papers[e0] WHEN within = 1 THEN papers[p0] END END
                WHEN 'context' THEN CASE WHEN pc = 1 THEN papers[cur + list_position(list_transform(names[cur + 1:cur + plen], lambda x: contains(x, author)), true)] WHEN pc = 0 AND lc = 1 THEN papers[list_position(list_transform(names[:loaded], lambda x: contains(x, author)), true)] END END,
            CASE WHEN ev IN ('run', 'search') THEN 0 WHEN ev = 'next' AND cur + 4 < total AND cur + 4 < ahead THEN cur + 4 END,
            CASE WHEN ev IN ('run', 'search') THEN {page.format(loaded=new, start='0')} WHEN ev = 'next' AND cur + 4 < total AND cur + 4 < ahead THEN {page.format(loaded='ahead', start='(cur + 4)')} WHEN ev = 'index' AND (idx <= plen OR idx <= reach) THEN 1
                WHEN ev = 'title' AND wanted <> '' AND hit THEN CASE WHEN e0 <= l1 OR within = 1 THEN 1 ELSE least(5, within) END WHEN ev = 'context' THEN CASE WHEN pc > 0 THEN least(10, pc) ELSE least(10, lc) END ELSE 0 END
        FROM (SELECT *, len(list_filter(keys[:l1], lambda x: x <> '' AND contains(x, wanted)))::INT AS within FROM (
            SELECT *, CASE WHEN hit THEN CASE WHEN p0 <= loaded THEN loaded ELSE least(fin, loaded + 7 * CAST(ceil((p0 - loaded) / 7.0) AS INT)) END ELSE CASE WHEN loaded < fin THEN least(fin, loaded + 35) ELSE loaded END END AS l1 FROM (
            SELECT *, {ahead} AS ahead, {at} AS reach, coalesce(p0 <= fin AND p0 <= loaded + 28, false) AS hit, len(list_filter(names[cur + 1:cur + plen], lambda x: contains(x, author)))::INT AS pc, len(list_filter(names[:loaded], lambda x: contains(x, author)))::INT AS lc FROM (
            SELECT v.*, a.papers, a.names, a.keys, b.total AS nt, least(v.total, 25) AS fin, list_position(a.keys, v.wanted)::INT AS e0, list_position(list_transform(a.keys, lambda x: x <> '' AND contains(x, v.wanted)), true)::INT AS p0 FROM (
            SELECT *, CASE ev WHEN 'run' THEN pend WHEN 'search' THEN query END AS nq FROM (
            SELECT w.conv_id, t.n, t.turn, w.q, w.total, w.loaded, w.cur, w.plen, w.pend, t.query, t.author, t.idx, t.wanted, CASE WHEN pend IS NOT NULL AND answer = 'yes' THEN 'run' WHEN pend IS NOT NULL AND answer = 'no' THEN 'stay' WHEN action = 'search' THEN 'search'
                WHEN action IN ('next', 'open') AND q IS NULL THEN 'no-search' WHEN action = 'next' THEN 'next' WHEN idx IS NOT NULL THEN 'index' WHEN wanted IS NOT NULL THEN 'title' WHEN author IS NOT NULL AND loaded > 0 THEN 'context' WHEN action = 'open' THEN 'usage' ELSE 'chat' END AS ev
            FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.n = w.n + 1)) v LEFT JOIN lists a ON a.query = v.q LEFT JOIN lists b ON b.query = v.nq)))))
    SELECT conv_id, turn, outcome, paper, start, shown, loaded, pend AS waiting FROM walk WHERE n > 0"""


@query(_replayed())
def session_handlers(spark, sf_dir):
    """E6, U8, K4, K6, ST8: every conversation through search, next, open by number, title or author, and a search that waits for a yes; a list is loaded in parts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    row = docs.select(F.col("doc_id").alias("paper"), F.substring("text", 1, 30).alias("title"), F.col("source").alias("authors"), "lang")
    names = F.array_distinct(F.array("authors", F.substring("authors", 1, 4)))
    keyed = row.select(F.explode(F.concat(F.array(F.concat(F.lit("lang:"), "lang")), F.transform(names, lambda n: F.concat(F.lit("source:"), n)))).alias("query"), "paper", "title", "authors")
    placed = keyed.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("paper")))
    c, t = F.col("conv_id"), F.col("turn")
    kind = (c * 7 + t * t + t * (c % 5)) % 10
    other = F.concat(F.lit("src"), ((c + t) % 23).cast("string"))
    lang = F.get(F.array(*[F.lit(x) for x in LANGS]), ((c + t) % 5).cast("int"))
    asked = table(spark, sf_dir, "conversations").join(docs.select(F.col("doc_id").alias("__d"), F.substring("text", 3, 12).alias("__t")), F.col("__d") == (c * 3 + t) % 200, "left")
    turns = asked.select(
        c.alias("session"), "turn", F.when(kind == 7, "yes").when(kind == 8, "no").otherwise("other").alias("answer"), F.when(kind < 2, "search").when(kind < 4, "next").when(kind < 7, "open").otherwise("chat").alias("action"),
        F.when(kind < 2, F.concat(F.lit("lang:"), lang)).when(kind == 6, F.concat(F.lit("source:"), other)).alias("query"), F.when(kind == 6, other).alias("author"),
        F.when(kind == 4, (1 + (t * 5 + c) % 30).cast("int")).alias("index"), F.when(kind == 5, F.col("__t")).alias("title"),
    )
    done = handlers.replay(turns, handlers.lists(placed, SMALL.loaded_most), settings=SMALL)
    return done.withColumnRenamed("session", "conv_id")
