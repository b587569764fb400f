"""Queries of operators whose inputs (bibliographies, Markdown, layouts, feeds, model replies) the tables don't hold as such: Spark derives them from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators import chunking, headings, layout
from litspan.operators import navigation as N
from litspan.operators import qa as Q
from litspan.operators import references as B
from litspan.operators import sections as X
from litspan.operators import state as S
from litspan.plans import ingest as I
from litspan.plans.documents import BLANKS, chunk_sql
from litspan.plans.registering import ORACLES, query
from litspan.sources.feed import papers, pdf_url
from litspan.sources.files import pdf_error
from litspan.sources.tables import table

#: Each document's lines of letters: number k, text c, and how many there are.
CLEAN = """cl AS (SELECT doc_id, k0, c FROM (SELECT doc_id, generate_subscripts(parts, 1) AS k0, trim(substring(trim(regexp_replace(unnest(parts), '[^A-Za-z]+', ' ', 'g')), 1, 40)) AS c
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE length(c) >= 5),
    l AS (SELECT * FROM (SELECT doc_id, c, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k0) AS INT) AS k, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM cl) WHERE n_lines >= 3)"""


def _clean(spark, sf_dir) -> DataFrame:
    """doc_id, ``c``: the array of a document's lines of letters, three at least."""
    words = lambda x: F.trim(F.substring(F.trim(F.regexp_replace(x, "[^A-Za-z]+", " ")), 1, 40))
    lines = F.filter(F.transform(F.split("text", "\n"), words), lambda x: F.length(x) >= 5)
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("c")).where(F.size("c") >= 3)


# bibliographies: by the document's number in brackets, with dots, with parentheses, by author and year, or as they are; the fourth number isn't plausible, and after the eighth a run begins anew

NUMBER = "CASE WHEN k = 4 THEN 9999 WHEN k > 8 THEN k + 5 WHEN k > 4 THEN k - 1 ELSE k END"
BIB = f"""{CLEAN}, bib AS (SELECT doc_id, k, {NUMBER} AS n, CASE doc_id % 5 WHEN 0 THEN '[' || {NUMBER} || '] ' || c WHEN 1 THEN {NUMBER} || '. ' || c WHEN 2 THEN {NUMBER} || ') ' || c
        WHEN 3 THEN 'Smith, J. (' || (1990 + k % 30) || '). ' || c ELSE c END AS t FROM l),
    votes AS (SELECT doc_id, count(*) FILTER (regexp_matches(t, '^\\[[0-9]+\\]\\s')) AS b, count(*) FILTER (regexp_matches(t, '^[0-9]+\\.\\s')) AS d, count(*) FILTER (regexp_matches(t, '^[0-9]+\\)\\s')) AS p,
        count(*) FILTER (regexp_matches(t, '^Smith, J\\. \\([0-9]')) AS a FROM bib WHERE k <= 80 GROUP BY doc_id),
    styled AS (SELECT doc_id, CASE WHEN greatest(b, d, p, a) < 2 THEN 'unknown' WHEN b = greatest(b, d, p, a) THEN 'bracket' WHEN d = greatest(b, d, p, a) THEN 'plain-dot' WHEN p = greatest(b, d, p, a) THEN 'plain-paren' ELSE 'author-year' END AS style FROM votes),
    opened AS (SELECT doc_id, style, k, n, t, n BETWEEN 1 AND 4999 AS ok, sum((n BETWEEN 1 AND 4999)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS entry FROM bib JOIN styled USING (doc_id) WHERE style IN ('bracket', 'plain-dot', 'plain-paren')),
    entries AS (SELECT doc_id, style, entry, CAST(max(CASE WHEN ok THEN n END) AS INT) AS idx, string_agg(t, ' ' ORDER BY k) FILTER (ok OR style <> 'bracket') AS raw_text FROM opened GROUP BY doc_id, style, entry),
    islands AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY entry) AS island, count(*) OVER (PARTITION BY doc_id) AS every FROM entries),
    runs AS (SELECT doc_id, style, every, island, count(*) AS n, max(idx) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(entry)) AS r FROM islands GROUP BY doc_id, style, every, island),
    kept AS (SELECT i.doc_id, i.style, i.idx, i.raw_text FROM islands i JOIN runs r ON r.doc_id = i.doc_id AND r.island = i.island AND r.r = 1)"""


def _bibliographies(spark, sf_dir) -> DataFrame:
    def line(c: Column, i: Column) -> Column:
        k, d = i + 1, F.col("doc_id") % 5
        n = F.when(k == 4, 9999).when(k > 8, k + 5).when(k > 4, k - 1).otherwise(k).cast("string")
        named = F.concat(F.lit("Smith, J. ("), (1990 + k % 30).cast("string"), F.lit("). "), c)
        return F.when(d == 0, F.concat(F.lit("["), n, F.lit("] "), c)).when(d == 1, F.concat(n, F.lit(". "), c)).when(d == 2, F.concat(n, F.lit(") "), c)).when(d == 3, named).otherwise(c)

    return _clean(spark, sf_dir).select("doc_id", F.array_join(F.transform("c", line), "\n").alias("text"))


@query(f"WITH {BIB} SELECT doc_id, style FROM styled")
def ref_style_vote(spark, sf_dir):
    """The style of each document's bibliography."""
    return _bibliographies(spark, sf_dir).select("doc_id", B.style(F.col("text")).alias("style"))


def _entries(spark, sf_dir, *styles: str) -> DataFrame:
    entries, _ = B.parse(_bibliographies(spark, sf_dir), "doc_id")
    return entries.where(F.col("style").isin(*styles))


@query(f"WITH {BIB} SELECT doc_id, idx, raw_text FROM kept WHERE style <> 'bracket'")
def ref_entries_dot(spark, sf_dir):
    """Numbered entries of the longest run; a line with an implausible number continues the entry."""
    return _entries(spark, sf_dir, "plain-dot", "plain-paren").select("doc_id", "idx", "raw_text")


@query(f"WITH {BIB} SELECT doc_id, idx, raw_text FROM kept WHERE style = 'bracket'")
def ref_entries_bracket(spark, sf_dir):
    """Bracketed entries; an implausible number ends the one before and is none."""
    return _entries(spark, sf_dir, "bracket").select("doc_id", "idx", "raw_text")


@query(f"WITH {BIB} SELECT doc_id, t AS raw_text FROM bib JOIN styled USING (doc_id) WHERE style = 'author-year' AND length(t) >= 20")
def ref_entries_authoryear(spark, sf_dir):
    """Entries by author and year."""
    return _entries(spark, sf_dir, "author-year").select("doc_id", "raw_text")


@query(f"""WITH {BIB} SELECT doc_id, style, n AS n_refs, round(least(0.99, 0.65 + 0.25 * n / every + CASE WHEN n >= 5 THEN 0.2 ELSE 0.05 END), 6)::DOUBLE AS confidence, last AS last_number FROM runs WHERE r = 1
    UNION ALL SELECT doc_id, style, count(*), round(least(0.95, 0.55 + 0.01 * count(*)), 6)::DOUBLE, NULL FROM bib JOIN styled USING (doc_id) WHERE style = 'author-year' AND length(t) >= 20 GROUP BY doc_id, style""")
def ref_summary(spark, sf_dir):
    """X6, X6d: style, count, confidence and last number of each bibliography."""
    _, summary = B.parse(_bibliographies(spark, sf_dir), "doc_id")
    return summary.select("doc_id", "style", F.col("count").alias("n_refs"), F.round("confidence", 6).alias("confidence"), F.col("last_reference_number").alias("last_number"))


TITLED = "CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'VII. References' WHEN 1 THEN '12 Works Cited' WHEN 2 THEN 'b) Literature cited' WHEN 3 THEN NULL ELSE substring(text, 1, 20) END"


def _bare(x: str) -> str:
    out = f"lower(trim({x}, {BLANKS}))"
    for pattern in B.HEADING_PREFIXES:
        out = f"trim(regexp_replace({out}, '{pattern}', ''), {BLANKS})"
    return out


@query(f"""SELECT paper, min(section_index) AS section_index FROM (SELECT doc_id % 50 AS paper, CAST(doc_id // 50 AS INT) AS section_index, {_bare(TITLED)} AS h FROM documents)
    WHERE {' OR '.join(f"contains(h, '{t}')" for t in B.TERMS)} GROUP BY paper""")
def ref_section_find(spark, sf_dir):
    """the first reference section of each paper."""
    d = F.col("doc_id") % 7
    heading = F.when(d == 0, "VII. References").when(d == 1, "12 Works Cited").when(d == 2, "b) Literature cited").when(d > 3, F.substring("text", 1, 20))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("paper"), F.floor(F.col("doc_id") / 50).cast("int").alias("section_index"), heading.alias("heading_text"))
    return B.reference_section(rows, "paper").select("paper", "section_index")


# Markdown: lines become headings of three levels, rules or text

MARKED = f"""{CLEAN}, r AS (SELECT doc_id, k - 1 AS idx, c, n_lines AS n, least(60, CASE WHEN doc_id % 3 = 0 THEN 50 + doc_id % 40 ELSE 1 + doc_id % 7 END) AS p, (doc_id + k) % 6 AS m FROM l),
    pg AS (SELECT *, greatest(1, idx // greatest(1, n // p) + 1) AS page, m = 3 AS rule, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS level FROM r),
    s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY idx) AS sec, last_value(CASE WHEN level = 1 THEN idx END IGNORE NULLS) OVER w AS i1, last_value(CASE WHEN level = 1 THEN c END IGNORE NULLS) OVER w AS t1,
        last_value(CASE WHEN level = 2 THEN idx END IGNORE NULLS) OVER w AS i2, last_value(CASE WHEN level = 2 THEN c END IGNORE NULLS) OVER w AS t2 FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT doc_id, sec, max(level) AS lvl, max(CASE WHEN level IS NOT NULL THEN c END) AS head, max(CASE level WHEN 3 THEN CASE WHEN i2 > coalesce(i1, -1) THEN t2 ELSE t1 END WHEN 2 THEN t1 END) AS parent, min(page) AS ps,
        arg_max(CASE WHEN rule THEN least(page + 1, p) ELSE page END, idx) AS last_page, coalesce(string_agg(CASE WHEN level IS NULL AND NOT rule THEN c END, chr(10) ORDER BY idx), '') AS content FROM s GROUP BY doc_id, sec),
    w AS (SELECT *, coalesce(lead(ps) OVER (PARTITION BY doc_id ORDER BY sec), last_page) AS pe, max(sec) OVER (PARTITION BY doc_id) AS heads FROM g)"""


@query(f"""WITH {MARKED} SELECT doc_id AS paper, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS section_index, coalesce(lvl, 0) AS heading_level, coalesce(head, '') AS heading_text, parent AS parent_heading,
    CAST(CASE WHEN sec = 0 THEN 1 ELSE ps END AS INT) AS page_start, CAST(pe AS INT) AS page_end, content AS content_text FROM w WHERE heads > 0 AND content <> ''""")
def markdown_sections(spark, sf_dir):
    """Sections of Markdown, with levels, parents and estimated pages."""

    def line(c: Column, i: Column) -> Column:
        m = (F.col("doc_id") + i + 1) % 6
        return F.when(m == 0, F.concat(F.lit("# "), c)).when(m == 1, F.concat(F.lit("## **"), c, F.lit("**"))).when(m == 2, F.concat(F.lit("### "), c)).when(m == 3, F.lit("---")).otherwise(c)

    marked = _clean(spark, sf_dir).select(F.col("doc_id").alias("paper"), F.when(F.col("doc_id") % 3 == 0, 50 + F.col("doc_id") % 40).otherwise(1 + F.col("doc_id") % 7).cast("int").alias("total_pages"), F.array_join(F.transform("c", line), "\n").alias("markdown"))
    return X.from_markdown(marked).select("paper", "section_index", "heading_level", "heading_text", "parent_heading", "page_start", "page_end", "content_text")


@query("""SELECT paper, coalesce(string_agg(repeat('  ', level - 1) || '- ' || source || '  (page ' || page || ')', chr(10) ORDER BY doc_id) FILTER (level <= 2), '') AS shown, count(*) AS levels
    FROM (SELECT doc_id % 50 AS paper, doc_id, source, CAST(1 + doc_id // 7 % 3 AS INT) AS level, doc_id // 50 + 1 AS page FROM documents WHERE doc_id % 4 <> 0) GROUP BY paper""")
def heading_outline(spark, sf_dir):
    """Heading trees as JSON and back, without blank texts, and their outlines."""
    d = F.col("doc_id")
    node = F.struct((1 + F.floor(d / 7) % 3).cast("int").alias("level"), F.when(d % 4 == 0, " ").otherwise(F.col("source")).alias("text"), (F.floor(d / 50) + 1).cast("int").alias("page"))
    trees = table(spark, sf_dir, "documents").groupBy((d % 50).alias("paper")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", node.alias("h")))), lambda x: x["h"]).alias("t"))
    again = trees.select("paper", T.headings_from_json(T.headings_json(F.col("t"))).alias("t")).where(F.size("t") > 0)
    return again.select("paper", T.outline(T.display_outline(F.col("t"))).alias("shown"), F.size("t").cast("long").alias("levels"))


# pages of blocks: lines of an order, left or right, some across

PLACED = f"""b AS (SELECT l_orderkey AS page, l_linenumber AS block, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 50.0 WHEN l_linenumber % 2 = 1 THEN 50.0 + min(l_quantity) % 3 ELSE 320.0 END AS x0,
        20.0 * l_linenumber + min(l_suppkey) % 47 AS y0, 'b' || l_linenumber || ' ' || min(l_suppkey) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber),
    s AS (SELECT *, CASE WHEN block = 1 AND page % 3 = 0 THEN 560.0 ELSE x0 + 230 END AS x1 FROM b), nar AS (SELECT *, x1 - x0 <= 612.0 * {layout.FULL} AS narrow FROM s),
    e AS (SELECT page, x0, lead(x0) OVER (PARTITION BY page ORDER BY x0) AS nx FROM (SELECT DISTINCT page, x0 FROM nar WHERE narrow)),
    best AS (SELECT page, arg_max(nx - x0, (nx - x0, -(nx + x0) / 2)) AS gap, arg_max((nx + x0) / 2, (nx - x0, -(nx + x0) / 2)) AS mid FROM e WHERE nx IS NOT NULL GROUP BY page),
    told AS (SELECT n.page, coalesce(count(*) FILTER (narrow) >= {layout.LEAST_BLOCKS} AND any_value(gap) > 612.0 * {layout.GAP} AND any_value(mid) BETWEEN 612.0 * {layout.LEFT} AND 612.0 * {layout.RIGHT}
        AND count(*) FILTER (narrow AND x0 < mid) >= {layout.LEAST_SIDE} AND count(*) FILTER (narrow AND x0 >= mid) >= {layout.LEAST_SIDE}, false) AS two, any_value(mid) AS mid FROM nar n LEFT JOIN best USING (page) GROUP BY n.page)"""


def _blocks(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block")).agg(F.min("l_quantity").alias("q"), F.min("l_suppkey").alias("s"))
    wide = (F.col("block") == 1) & (F.col("page") % 3 == 0)
    x0 = F.when(wide, 50.0).when(F.col("block") % 2 == 1, 50.0 + F.col("q") % 3).otherwise(320.0)
    text = F.concat(F.lit("b"), F.col("block").cast("string"), F.lit(" "), F.col("s").cast("string"))
    placed = own.select("page", "block", x0.alias("x0"), (20.0 * F.col("block") + F.col("s") % 47).alias("y0"), text.alias("text"), F.lit(612.0).alias("page_w"), wide.alias("wide"))
    return placed.select("*", F.when(F.col("wide"), 560.0).otherwise(F.col("x0") + 230).alias("x1"), (F.col("y0") + 10).alias("y1")).drop("wide")


@query(f"""WITH {PLACED} SELECT page, two AS two_columns, string_agg(t, chr(10) ORDER BY side, y0, across, block) AS body FROM (
    SELECT n.*, two, CASE WHEN NOT two OR NOT narrow THEN 0 WHEN x0 < mid THEN 1 ELSE 2 END AS side, CASE WHEN two THEN 0.0 ELSE x0 END AS across FROM nar n JOIN told USING (page)) GROUP BY page, two""")
def columns_detect(spark, sf_dir):
    """Columns and reading order of pages."""
    return layout.page_texts(_blocks(spark, sf_dir), ["page"]).select("page", "two_columns", F.col("text").alias("body"))


@query(f"WITH {PLACED} SELECT page % 97 AS paper, CASE WHEN avg(two::INT) > 0.3 THEN 'two-column' ELSE 'single-column' END AS layout FROM told GROUP BY page % 97")
def paper_layout(spark, sf_dir):
    """Each paper's layout."""
    pages = layout.columns(_blocks(spark, sf_dir), ["page"]).select((F.col("page") % 97).alias("paper"), "two_columns")
    return layout.paper_layout(pages)


# feeds, links and bytes, from pages

ENTRY = "CASE CAST(page_id % 3 AS INT) WHEN 2 THEN 'plain' || page_id ELSE 'http://c.org/abs/' || page_id || 'v2' END"


@query(f"""SELECT page_id, split_part(split_part(id, '/abs/', -1), 'v', 1) AS paper_id, trim(replace(url || chr(10) || 'b', chr(10), ' ')) AS title, CASE CAST(page_id % 3 AS INT) WHEN 0 THEN 'http://c.org/pdf/' || page_id WHEN 1 THEN 'http://c.org/pdf/' || page_id || 'v2.pdf' ELSE id END AS pdf,
    'cs.' || page_id % 4 || ',cs.CL' AS categories, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Ann,Bo' END AS authors FROM (SELECT *, {ENTRY} AS id FROM pages)""")
def feed_normalize(spark, sf_dir):
    """Feed entries of pages as papers."""
    n = F.col("page_id")
    number = n.cast("string")
    entry = F.when(n % 3 == 2, F.concat(F.lit("plain"), number)).otherwise(F.concat(F.lit("http://c.org/abs/"), number, F.lit("v2")))
    link = lambda kind, href: F.struct(kind.alias("type"), href.alias("href"))
    links = F.when(n % 3 == 0, F.array(link(F.lit("text/html"), entry), link(F.lit("application/pdf"), F.concat(F.lit("http://c.org/pdf/"), number)))).otherwise(F.array(link(F.lit("text/html"), entry)))
    person = lambda name: F.struct(F.lit(name).alias("name"))
    names = F.array(F.when(n % 5 == 0, person("  ")).otherwise(person("Ann ")), F.when(n % 5 == 0, person("")).otherwise(person(" Bo")))
    tags = F.array(*[F.struct(c.alias("term")) for c in (F.concat(F.lit("cs."), (n % 4).cast("string")), F.lit("cs.CL"), F.lit(""), F.lit("cs.CL"))])
    entries = table(spark, sf_dir, "pages").select(
        "page_id", entry.alias("id"), F.concat(F.lit(" "), "url", F.lit("\nb ")).alias("title"), F.lit(" s\nt ").alias("summary"), F.lit("2020-01-02T00:00:00Z").alias("published"), F.lit("").alias("updated"),
        entry.alias("link"), names.alias("authors"), links.alias("links"), tags.alias("tags"),
    )
    found = papers(entries).join(entries.select("id", "page_id"), "id")
    return found.select("page_id", "paper_id", "title", F.col("pdf_url").alias("pdf"), F.array_join("categories", ",").alias("categories"), F.array_join("authors", ",").alias("authors"))


@query("""SELECT page_id, coalesce(nullif(CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '.pdf' WHEN 4 THEN '' ELSE 'https://catalogue.example/pdf/' || page_id || '.pdf' END, ''), '') AS resolved_pdf_url FROM pages""")
def pdf_url_resolve(spark, sf_dir):
    """Where a paper's PDF is: the first name that tells it, else the template."""
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.when(n % 5 == 4, "").otherwise(n.cast("string")).alias("paper_id"), F.when(n % 5 == 0, F.col("url")).alias("pdf_url"),
        F.when(n % 5 == 1, F.concat(F.lit(" "), "url", F.lit(".pdf "))).otherwise("").alias("pdf"), F.when(n % 5 == 0, "not this").alias("pdfLink"),
    )
    return pdf_url(rows).select("page_id", "resolved_pdf_url")


@query("""SELECT page_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Response is not a PDF' WHEN 2 THEN 'Empty response body' WHEN 3 THEN 'PDF not found (404)' WHEN 4 THEN 'Server error (503)' WHEN 5 THEN 'Rate limited (429)'
    WHEN 6 THEN 'Access denied (403)' ELSE 'HTTP 302' END AS error FROM pages""")
def pdf_validation(spark, sf_dir):
    """Which answers hold a PDF."""
    n = F.col("page_id") % 8
    body = F.when(n == 0, F.concat(F.lit("%PDF-1.7"), "html")).when(n == 1, F.concat(F.lit("<p>"), "html")).when(n == 2, "").cast("binary")
    status = F.when(n < 3, 200).when(n == 3, 404).when(n == 4, 503).when(n == 5, 429).when(n == 6, 403).otherwise(302)
    return table(spark, sf_dir, "pages").select("page_id", pdf_error(body, status).alias("error"))


# what a model replies, and how a session's messages are routed

@query("""SELECT conv_id, turn, CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'search' WHEN 1 THEN 'chat' END AS action, CASE WHEN turn % 3 = 0 THEN CAST(1990 + conv_id % 30 AS INT) END AS year FROM conversations""")
def intent_json(spark, sf_dir):
    """JSON in a model's reply, fenced, amid words, or not there."""
    fenced = F.concat(F.lit('```json\n{"action": "search", "from_year": '), (1990 + F.col("conv_id") % 30).cast("string"), F.lit("}\n```"))
    said = F.regexp_replace("text", "[{}]", "")
    reply = F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, F.concat(said, F.lit(': {"action": "chat"} '), said)).otherwise(said)
    found = T.safe_json(T.strip_fences(reply), "action string, from_year int")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found["action"].alias("action"), found["from_year"].alias("year"))


HAS = lambda words, x: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(f"""SELECT conv_id, turn, CASE WHEN a = 'reset' AND NOT {HAS(N.RESET_WORDS, 'm')} THEN 'chat' WHEN a = 'ask' AND conv_id % 2 = 1 THEN 'chat' ELSE a END AS action FROM (
    SELECT conv_id, turn, lower(trim(CASE WHEN conv_id % 3 = 0 THEN 'please clear ' ELSE '' END || text, {BLANKS})) AS m, CASE CAST(turn % 4 AS INT) WHEN 0 THEN 'reset' WHEN 1 THEN 'ask' WHEN 2 THEN 'chat' ELSE 'search' END AS a FROM conversations)""")
def intent_guard(spark, sf_dir):
    """Guards of reset and ask, unknown actions."""
    action = F.when(F.col("turn") % 4 == 0, "Reset ").when(F.col("turn") % 4 == 1, "ask").when(F.col("turn") % 4 == 2, "fly").otherwise(" SEARCH")
    message = F.concat(F.when(F.col("conv_id") % 3 == 0, "please clear ").otherwise(""), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.guarded_action(action, message, F.col("conv_id") % 2 == 0).alias("action"))


ACTED = "(['search', 'next', 'open', 'summary', 'paper', 'ask', 'help', 'reset', 'chat'])[CAST((conv_id + turn) % 9 AS INT) + 1]"
MESSAGE = "CASE CAST((conv_id * 3 + turn) % 6 AS INT) WHEN 0 THEN 'Yes please' WHEN 1 THEN 'nope' WHEN 2 THEN 'open that' WHEN 3 THEN '' WHEN 4 THEN 'papers' ELSE text END"
OPENING = "a IN ('open', 'summary')"


@query(rf"""SELECT conv_id, turn, CASE WHEN m = '' THEN 'nudge' WHEN pending AND yes THEN 'run-pending' WHEN pending AND no THEN 'drop-pending' WHEN has_list AND a = 'search' AND {HAS(N.OPEN_CUES, 'm')} THEN 'open-from-context'
    WHEN has_list AND {OPENING} AND index IS NULL AND NOT titled AND topical THEN 'open-from-context' WHEN a IN ('help', 'reset') THEN a WHEN a = 'search' AND topical THEN 'search' WHEN a = 'search' THEN 'search-usage'
    WHEN a IN ('next', 'open', 'summary', 'paper') AND NOT has_search THEN 'no-search' WHEN a = 'next' THEN 'next' WHEN {OPENING} AND index IS NOT NULL THEN 'open-index' WHEN {OPENING} AND titled THEN 'open-title'
    WHEN {OPENING} AND topical THEN 'open-from-context' WHEN {OPENING} THEN 'open-usage' WHEN a IN ('paper', 'ask') THEN a ELSE 'chat' END AS handler, CASE WHEN a = 'open' OR {HAS(N.PDF_CUES, 'm')} THEN 'pdf' ELSE 'summary' END AS mode
    FROM (SELECT *, regexp_matches(m, '^(?:y|yes|yeah|yep|ok|okay|sure|do it|go ahead|new search|yes its a new search|yes it''s a new search)\b') AS yes,
        regexp_matches(m, '^(?:n|no|nope|nah)\b') OR regexp_matches(m, '^(?:forget it|never mind|nevermind|cancel|drop it|ignore that)\b') AS no FROM (
        SELECT conv_id, turn, lower(trim({MESSAGE}, {BLANKS})) AS m, {ACTED} AS a, (conv_id + turn) % 2 = 0 AS topical, CASE WHEN turn % 4 = 0 THEN turn END AS index, conv_id % 7 = 0 AS titled, conv_id % 2 = 0 AS has_list, conv_id % 2 = 0 OR conv_id % 3 = 0 AS has_search,
            (conv_id + turn * 2) % 4 = 1 AS pending FROM conversations))""")
def intent_route(spark, sf_dir):
    """E5: the router's decisions on every turn."""
    c, t = F.col("conv_id"), F.col("turn")
    k = (c * 3 + t) % 6
    message = F.when(k == 0, "Yes please").when(k == 1, "nope").when(k == 2, "open that").when(k == 3, "").when(k == 4, "papers").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", message.alias("message"), F.get(F.array(*[F.lit(a) for a in N.ACTIONS]), ((c + t) % 9).cast("int")).alias("action"), F.when((c + t) % 2 == 0, "bolts").otherwise("").alias("topic"), F.lit("").alias("author"),
        F.when(c % 7 == 0, "x").otherwise("").alias("title"), F.lit("").alias("paper_id"), F.when(t % 4 == 0, t.cast("int")).alias("index"), F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year"),
        F.array().cast("array<string>").alias("categories"), (c % 2 == 0).alias("has_list"), ((c % 2 == 0) | (c % 3 == 0)).alias("has_search"), ((c + t * 2) % 4 == 1).alias("pending"),
    )
    return N.route(rows).select("conv_id", "turn", "handler", "mode")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders), r AS (SELECT DISTINCT o_custkey, 1 + o_custkey % 9 AS index FROM orders)
    SELECT r.o_custkey AS session, r.index, coalesce(p.o_orderkey, g.o_orderkey) AS paper_id FROM r LEFT JOIN l p ON p.o_custkey = r.o_custkey AND p.position BETWEEN 3 AND 5 AND p.position - 2 = r.index LEFT JOIN l g ON g.o_custkey = r.o_custkey AND g.position = r.index""")
def open_by_index(spark, sf_dir):
    """An index names a paper of the page shown, else of the list."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    loaded = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), number.alias("position"), F.col("o_orderkey").alias("paper_id"))
    asked = loaded.select("session").distinct().withColumn("index", 1 + F.col("session") % 9)
    page = loaded.where(F.col("position").between(3, 5)).withColumn("position", F.col("position") - 2)
    return N.open_index(asked, page, loaded).select("session", "index", "paper_id")


# headings and lines of the documents as pages

@query("SELECT doc_id, CAST(doc_id % 23 AS INT) AS page FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 23 BETWEEN 1 + doc_id % 3 * 8 AND 10 + doc_id % 3 * 8")
def detection_validity(spark, sf_dir):
    """Detections outside their batch, without heading or page, are dropped."""
    d = F.col("doc_id")
    batch = (1 + d % 3 * 8).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 5 == 0, " ").otherwise(F.col("source")).alias("heading"), F.when(d % 7 == 0, "x").otherwise((d % 23).cast("string")).alias("page"), batch.alias("batch_start"), (batch + 9).alias("batch_end"))
    return headings.valid_detections(rows).select("doc_id", "page")


@query(rf"""WITH lines AS ({I.LINES}), shaped AS (SELECT *, trim(line, {BLANKS}) AS s, {I.NORMAL.format(x='line')} AS norm FROM lines)
    SELECT paper, page, line_no, NOT mid_y BETWEEN 80 AND 920 AS in_margin, {I.LOOKS.replace(' AND mid_y BETWEEN 80 AND 920', '')} AS top_heading, s <> '' AND size >= 10.5 AND (line_no % 3 = 2 OR (upper(line) = line AND lower(line) <> line)) AS heading_span FROM shaped""")
def line_predicates(spark, sf_dir):
    """Margins, lines that look like headings, heading spans."""
    lines = I._lines(spark, sf_dir)
    span = layout.is_heading_span(F.col("line"), F.col("size"), F.col("line_no") % 3 * 8, F.lit(10.5 / 1.15))
    return lines.select("paper", "page", "line_no", headings.in_margin(F.col("mid_y"), F.col("page_height")).alias("in_margin"), headings.looks_like_top_heading(F.col("line"), F.col("size"), F.col("body_size")).alias("top_heading"), span.alias("heading_span"))


@query("SELECT source, CAST(b AS INT) AS batch_start, CAST(least(b + 9, n) AS INT) AS batch_end FROM (SELECT source, n, unnest(range(1, greatest(1, n - 2) + 1, 8)) AS b FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))")
def vision_page_batches(spark, sf_dir):
    """Batches of ten pages that share two."""
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("int").alias("total_pages"))
    return headings.page_batches(pages).select("source", "batch_start", "batch_end")


@query("SELECT l_orderkey, l_linenumber, round(c, 6)::DOUBLE AS confidence, round(c, 12) >= 0.62 AS keep FROM (SELECT l_orderkey, l_linenumber, 0.2::DOUBLE + 0.22::DOUBLE * (l_linenumber % 2)::DOUBLE + 0.2::DOUBLE * (l_quantity / 50) + 0.14::DOUBLE * (l_linenumber / 7::DOUBLE) + 0.16::DOUBLE * ((l_suppkey % 5) / 4::DOUBLE) + 0.08::DOUBLE * (l_partkey % 2)::DOUBLE AS c FROM lineitem)")
def heading_score(spark, sf_dir):
    """The confidence of a heading from its components."""
    parts = [(F.col("l_linenumber") % 2).cast("double"), F.col("l_quantity") / 50, F.col("l_linenumber") / F.lit(7.0), (F.col("l_suppkey") % 5) / F.lit(4.0), (F.col("l_partkey") % 2).cast("double")]
    c = headings.confidence(*parts)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"), (F.round(c, 12) >= headings.KEEP).alias("keep"))


@query(rf"""WITH lines AS ({I.LINES}), detected AS ({I.DETECTED}), typed AS (SELECT *, page AS page_start, page AS pos FROM ({I._typed('detected')})),
    lined AS (SELECT paper, page AS page_start, line_no, size, mid_y, {I.NORMAL.format(x=I.BARE.format(x='line'))} AS l FROM lines WHERE mid_y BETWEEN 80 AND 920),
    firsts AS (SELECT f.paper, f.pos, arg_min(l.size / 10.0, l.line_no) AS ratio, arg_min(l.mid_y / 1000.0, l.line_no) AS rel FROM typed f JOIN lined l USING (paper, page_start) WHERE f.key <> '' AND contains(l.l, f.key) GROUP BY f.paper, f.pos),
    scored AS (SELECT f.*, s.scheme, 0.2 + 0.22 * (ratio IS NOT NULL)::INT + 0.2 * coalesce(CASE WHEN ratio >= 1.15 THEN 1.0 WHEN ratio >= 1.05 THEN 0.8 WHEN ratio >= 0.95 THEN 0.55 WHEN ratio IS NOT NULL THEN 0.2 END, 0.0)
        + 0.14 * coalesce(CASE WHEN rel <= 0.22 THEN 1.0 WHEN rel <= 0.35 THEN 0.7 WHEN rel <= 0.55 THEN 0.4 WHEN rel IS NOT NULL THEN 0.15 END, 0.0) + 0.16 * ({I.SCHEMED}) + 0.08 * ({I.SENSE}) AS confidence
        FROM typed f JOIN ({I._schemes('typed')}) s USING (paper) LEFT JOIN firsts USING (paper, pos))
    SELECT paper, heading, kind, round(confidence, 6)::DOUBLE AS confidence, round(confidence, 12) >= 0.62 AND NOT (scheme = 'roman' AND kind = 'arabic') AS keep FROM scored""")
def heading_score_lines(spark, sf_dir):
    """Headings scored by the first line of their page that holds them."""
    found, _, lines = I._papers(spark, sf_dir, False)
    heads = found.select("paper", "pos", "heading", F.col("page").alias("page_start"))
    return headings.score(heads, lines).select("paper", "heading", "kind", F.round("confidence", 6).alias("confidence"), "keep")


@query(f"SELECT paper, count(*) AS found, count(n) AS numbered, min(page_start) AS first_page FROM ({ORACLES['gap_recovery_papers']}) GROUP BY paper")
def gap_recovery(spark, sf_dir):
    """How many missing headings each paper's pages tell, and where they begin."""
    return I.gap_recovery_papers(spark, sf_dir).groupBy("paper").agg(F.count("*").alias("found"), F.count("n").alias("numbered"), F.min("page_start").alias("first_page"))


# questions, waits and cuts

@query("""SELECT doc_id, CASE CAST(doc_id % 5 AS INT) WHEN 2 THEN 'The last reference number is ' || l || '.' WHEN 3 THEN CASE WHEN 44 > l THEN 'Reference 44 does not exist in this paper. The last reference number is ' || l || '.' END
    WHEN 4 THEN NULL ELSE CASE WHEN c IS NOT NULL AND h <> '' AND s <> 0 AND e <> 0 THEN 'There are ' || c || ' references in the paper. They appear under the ''' || h || ''' section on page' || CASE WHEN s = e THEN ' ' || s ELSE 's ' || s || '–' || e END || '.'
    WHEN c IS NOT NULL THEN 'There are ' || c || ' references in the paper.' WHEN l IS NOT NULL THEN 'There are ' || l || ' references in the paper.' END END AS fact
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id % 97 END AS c, CASE WHEN doc_id % 7 < 5 THEN doc_id % 89 END AS l, CASE WHEN doc_id % 3 > 0 THEN 'References' ELSE '' END AS h, doc_id % 11 AS s, doc_id % 11 + doc_id % 2 AS e FROM documents)""")
def reference_facts(spark, sf_dir):
    """Facts on references: number, place, last one, one that isn't there."""
    d = F.col("doc_id")
    asked = F.get(F.array(*[F.lit(q) for q in ("How many references are there?", "total citations", "what is the last reference number?", "show reference 44", "tell me about the method")]), (d % 5).cast("int"))
    fact = Q.reference_facts(asked, F.when(d % 4 < 3, (d % 97).cast("int")), F.when(d % 7 < 5, (d % 89).cast("int")), F.when(d % 3 > 0, "References").otherwise(""), (d % 11).cast("int"), (d % 11 + d % 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", fact.alias("fact"))


@query("SELECT event_id, i AS attempt, round(greatest(0, least(0.5 * power(2, i - 1), 90 - 0.5 * (power(2, i - 1) - 1))), 6)::DOUBLE AS wait FROM (SELECT event_id, unnest(range(1, CAST(event_id % 13 AS BIGINT) + 1))::INT AS i FROM events)")
def retry_schedule(spark, sf_dir):
    """ST6: waits before retries within a budget."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 13).cast("int").alias("n"))
    waits = rows.select("event_id", F.posexplode(S.retry_schedule(F.col("n"), most=12)).alias("pos", "wait"))
    return waits.select("event_id", (F.col("pos") + 1).alias("attempt"), F.round("wait", 6).alias("wait"))


PARTED = f"SELECT doc_id, trim(replace(replace(text, chr(10), chr(10) || chr(10)), 'x', '. '), {BLANKS}) AS t FROM documents"


@query(f"WITH {chunk_sql(PARTED, 'doc_id')} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(st AS INT) AS chunk_start, CAST(en AS INT) AS chunk_end FROM chunks")
def chunk_boundaries(spark, sf_dir):
    """Paragraph, sentence, word and hard cuts of texts with paragraphs."""
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit("x"), F.lit(". "))
    return chunking.chunk(table(spark, sf_dir, "documents").select("doc_id", text.alias("s")), "s", ["doc_id"]).select("doc_id", "chunk_index", "chunk_start", "chunk_end")


@query(f"""WITH {CLEAN}, f AS (SELECT doc_id, doc_id // 20 AS paper_id, c FROM l WHERE k = 1), q AS (SELECT doc_id AS question_id, paper_id, 'explain ' || lower(substring(c, 1, 18)) AS question FROM f),
    h AS (SELECT paper_id, doc_id AS pos, c AS clean, list_filter(regexp_extract_all(lower(c), '[a-z]+'), lambda w: length(w) > 3) AS words FROM (SELECT doc_id, paper_id, trim(regexp_replace(regexp_replace('II. ' || c, '^[IVXivx0-9]+[.)]\\s*|^[A-Za-z][.)]\\s*', ''), '^$', '')) AS c FROM f)),
    m AS (SELECT q.question_id, h.pos, h.clean, len(words) AS n, len(list_filter(words, lambda w: contains(q.question, w))) AS m FROM q JOIN h USING (paper_id) WHERE len(words) > 0),
    best AS (SELECT question_id, arg_max(clean, (m / n, -pos)) AS section FROM m WHERE m >= greatest(1, n // 2) AND m / n >= 0.5 GROUP BY question_id)
    SELECT q.question_id, coalesce(b.section, CASE {' '.join(f"WHEN contains(question, '{a}') THEN '{b}'" for a, b in Q.TRIGGERS)} END) AS section FROM q LEFT JOIN best b USING (question_id)""")
def section_match(spark, sf_dir):
    """The stored heading that a question's words name best, else the trigger map's section."""
    first = _clean(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 20).alias("paper_id"), F.get("c", 0).alias("c"))
    asked = first.select(F.col("doc_id").alias("question_id"), "paper_id", F.concat(F.lit("explain "), F.lower(F.substring("c", 1, 18))).alias("question"))
    stored = first.select("paper_id", F.col("doc_id").alias("pos"), F.concat(F.lit("II. "), "c").alias("heading"))
    return Q.section_filter(asked, stored).select("question_id", "section")


CHOICES = " ".join(f"WHEN kind = '{k}' AND place = '{p}' AND every = {str(a).lower()} THEN '{h}'" for (k, p, a), (_, h) in N.SHOWN.items())
LIMITS = " ".join(f"WHEN kind = '{k}' AND place = '{p}' AND every = {str(a).lower()} THEN {n}" for (k, p, a), (n, _) in N.SHOWN.items())


@query(f"""WITH c AS (SELECT c_nationkey AS session, CASE WHEN c_nationkey % 2 = 0 THEN 'title' ELSE 'filter' END AS kind, CASE WHEN c_nationkey // 2 % 2 = 0 THEN 'page' ELSE 'loaded' END AS place, c_nationkey % 3 = 0 AS every, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank,
        CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 100 END AS position, c_name AS title, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS authors, CASE WHEN c_custkey % 5 > 0 THEN '2020' ELSE '' END AS published FROM customer)
    SELECT session, count(*) AS shown, CASE {CHOICES} END || chr(10) || string_agg(CASE WHEN position > 0 THEN position || ') ' ELSE '- ' END || title || CASE WHEN authors || published = '' THEN '' ELSE chr(10) || '   ' || CASE WHEN authors <> '' THEN 'Authors: ' || authors ELSE '' END
        || CASE WHEN authors <> '' AND published <> '' THEN ' | ' ELSE '' END || CASE WHEN published <> '' THEN 'Published: ' || published ELSE '' END END, chr(10) ORDER BY rank) AS reply FROM c WHERE rank <= CASE {LIMITS} END GROUP BY session, kind, place, every""")
def candidate_choices(spark, sf_dir):
    """Candidates as text, ten to thirty of them by where they were found and what was asked."""
    k, c = F.col("c_nationkey"), F.col("c_custkey")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("session"), F.when(k % 2 == 0, "title").otherwise("filter").alias("kind"), F.when(F.floor(k / 2) % 2 == 0, "page").otherwise("loaded").alias("place"), (k % 3 == 0).alias("all"), rank.alias("rank"),
        F.when(c % 4 == 0, 0).otherwise(c % 100).alias("position"), F.col("c_name").alias("title"), F.when(c % 3 > 0, F.col("c_mktsegment")).alias("authors"), F.when(c % 5 > 0, "2020").alias("published"),
    )
    return N.candidate_choices(rows, "session")
