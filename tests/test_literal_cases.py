"""Operators on small literal inputs with the rows that they must give, as DuckDB values."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators import chunking, headings, layout
from litspan.operators import headings as H
from litspan.operators import layout as L
from litspan.operators import navigation as N
from litspan.operators import qa as Q
from litspan.operators import references as B
from litspan.operators import sections as X
from litspan.operators import state as S
from litspan.plans.documents import BLANKS, chunk_sql
from litspan.sources.files import pdf_error
from litspan.sources.tables import literal

REGISTERED: dict = {}


def query(oracle):
    """Keep a case under its function's name."""

    def add(f):
        REGISTERED[f.__name__] = (f, oracle)
        return f

    return add


CASES = "(1, repeat('x', 2400)), (2, repeat('x', 2401)), (3, repeat('x', 5000)), (4, concat(repeat('x', 2100), '\\n\\n', repeat('y', 1000))), (5, concat(repeat('x', 2300), '. ', repeat('y', 1000))), (6, concat(repeat('x', 2350), ' ', repeat('y', 1000))), (7, ' \\n '), (8, NULL)"


CASES_SQL = f"SELECT case_id, trim(coalesce(s, ''), {BLANKS}) AS t FROM (VALUES {CASES.replace(chr(92) + 'n' + chr(92) + 'n', chr(10) + chr(10)).replace(chr(92) + 'n', chr(10))}) v(case_id, s)"


@query(f"WITH {chunk_sql(CASES_SQL, 'case_id')} SELECT case_id, CAST(chunk_index AS INT) AS chunk_index, CAST(st AS INT) AS chunk_start, CAST(en AS INT) AS chunk_end FROM chunks")
def chunk_boundaries(spark, sf_dir):
    """Paragraph, sentence, word and hard cuts; blank texts have no chunk."""
    return chunking.chunk(literal(spark, "case_id, s", CASES), "s", ["case_id"]).select("case_id", "chunk_index", "chunk_start", "chunk_end")


FEED = """SELECT id, replace(trim(title), chr(10), ' ') AS title, split_part(split_part(id, '/abs/', -1), 'v', 1) AS paper_id, pdf FROM (VALUES
    ('http://c.org/abs/1v1', ' A' || chr(10) || 'b ', 'http://c.org/pdf/1v1'), ('http://c.org/abs/2v3', 'T', 'http://c.org/pdf/2v3.pdf'), ('plain', '', 'plain')) t(id, title, pdf)"""


@query(FEED)
def feed_normalize(spark, sf_dir):
    """Feed entries as papers."""
    from litspan.sources.feed import papers

    rows = literal(spark, "id, title, type, href", "('http://c.org/abs/1v1', ' A\\nb ', 'application/pdf', 'http://c.org/pdf/1v1'), ('http://c.org/abs/2v3', 'T', 'text/html', 'http://c.org/abs/2v3'), ('plain', '', '', '')")
    entries = rows.select("id", "title", F.lit(" s\nt ").alias("summary"), F.lit("2020-01-02T00:00:00Z").alias("published"), F.lit("").alias("updated"), F.col("id").alias("link"),
        F.array(F.struct(F.lit("Ann ").alias("name"), )).alias("authors"), F.array(F.struct("type", "href")).alias("links"), F.array(F.struct(F.lit("cs.CL").alias("term")), F.struct(F.lit("cs.CL").alias("term"))).alias("tags"))
    return papers(entries).select("id", "title", "paper_id", F.col("pdf_url").alias("pdf"))


@query("SELECT * FROM (VALUES ('1', 'http://a/1.pdf'), ('2', 'http://b/2'), ('3', 'https://catalogue.example/pdf/3.pdf'), ('', '')) t(paper_id, resolved_pdf_url)")
def pdf_url_resolve(spark, sf_dir):
    """Where a paper's PDF is."""
    from litspan.sources.feed import pdf_url

    rows = literal(spark, "paper_id, pdf_url, pdf, pdfLink", "('1', 'http://a/1.pdf', 'x', ''), ('2', '', NULL, ' http://b/2 '), ('3', NULL, '', ''), ('', NULL, '', '')")
    return pdf_url(rows).select("paper_id", "resolved_pdf_url")


TEXTS = r"""(1, '[1] A. Foo. Title. 2019.\n[2] B. Bar. Title\ncont. 2020.\n[0] junk\n[3] C.'),
 (2, '1. Foo, A. One.\n   more\n2. Bar, B. Two.\r\n9999. far\n4. Four four'), (3, '1) x y\n2) z w\n3) v'),
 (4, 'Smith, J. and Doe, A. (2019). A long title.\nJournal of Things.\nBrown et al., 2020. Another title here\n2021\npp. 3-4'), (5, ''), (6, 'nothing here')"""


def _texts(spark):
    return literal(spark, "paper, text", TEXTS)


def _sql(values: str) -> str:
    return "SELECT * FROM (VALUES " + values + ")"


@query(_sql("(1, 'bracket'), (2, 'plain-dot'), (3, 'plain-paren'), (4, 'author-year'), (5, 'unknown'), (6, 'unknown')") + " t(paper, style)")
def ref_style_vote(spark, sf_dir):
    """The style of a bibliography."""
    return _texts(spark).select("paper", B.style(F.col("text")).alias("style"))


@query(_sql("(2, 1, '1. Foo, A. One. more'), (2, 2, '2. Bar, B. Two. 9999. far'), (3, 1, '1) x y'), (3, 2, '2) z w'), (3, 3, '3) v')") + " t(paper, idx, raw_text)")
def ref_entries_dot(spark, sf_dir):
    """Numbered entries of the longest run; a line with an implausible number continues the entry."""
    entries, _ = B.parse(_texts(spark).where("paper IN (2, 3)"), "paper")
    return entries.select("paper", "idx", "raw_text")


@query(_sql("(1, 1, '[1] A. Foo. Title. 2019.'), (1, 2, '[2] B. Bar. Title cont. 2020.'), (1, 3, '[3] C.')") + " t(paper, idx, raw_text)")
def ref_entries_bracket(spark, sf_dir):
    """Bracketed entries."""
    entries, _ = B.parse(_texts(spark).where("paper = 1"), "paper")
    return entries.select("paper", "idx", "raw_text")


@query(_sql("(4, 'Smith, J. and Doe, A. (2019). A long title. Journal of Things.'), (4, 'Brown et al., 2020. Another title here 2021 pp. 3-4')") + " t(paper, raw_text)")
def ref_entries_authoryear(spark, sf_dir):
    """Entries by author and year."""
    entries, _ = B.parse(_texts(spark).where("paper >= 4"), "paper")
    return entries.select("paper", "raw_text")


@query("SELECT * FROM (VALUES (1, 'bracket', 3::BIGINT, 0.95::DOUBLE, 3), (2, 'plain-dot', 2, 0.866667, 2), (3, 'plain-paren', 3, 0.95, 3), (4, 'author-year', 2, 0.57, NULL)) t(paper, style, n_refs, confidence, last_number)")
def ref_summary(spark, sf_dir):
    """X6, X6d: style, count, confidence and last number of each bibliography."""
    _, summary = B.parse(_texts(spark), "paper")
    return summary.select("paper", "style", F.col("count").alias("n_refs"), F.round("confidence", 6).alias("confidence"), F.col("last_reference_number").alias("last_number"))


@query("SELECT * FROM (VALUES (1, 2), (2, 0)) t(paper, section_index)")
def ref_section_find(spark, sf_dir):
    """the first reference section of each paper."""
    rows = literal(spark, "paper, section_index, heading_text", "(1, 0, 'Intro'), (1, 2, 'VII. References'), (1, 3, 'Bibliography'), (2, 0, '12 Works Cited'), (3, 0, NULL)")
    return B.reference_section(rows, "paper").select("paper", "section_index")


SCORES = "(1, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0, 1.0), (3, 1.0, 0.55, 0.15, 0.45, 0.3), (4, 1.0, 0.55, 0.4, 0.8, 1.0)"


BLOCKS = """(1, 0, 50.0, 10.0, 560.0, 40.0, 'title'), (1, 1, 50.0, 60.0, 290.0, 90.0, 'left one'), (1, 2, 320.0, 60.0, 560.0, 90.0, 'right one'), (1, 3, 50.4, 100.0, 290.0, 130.0, 'left two'), (1, 4, 320.0, 95.0, 560.0, 99.0, 'right two'),
 (2, 0, 50.0, 10.0, 560.0, 40.0, 'a'), (2, 1, 60.0, 5.0, 400.0, 9.0, 'b'), (3, 0, 10.0, 10.0, 20.0, 12.0, ' '), (3, 1, 300.0, 10.0, 310.0, 12.0, 'y'), (3, 2, 20.0, 10.0, 30.0, 12.0, 'x'), (3, 3, 20.0, 8.0, 30.0, 9.0, 'w')"""


@query(f"SELECT n, round(0.2 + 0.22 * a + 0.2 * b + 0.14 * c + 0.16 * d + 0.08 * e, 6)::DOUBLE AS confidence, 0.2 + 0.22 * a + 0.2 * b + 0.14 * c + 0.16 * d + 0.08 * e >= 0.62 AS keep FROM (VALUES {SCORES}) t(n, a, b, c, d, e)")
def heading_score(spark, sf_dir):
    """The confidence of a heading."""
    rows = literal(spark, "n, a, b, c, d, e", SCORES)
    c = H.confidence(*[F.col(x).cast("double") for x in "abcde"])
    return rows.select("n", F.round(c, 6).alias("confidence"), (F.round(c, 12) >= H.KEEP).alias("keep"))


@query("""SELECT * FROM (VALUES ('I. Introduction', 'roman', 1.0::DOUBLE, true), ('2. Data', 'arabic', 0.52, false), ('II. Method', 'roman', 0.92, true), ('References', 'mandatory-unnumbered', 0.44, false)) t(heading, kind, confidence, keep)""")
def heading_score_lines(spark, sf_dir):
    """Headings scored by the first line of their page that holds them."""
    heads = literal(spark, "paper, pos, heading, page_start", "(1, 0, 'I. Introduction', 1), (1, 1, '2. Data', 1), (1, 2, 'II. Method', 2), (1, 3, 'References', 3)")
    lines = literal(spark, "paper, page, line_no, line, size, mid_y, page_height, body_size", "(1, 1, 0, 'I.  INTRODUCTION', 12.0, 100.0, 1000.0, 10.0), (1, 1, 1, 'the introduction', 9.0, 500.0, 1000.0, 10.0), (1, 1, 2, 'data', 9.0, 600.0, 1000.0, 10.0), (1, 2, 0, 'Method', 10.5, 50.0, 1000.0, 10.0), (1, 2, 1, 'Our method', 10.5, 300.0, 1000.0, 10.0)")
    found = H.score(heads, lines.select(*[F.col(c).cast("double").alias(c) if c in ("size", "mid_y", "page_height", "body_size") else F.col(c) for c in lines.columns]))
    return found.select("heading", "kind", F.round("confidence", 2).alias("confidence"), "keep")


@query("SELECT total_pages, b AS batch_start, least(b + 9, total_pages) AS batch_end FROM (SELECT CAST(r AS INT) AS total_pages, unnest(range(1, greatest(1, r - 2) + 1, 8))::INT AS b FROM range(1, 61) t(r))")
def vision_page_batches(spark, sf_dir):
    """Batches of ten pages that share two."""
    return H.page_batches(spark.range(1, 61).select(F.col("id").cast("int").alias("total_pages")))


@query("SELECT * FROM (VALUES (1, true, 'title\nleft one\nleft two\nright one\nright two'), (2, false, 'b\na'), (3, false, 'w\nx\ny')) t(page, two_columns, body)")
def columns_detect(spark, sf_dir):
    """Columns and reading order of pages."""
    blocks = literal(spark, "page, block, x0, y0, x1, y1, text", BLOCKS)
    blocks = blocks.select("page", "block", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text", F.lit(612.0).alias("page_w"))
    return L.page_texts(blocks, ["page"]).select("page", "two_columns", F.col("text").alias("body"))


@query("SELECT * FROM (VALUES (1, 'two-column'), (2, 'single-column')) t(paper, layout)")
def paper_layout(spark, sf_dir):
    """A paper's layout."""
    return L.paper_layout(literal(spark, "paper, two_columns", "(1, true), (1, false), (1, false), (2, true), (2, false), (2, false), (2, false)"))


MARKDOWN = r"""(1, 4, 'Title\nby A\n\n# One\ntext a\n---\n## **Two**\n  text b  \n### Three\ntext c\n# Four\n#### deep\n### Five\ntail\n'), (2, 2, 'no heading at all'), (3, 1, '# Empty\n# Full\nx'), (4, 3, '')"""


@query(r"""SELECT * FROM (VALUES (1, 0, 0, '', NULL, 1, 2, 'Title' || chr(10) || 'by A'), (1, 1, 1, 'One', NULL, 2, 3, 'text a'), (1, 2, 2, 'Two', 'One', 3, 3, 'text b'), (1, 3, 3, 'Three', 'Two', 3, 4, 'text c'),
    (1, 4, 1, 'Four', NULL, 4, 5, '#### deep'), (1, 5, 3, 'Five', 'Four', 5, 5, 'tail'), (3, 0, 1, 'Full', NULL, 1, 1, 'x')) t(paper, section_index, heading_level, heading_text, parent_heading, page_start, page_end, content_text)""")
def markdown_sections(spark, sf_dir):
    """Sections of Markdown."""
    found = X.from_markdown(literal(spark, "paper, total_pages, markdown", MARKDOWN))
    return found.select("paper", "section_index", "heading_level", "heading_text", "parent_heading", "page_start", "page_end", "content_text")


@query("SELECT 1 AS paper, '- One  (page 1)' || chr(10) || '  - Two  (page 3)' AS shown, 3 AS levels")
def heading_outline(spark, sf_dir):
    """The heading tree as JSON and back, and its outline."""
    tree = literal(spark, "paper, j", """(1, '[{"level":1,"text":"One","page":1},{"level":2,"text":"Two","page":3},{"level":3,"text":"Deep","page":3},{"level":1,"text":" ","page":9}]')""")
    read = tree.select("paper", T.headings_from_json(F.col("j")).alias("t"))
    again = read.select("paper", T.headings_from_json(T.headings_json(F.col("t"))).alias("t"))
    return again.select("paper", T.outline(T.display_outline(F.col("t"))).alias("shown"), F.size("t").alias("levels"))


ROUTES = [
    ("", "chat", "", None, False, False, False, "nudge"),
    ("yes please", "chat", "", None, True, True, True, "run-pending"),
    ("no", "chat", "", None, True, True, True, "drop-pending"),
    ("open the one on bolts", "search", "bolts", None, True, True, False, "open-from-context"),
    ("papers on bolts", "search", "bolts", None, True, True, False, "search"),
    ("find", "search", "", None, False, False, False, "search-usage"),
    ("next", "next", "", None, False, False, False, "no-search"),
    ("next", "next", "", None, True, True, False, "next"),
    ("open 3", "open", "", 3, True, True, False, "open-index"),
    ("summary please", "summary", "", None, True, True, False, "open-usage"),
    ("summary on bolts", "summary", "bolts", None, True, True, False, "open-from-context"),
    ("help", "help", "", None, False, False, False, "help"),
    ("why?", "ask", "", None, True, True, False, "ask"),
    ("hello", "chat", "", None, False, False, False, "chat"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r[7]}')" for i, r in enumerate(ROUTES)) + ") t(n, handler)")
def intent_route(spark, sf_dir):
    """E5: the router's decision table."""
    rows = spark.createDataFrame([(i, *r[:7]) for i, r in enumerate(ROUTES)], "n int, message string, action string, topic string, index int, has_list boolean, has_search boolean, pending boolean")
    empty = F.lit("")
    rows = rows.withColumns({"author": empty, "title": empty, "paper_id": empty, "from_year": F.lit(None).cast("int"), "to_year": F.lit(None).cast("int"), "categories": F.array().cast("array<string>")})
    return N.route(rows).select("n", "handler")


@query("SELECT * FROM (VALUES (1, 'reset'), (2, 'chat'), (3, 'chat'), (4, 'ask'), (5, 'chat')) t(n, action)")
def intent_guard(spark, sf_dir):
    """Guards of reset and ask, unknown actions."""
    rows = literal(spark, "n, action, message, has_paper", "(1, 'Reset ', 'please start over', false), (2, 'reset', 'hello', true), (3, 'ask', 'why', false), (4, 'ask', 'why', true), (5, 'fly', 'x', true)")
    return rows.select("n", N.guarded_action(F.col("action"), F.col("message"), F.col("has_paper")).alias("action"))


@query("SELECT * FROM (VALUES (1, 5, 'p15'), (1, 15, 'p15b'), (1, 99, NULL)) t(session, index, paper_id)")
def open_by_index(spark, sf_dir):
    """An index names a paper of the page, else of the list."""
    page = literal(spark, "session, position, paper_id", "(1, 5, 'p15')")
    loaded = literal(spark, "session, position, paper_id", "(1, 5, 'p5'), (1, 15, 'p15b')")
    return N.open_index(literal(spark, "session, index", "(1, 5), (1, 15), (1, 99)"), page, loaded)


@query("SELECT * FROM (VALUES (1, NULL), (2, 'Response is not a PDF'), (3, 'Empty response body'), (4, 'PDF not found (404)'), (5, 'Server error (503)'), (6, 'Rate limited (429)'), (7, 'Access denied (403)')) t(n, error)")
def pdf_validation(spark, sf_dir):
    """Which bytes are a PDF."""
    rows = literal(spark, "n, content, status", "(1, CAST('%PDF-1.7' AS BINARY), 200), (2, CAST('<html>' AS BINARY), 200), (3, CAST('' AS BINARY), 200), (4, NULL, 404), (5, NULL, 503), (6, NULL, 429), (7, NULL, 403)")
    return rows.select("n", pdf_error(F.col("content"), F.col("status")).alias("error"))


@query("SELECT n, i AS attempt, round(greatest(0, least(0.5 * power(2, i - 1), 90 - 0.5 * (power(2, i - 1) - 1))), 6)::DOUBLE AS wait FROM (SELECT CAST(n AS INT) AS n, unnest(range(1, least(n, 12) + 1))::INT AS i FROM range(0, 13) t(n))")
def retry_schedule(spark, sf_dir):
    """ST6: waits before retries within a budget."""
    rows = spark.range(0, 13).select(F.col("id").cast("int").alias("n"))
    waits = rows.select("n", F.posexplode(S.retry_schedule(F.col("n"), most=12)).alias("pos", "wait"))
    return waits.select("n", (F.col("pos") + 1).alias("attempt"), F.round("wait", 6).alias("wait"))


@query("SELECT * FROM (VALUES (1, 'Proposed Training Pipeline Design'), (2, 'Prior Research'), (3, NULL), (4, 'method')) t(question_id, section)")
def section_match(spark, sf_dir):
    """The stored heading a question is about."""
    questions = literal(spark, "question_id, paper_id, question", "(1, 1, 'what does the proposed training pipeline do'), (2, 1, 'explain prior research'), (3, 1, 'who wrote it'), (4, 1, 'the method?')")
    headings = literal(spark, "paper_id, pos, heading", "(1, 0, 'I. Introduction'), (1, 1, 'II. Prior Research'), (1, 2, 'III. Proposed Training Pipeline Design')")
    return Q.section_filter(questions, headings).select("question_id", "section")


@query("""SELECT * FROM (VALUES (1, 'There are 12 references in the paper. They appear under the ''References'' section on pages 9–10.'), (2, 'There are 12 references in the paper. They appear under the ''References'' section on page 9.'),
    (3, 'There are 8 references in the paper.'), (4, 'The last reference number is 8.'), (5, 'Reference 44 does not exist in this paper. The last reference number is 8.'), (6, NULL)) t(n, fact)""")
def reference_facts(spark, sf_dir):
    """Facts on references."""
    rows = literal(spark, "n, q, c, l, h, s, e", "(1, 'how many references?', 12, 12, 'References', 9, 10), (2, 'how many references?', 12, 12, 'References', 9, 9), (3, 'total citations', NULL, 8, NULL, NULL, NULL), (4, 'last reference number', 7, 8, NULL, NULL, NULL), (5, 'reference 44', 7, 8, NULL, NULL, NULL), (6, 'reference 4', 7, 8, NULL, NULL, NULL)")
    return rows.select("n", Q.reference_facts(*[F.col(c) for c in "qclhse"]).alias("fact"))


@query("SELECT * FROM (VALUES (1, 'search', 2020), (2, 'chat', NULL), (3, NULL, NULL)) t(n, action, year)")
def intent_json(spark, sf_dir):
    """JSON in a model's reply, fenced or amid words."""
    rows = literal(spark, "n, reply", """(1, '```json\\n{"action": "search", "from_year": 2020}\\n```'), (2, 'Sure: {"action": "chat"} ok'), (3, 'nothing')""")
    found = T.safe_json(T.strip_fences(F.col("reply")), "action string, from_year int")
    return rows.select("n", found["action"].alias("action"), found["from_year"].alias("year"))


@query("SELECT * FROM (VALUES (1, 2, '2. Methods', 3), (1, 4, '4. Evaluation plan', 5)) t(paper, n, heading, page_start)")
def gap_recovery(spark, sf_dir):
    """Missing numbers found on the pages between their neighbours."""
    known = literal(spark, "paper, heading, page_start, n", "(1, '1. Intro', 2, 1), (1, '3. Results', 4, 3), (1, '5. End', 6, 5)")
    lines = literal(spark, "paper, page, line_no, line, size, body_size", "(1, 3, 0, '2. Methods', 12.0, 10.0), (1, 3, 1, 'Some larger words', 14.0, 10.0), (1, 5, 0, 'Evaluation plan', 13.0, 10.0), (1, 5, 1, 'body text of a page.', 10.0, 10.0), (1, 5, 2, 'Figure 3 shows', 15.0, 10.0), (1, 5, 3, '3. Results', 13.0, 10.0), (1, 9, 0, '4. Too far', 13.0, 10.0)")
    lines = lines.select("paper", "page", "line_no", "line", F.col("size").cast("double").alias("size"), F.col("body_size").cast("double").alias("body_size"), F.lit(500.0).alias("mid_y"), F.lit(1000.0).alias("page_height"))
    return headings.recovered(headings.searches(known, known.select("paper", F.lit(9).alias("total_pages")).distinct()), lines)


@query("SELECT * FROM (VALUES (1, false, true, false), (2, true, false, true), (3, false, true, true), (4, false, false, false)) t(n, in_margin, top_heading, heading_span)")
def line_predicates(spark, sf_dir):
    """Margins, lines that look like headings, heading spans."""
    rows = literal(spark, "n, line, size, flags, mid_y", "(1, 'Method', 10.0, 16, 300.0), (2, 'A. B', 12.0, 0, 20.0), (3, 'RESULTS', 12.0, 0, 500.0), (4, 'It ends.', 12.0, 0, 500.0)")
    size = F.col("size").cast("double")
    return rows.select("n", headings.in_margin(F.col("mid_y").cast("double"), F.lit(1000.0)).alias("in_margin"), headings.looks_like_top_heading(F.col("line"), size, F.lit(10.0)).alias("top_heading"), layout.is_heading_span(F.col("line"), size, F.col("flags"), F.lit(10.0)).alias("heading_span"))


@query("SELECT * FROM (VALUES (1, 1, 'A', 3), (1, 2, 'B', 12)) t(paper, batch, heading, page)")
def detection_validity(spark, sf_dir):
    """Detections outside their batch, without heading or page, are dropped."""
    rows = literal(spark, "paper, batch, heading, page, batch_start, batch_end", "(1, 1, 'A', '3', 1, 10), (1, 1, ' ', '4', 1, 10), (1, 1, 'C', '11', 1, 10), (1, 2, 'B', '12', 9, 18), (1, 2, 'D', 'x', 9, 18), (1, 2, 'E', NULL, 9, 18)")
    return headings.valid_detections(rows).select("paper", "batch", "heading", "page")


def shown(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_case(spark, sf_dir, name):
    run, oracle = REGISTERED[name]
    df, want = run(spark, sf_dir), duckdb.sql(oracle)
    assert shown(df.columns, map(tuple, df.collect())) == shown(want.columns, want.fetchall())
