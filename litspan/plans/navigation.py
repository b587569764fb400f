"""Queries of sessions, titles and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.operators import navigation as N
from litspan.operators import search as S
from litspan.operators import state, titles
from litspan.plans.documents import BLANKS
from litspan.plans.registering import query
from litspan.sources.tables import literal, table

MESSAGES = "('Open the PDF'), ('yes, do it'), ('Nope'), ('never mind'), ('list all of them'), ('just choose'), (' thread '), (''), ('okay?'), ('yesterday'), ('tell me about it'), ('north')"
CUES = lambda cues: " OR ".join(f"contains(m, '{c}')" for c in cues)


#: DuckDB has no lookahead: no letter, number or underscore of any script follows.
ENDED = r"(?:[^\p{L}\p{N}_]|$)"


@query(f"""SELECT text, {CUES(N.OPEN_CUES)} AS opens, {CUES(N.PDF_CUES)} AS pdf, {CUES(N.SHOW_ALL)} AS show_all, {CUES(N.CHOOSE_ONE)} AS choose_one,
    CASE WHEN regexp_matches(m, '^(?:y|yes|yeah|yep|ok|okay|sure|do it|go ahead|new search|yes its a new search|yes it''s a new search){ENDED}') THEN 'yes' WHEN regexp_matches(m, '^(?:n|no|nope|nah){ENDED}') THEN 'no'
    WHEN regexp_matches(m, '^(?:forget it|never mind|nevermind|cancel|drop it|ignore that){ENDED}') THEN 'cancel' ELSE 'other' END AS answer
    FROM (SELECT text, lower(trim(coalesce(text, ''), {BLANKS})) AS m FROM (SELECT text FROM conversations UNION ALL VALUES {MESSAGES}))""")
def message_cues(spark, sf_dir):
    """cues and answers in messages."""
    rows = table(spark, sf_dir, "conversations").select("text").union(literal(spark, "text", MESSAGES))
    m = F.col("text")
    return rows.select("text", N.wants(m, N.OPEN_CUES).alias("opens"), N.wants(m, N.PDF_CUES).alias("pdf"), N.wants(m, N.SHOW_ALL).alias("show_all"), N.wants(m, N.CHOOSE_ONE).alias("choose_one"), N.answer_kind(m).alias("answer"))


@query("SELECT event_type, action, CAST(count(*) AS BIGINT) AS turns, CAST(sum(CASE action WHEN 'help' THEN " + str(len(N.HELP)) + " WHEN 'reset' THEN 43 ELSE 0 END) AS BIGINT) AS chars FROM (SELECT event_type, CASE event_type WHEN 'view' THEN 'help' WHEN 'click' THEN 'reset' ELSE 'chat' END AS action FROM events) GROUP BY ALL")
def fixed_replies(spark, sf_dir):
    """Replies of handlers that need no data, the help text among them."""
    action = F.when(F.col("event_type") == "view", "help").when(F.col("event_type") == "click", "reset").otherwise("chat")
    rows = table(spark, sf_dir, "events").select("event_type", action.alias("action"))
    return rows.groupBy("event_type", "action").agg(F.count("*").alias("turns"), F.coalesce(F.sum(F.length(N.fixed_reply(F.col("action")))), F.lit(0)).cast("long").alias("chars"))


TITLE = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
ASKED = "(1, 'Red  WIDGET'), (2, 'hot-gear!'), (3, 'bolt'), (4, ''), (5, 'zzz')"


@query(f"""WITH r AS (SELECT request_id, {TITLE.format(x='q')} AS q FROM (VALUES {ASKED}) t(request_id, q)), p AS (SELECT p_partkey, {TITLE.format(x='p_name')} AS t FROM part),
    e AS (SELECT request_id, min(p_partkey) AS p_partkey FROM r JOIN p ON q = t WHERE q <> '' GROUP BY request_id)
    SELECT request_id, p_partkey, 'exact' AS match FROM e UNION ALL SELECT request_id, p_partkey, 'substring' FROM r JOIN p ON contains(t, q) WHERE q <> '' AND request_id NOT IN (SELECT request_id FROM e)""")
def title_match(spark, sf_dir):
    """Titles equal to a request, else those that contain it."""
    return titles.title_matches(literal(spark, "request_id, query", ASKED), table(spark, sf_dir, "part"), paper="p_partkey", title="p_name")


def _titled(spark, sf_dir):
    """Titles of a corpus: how its documents begin; every twentieth is asked for with other words around and between."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 70).alias("title"))
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("request_id"), "title")
    return docs, asked


@query(f"""WITH d AS (SELECT doc_id, {TITLE.format(x='substring(text, 1, 70)')} AS t FROM documents), r AS (SELECT doc_id AS request_id, {TITLE.format(x='substring(text, 4, 9)')} AS q FROM documents WHERE doc_id % 20 = 0),
    e AS (SELECT request_id, min(doc_id) AS doc_id FROM r JOIN d ON q = t WHERE q <> '' GROUP BY request_id)
    SELECT request_id, doc_id, 'exact' AS match FROM e UNION ALL SELECT request_id, doc_id, 'substring' FROM r JOIN d ON contains(t, q) WHERE q <> '' AND request_id NOT IN (SELECT request_id FROM e)""")
def title_match_corpus(spark, sf_dir):
    """Fragments of every twentieth title asked of all titles."""
    docs, asked = _titled(spark, sf_dir)
    return titles.title_matches(asked.withColumn("query", F.substring("title", 4, 9)), docs, paper="doc_id")


@query()
def title_match_fuzzy(spark, sf_dir):
    """The likeliest titles by matching blocks, for every twentieth title with some of its letters changed. A ratio of matching blocks has no SQL; tests compare all pairs."""
    docs, asked = _titled(spark, sf_dir)
    changed = asked.withColumn("query", F.regexp_replace(F.substring("title", 3, 60), "th", "d"))
    return titles.fuzzy_titles(changed, docs, paper="doc_id").withColumn("ratio", F.round("ratio", 6))


@query("""WITH l AS (SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer),
    m AS (SELECT * FROM l WHERE contains(lower(c_name), '7') AND contains(lower(c_mktsegment), 'build'))
    SELECT c_custkey, CASE WHEN position BETWEEN 11 AND 20 THEN position - 10 ELSE position END AS position FROM m WHERE position <= 200""")
def attr_filter_page_first(spark, sf_dir):
    """A list's matches, numbered by the page shown first."""
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    loaded = S.page(table(spark, sf_dir, "customer"), order, 0, 200).withColumnRenamed("c_custkey", "paper_id")
    shown = N.page_slice(loaded, 10, 10).withColumn("position", F.col("position") - 10)
    found = loaded.where(S.author_match(F.col("c_name"), "7") & S.topic_match(F.lit(""), F.col("c_mktsegment"), "BUILD ")).select("paper_id")
    numbered = N.candidate_index(found, shown.select("paper_id", "position"), loaded.select("paper_id", "position"))
    return numbered.select(F.col("paper_id").alias("c_custkey"), F.col("position").cast("long").alias("position"))


@query("SELECT conv_id, CAST(CASE WHEN n * 2 > 4 AND 8 >= n * 3 THEN NULL WHEN 8 >= n * 2 THEN NULL ELSE 8 END AS BIGINT) AS next_start FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def next_page(spark, sf_dir):
    """K4: where a session's next page starts."""
    n = F.col("n")
    counted = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return counted.select("conv_id", N.next_start(F.lit(4), F.lit(4), F.when(n * 2 > 4, n * 3), n * 2).cast("long").alias("next_start"))


@query("""SELECT l_nation AS session, string_agg(position || ') ' || s_name || chr(10) || '   Authors: ' || a || ' | Published: 2020-01-0' || position, chr(10) ORDER BY position) AS reply FROM
    (SELECT s_nationkey AS l_nation, s_name, 'A' || s_suppkey AS a, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier) WHERE position <= 5 GROUP BY l_nation""")
def list_reply(spark, sf_dir):
    """P20: a page of results as text."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "supplier").withColumn("position", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("position <= 5")
    rows = rows.select(F.col("s_nationkey").alias("session"), "position", F.col("s_name").alias("title"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("authors"), F.concat(F.lit("2020-01-0"), F.col("position").cast("string")).alias("published"))
    return N.render_list(rows, "session")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'p' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS active_paper FROM conversations")
def session_active_paper(spark, sf_dir):
    """ST9: the paper opened last at each turn."""
    opened = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.concat(F.lit("p"), F.col("turn").cast("string")))
    return state.active_paper(table(spark, sf_dir, "conversations"), "conv_id", "turn", opened).select("conv_id", "turn", "active_paper")


@query("""SELECT conv_id, turn, CASE WHEN lag(turn % 3 = 0) OVER (PARTITION BY conv_id ORDER BY turn) THEN CASE length(text) % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'stay' WHEN 2 THEN 'stay' ELSE 'cleared' END ELSE 'none' END AS resolved FROM conversations""")
def session_confirm(spark, sf_dir):
    """ST8: pending searches and what answers make of them."""
    kinds = F.array(*[F.lit(k) for k in ("yes", "no", "cancel", "other")])
    turns = table(spark, sf_dir, "conversations").withColumn("kind", F.get(kinds, F.length("text") % 4)).withColumn("asks", F.col("turn") % 3 == 0)
    return state.confirmations(turns, "conv_id", "turn", "kind", "asks")
