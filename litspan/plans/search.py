"""Queries of structured search and its keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators import postings, ranks
from litspan.operators import search as S
from litspan.plans.documents import BLANKS
from litspan.plans.registering import query
from litspan.sources.scratch import folder
from litspan.sources.tables import literal, table


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'for that') AND lang = 'en'")
def search_topic_filter(spark, sf_dir):
    """a topic and a category, pushed to the scan as far as it goes."""
    r = S.Request(topic="For 'That'", categories=("en", " ")).check()
    docs = table(spark, sf_dir, "documents")
    return docs.where(S.predicate(r, F.lit(""), F.col("text"), F.col("source"), F.lit(None), F.col("lang"))).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(source), 'src1') AND lang IN ('en', 'fr')")
def search_multi_predicate(spark, sf_dir):
    """F1 to F8: the conjunction of topic, author and categories."""
    r = S.Request(topic="tion", author="SRC1", categories=("en", "fr")).check()
    docs = table(spark, sf_dir, "documents")
    return docs.where(S.predicate(r, F.lit(""), F.col("text"), F.col("source"), F.lit(None), F.col("lang"))).select("doc_id", "lang", "source")


@query(f"""WITH d AS (SELECT doc_id, lower(substring(text, 1, 60)) AS t, lower(text) AS b FROM documents), r AS (SELECT item_id, lower(trim(substring(text, 5, 8), {BLANKS})) AS w FROM benchmark),
    x AS (SELECT item_id, doc_id, CAST(2 * ((length(t) - length(replace(t, w, ''))) // length(w)) + (length(b) - length(replace(b, w, ''))) // length(w) AS INTEGER) AS relevance FROM r, d WHERE w <> '' AND contains(b, w))
    SELECT item_id, rank, doc_id, relevance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS INTEGER) AS rank FROM x) WHERE rank <= 10""")
def search_topics_indexed(spark, sf_dir):
    """A table of topics asked at once, by an inverted index that is stored and read again."""
    papers = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"))
    index = postings.save(postings.build(papers, "doc_id"), folder(spark, "topic-index"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 5, 8).alias("topic"))
    return postings.top(asked, index, papers, 10, request="item_id", paper="doc_id")


@query("SELECT position, doc_id, score FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'tion')) AS BIGINT) AS score FROM documents WHERE contains(lower(text), 'tion'))) WHERE position > 20 AND position <= 30")
def search_page_offset_limit(spark, sf_dir):
    """The third page of ten by relevance, ties by id."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("tion")))
    scored = docs.select("doc_id", S.relevance("tion", F.lit(""), F.col("text")).cast("long").alias("score"))
    return S.page(scored, [F.desc("score"), F.asc("doc_id")], 20, 10).select(F.col("position").cast("long").alias("position"), "doc_id", "score")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 5) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def search_seek(spark, sf_dir):
    """K2: a page deep in an order, from the last row of the page before it."""
    found = S.seek(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], (200_000.0, 5), 25)
    return found


@query("SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'tion')")
def search_total_count(spark, sf_dir):
    """S3: the total of a search."""
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("tion"))).agg(F.count("*").alias("total"))


@query("SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y%m%d%H%M') BETWEEN '199501010000' AND '199612312359' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def order_year_range(spark, sf_dir):
    """an inclusive range of years, given in reverse."""
    r = S.Request(from_year=1996, to_year=1995, categories=("1-URGENT", "2-HIGH")).check()
    orders = table(spark, sf_dir, "orders")
    found = orders.where(S.predicate(r, F.lit(""), F.lit(""), F.lit(""), F.col("o_orderdate"), F.col("o_orderpriority")))
    return found.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, year(o_orderdate) BETWEEN 1994 AND 1995 AS between_years, false AS reversed_years, year(o_orderdate) >= 1995 AS since, o_orderkey % 7 <> 0 AND year(o_orderdate) <= 1994 AS until, true AS unbounded FROM orders""")
def order_year_match(spark, sf_dir):
    """bounds on either side; reversed ones aren't swapped in a session, an unknown year matches no bound."""
    dated = table(spark, sf_dir, "orders").withColumn("y", T.published_year(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")))
    y, some = F.col("y"), F.when(F.col("o_orderkey") % 7 != 0, F.col("y"))
    told = {"between_years": (y, 1994, 1995), "reversed_years": (y, 1995, 1994), "since": (y, 1995, None), "until": (some, None, 1994), "unbounded": (some, None, None)}
    return dated.select("o_orderkey", *[S.year_match(*args).alias(name) for name, args in told.items()])


KEYED = f"regexp_replace(translate(lower(trim(%s, {BLANKS})), '\"''', ''), '\\s+', ' ', 'g')"


@query(f"SELECT doc_id, md5({KEYED % 'text'}) AS topic_md5, {KEYED % 'source'} AS author FROM documents")
def normalize_topic_key(spark, sf_dir):
    """Topics and authors as keys."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.topic_key(F.col("text"))).alias("topic_md5"), T.author_key(F.col("source")).alias("author"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform([p_brand, ' ' || p_type || ' ', '', ' ', p_brand], lambda x: trim(x)), lambda x: x <> ''))), ',') AS category_key,
    CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_size || '-' WHEN p_size % 4 = 2 THEN '-' || p_size ELSE p_size || '-' || p_size END AS year_key FROM part""")
def category_key(spark, sf_dir):
    """Categories and years as keys."""
    part = table(spark, sf_dir, "part")
    names = F.array("p_brand", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""), F.lit(" "), "p_brand")
    low = F.when((F.col("p_size") % 4).isin(1, 3), F.col("p_size"))
    high = F.when((F.col("p_size") % 4).isin(2, 3), F.col("p_size"))
    return part.select("p_partkey", T.category_key(names).alias("category_key"), T.year_key(low, high).alias("year_key"))


@query(f"SELECT doc_id, sha256({KEYED % 'text'} || '|' || {KEYED % 'source'} || '|' || lang || '|2001-|relevance|descending|10') AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    """P5: the key of a search in the cache, hashed."""
    docs = table(spark, sf_dir, "documents")
    parts = [T.topic_key(F.col("text")), T.author_key(F.col("source")), T.category_key(F.array("lang")), T.year_key(F.lit(2001), F.lit(None).cast("int")), F.lit("relevance"), F.lit("descending"), F.lit("10")]
    return docs.select("doc_id", F.sha2(F.concat_ws("|", *parts), 256).alias("cache_key"))


IDS = "('arxiv:2308.01234v2'), ('http://x.org/abs/2308.01234v1'), ('2003.10303'), ('solv-int/9901001v2'), ('  ARXIV:1V2 '), ('abc'), ('v'), ('1v2v3'), ('x/abs/y/abs/zv7'), ('')"


@query(f"""SELECT id, trim(CASE WHEN contains(t, 'v') AND regexp_matches(split_part(t, 'v', -1), '^[0-9]+$') THEN split_part(t, 'v', 1) ELSE t END) AS paper_key, split_part(CASE WHEN contains(id, '/abs/') THEN split_part(id, '/abs/', -1) ELSE id END, 'v', 1) AS entry_id FROM
    (SELECT id, regexp_replace(CASE WHEN contains(lower(trim(id)), '/abs/') THEN split_part(lower(trim(id)), '/abs/', -1) ELSE lower(trim(id)) END, '^arxiv:', '') AS t FROM (SELECT url AS id FROM pages UNION ALL VALUES {IDS}))""")
def id_normalize(spark, sf_dir):
    """Paper ids of requests and of feed entries."""
    ids = table(spark, sf_dir, "pages").select(F.col("url").alias("id")).union(literal(spark, "id", IDS))
    return ids.select("id", T.paper_id_key(F.col("id")).alias("paper_key"), T.entry_id(F.col("id")).alias("entry_id"))


@query("""SELECT s_nationkey, array_to_string((l)[1:6], ', ') || CASE WHEN len(l) > 6 THEN ', et al.' ELSE '' END AS preview, array_to_string(list_prepend(l[len(l)], l[1:len(l) - 1])[1:8], ', ') || CASE WHEN len(l) > 8 THEN ', et al.' ELSE '' END AS preferred,
    array_to_string(l, ', ') AS stored FROM (SELECT s_nationkey, list(s_name ORDER BY s_suppkey) AS l FROM supplier GROUP BY s_nationkey)""")
def author_preview(spark, sf_dir):
    """The first authors, the one searched for in front."""
    grouped = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"]).alias("a"))
    last = F.upper(F.element_at("a", -1))
    return grouped.select("s_nationkey", T.author_preview(F.col("a")).alias("preview"), T.author_preview(F.col("a"), 8, last).alias("preferred"), T.join_authors(F.col("a")).alias("stored"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'undated' END AS published, CASE WHEN o_orderkey % 3 < 2 THEN CAST(year(o_orderdate) AS INT) END AS year FROM orders""")
def published_date_parse(spark, sf_dir):
    """The date and year of published stamps in three forms."""
    orders = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 3
    stamp = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("undated"))
    return orders.select("o_orderkey", T.published_date(stamp).alias("published"), T.published_year(stamp).alias("year"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) > 900 THEN rtrim(substring(trim(text), 1, 900)) || '...' ELSE trim(text) END AS summary FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)""")
def summary_clip(spark, sf_dir):
    """Summaries of at most 900 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clip_summary(F.translate("text", "\n", " ")).alias("summary"))


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' by ' || source ELSE '' END || CASE doc_id % 5 WHEN 0 THEN ' between 1999 and 2005' WHEN 1 THEN ' from 1999' WHEN 2 THEN ' until 2005' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' in cs.CL, stat.ML' ELSE '' END), ''), '(search)') AS described FROM documents""")
def search_description(spark, sf_dir):
    """A search in words."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    cats = F.when(n % 7 == 0, F.array(F.lit("cs.CL"), F.lit("stat.ML")))
    first, last = F.when((n % 5).isin(0, 1), F.lit(1999)), F.when((n % 5).isin(0, 2), F.lit(2005))
    return docs.select("doc_id", T.describe_search(F.when(n % 2 == 0, F.col("lang")), F.when(n % 3 == 0, F.col("source")), first, last, cats).alias("described"))


@query("SELECT o_custkey, CAST(b AS INT) AS start_at, CAST(least(200, 5000 - b, total - b) AS INT) AS size FROM (SELECT o_custkey, total, unnest(range(0, least(4000, 5000, total), 200)) AS b FROM (SELECT o_custkey, CAST((sum(CAST(round(o_totalprice * 100) AS BIGINT)) + 50000) // 100000 AS INT) AS total FROM orders GROUP BY o_custkey))")
def prefetch_plan(spark, sf_dir):
    """K5: in which chunks sessions load their results, each by its own total (a thousandth of the sum in whole cents, halves up)."""
    # in whole cents, halves up: a sum of doubles depends on the order of its rows
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.floor((cents + 50000).cast("decimal(20,0)") / 100000).cast("int").alias("total"))
    return S.chunk_plans(totals, 4000).select("o_custkey", "start_at", "size")


@query("""SELECT position, o_orderkey, total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position, count(*) OVER () AS total FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND year(o_orderdate) BETWEEN 1996 AND 1999 AND contains(lower(o_orderstatus), 'f')) WHERE position BETWEEN 41 AND 65""")
def search_request(spark, sf_dir):
    """A request's page by date, and its total."""
    orders = table(spark, sf_dir, "orders")
    papers = orders.select(F.col("o_orderkey").alias("paper_id"), F.lit("").alias("title"), F.lit("").alias("abstract"), F.col("o_orderstatus").alias("authors"), F.col("o_orderdate").alias("published"), F.col("o_orderdate").alias("updated"), F.col("o_orderpriority").alias("category"))
    r = S.Request(author="F", from_year=1996, to_year=1999, categories=("1-URGENT", "3-MEDIUM"), start=40, max_results=25, sort_by="submittedDate")
    found, total = S.search(papers, r)
    return found.crossJoin(total).select(F.col("position").cast("long").alias("position"), F.col("paper_id").alias("o_orderkey"), "total")


@query("SELECT o_custkey, count(*) AS loaded, CAST(count(*) // 10 AS BIGINT) AS full_pages, count(*) > 10 AS has_more FROM orders GROUP BY o_custkey")
def session_meta(spark, sf_dir):
    """Counters of a session."""
    return S.session_meta(table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 5 > 1 AND o_custkey % 3 > 0 THEN 'a search needs a topic, an author, a year or a category' WHEN o_orderkey % 5 = 0 AND y < 1995 THEN 'year ' || (y - 100) || ' is not between 1900 and 2100'
    WHEN n NOT BETWEEN 1 AND 500 OR o_custkey % 11 = 0 THEN 'max_results is 1 to 500 and start 0 or more' WHEN o_custkey % 7 = 0 THEN 'unknown order' END AS refused FROM (SELECT *, CAST(year(o_orderdate) AS INT) AS y, CAST(o_custkey % 600 AS INT) AS n FROM orders)""")
def search_refusals(spark, sf_dir):
    """which requests of a table are refused, and why."""
    k, c, y = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    low = F.when(k % 5 == 0, F.when(y < 1995, y - 100).otherwise(y)).when(k % 5 == 1, y)
    cats = F.when(c % 3 == 0, F.array(F.lit(" "), F.lit("cs.CL"))).otherwise(F.array(F.lit(" ")))
    size, start = (c % 600).cast("int"), F.when(c % 11 == 0, -1).otherwise(0)
    why = S.refusal(F.when(k % 4 != 0, "nets").otherwise(" "), F.when(k % 3 == 1, "Ann"), low, F.lit(None).cast("int"), cats, size, start, F.when(c % 7 == 0, "size").otherwise("relevance"), F.lit("descending"))
    return table(spark, sf_dir, "orders").select("o_orderkey", why.alias("refused"))


DEEP = [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False)]


@query("""SELECT position, l_extendedprice, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position, count(*) OVER () // 2 AS half FROM lineitem)
    WHERE position > half AND position <= half + 50""")
def search_page_deep(spark, sf_dir):
    """K2: fifty rows from the middle of an order; counts by range find where it is, only that range is sorted."""
    rows = table(spark, sf_dir, "lineitem").select(*[n for n, _ in DEEP])
    index = ranks.rank_index(rows, DEEP)
    return ranks.page_at(rows, index, index.total // 2, 50).select(F.col("position").cast("long").alias("position"), "l_extendedprice", "l_orderkey", "l_linenumber")
