"""Queries over documents: chunks, section chunks, statistics, Markdown and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators import chunking
from litspan.plans.registering import query
from litspan.sources.tables import literal, table

BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)"


def after_last(separator: str, reach: int) -> str:
    """DuckDB: the position after the last separator near the end of the window that starts at ``st``."""
    part = f"substring(t, st + 2400 - {reach} + 1, {reach})"
    return f"CASE WHEN position({separator} IN {part}) > 0 THEN st + 2400 - position(reverse({separator}) IN reverse({part})) + 1 END"


def chunk_sql(source: str, keys: str) -> str:
    """DuckDB: chunks of the rows (keys, t) of a query, as CTE ``chunks`` (keys, chunk_index, st, en, piece)."""
    names = [k.strip() for k in keys.split(",")]
    of = ", ".join(f"c.{k}" for k in names)
    split = f"coalesce({after_last('chr(10)||chr(10)', 400)}, {after_last(repr('. '), 200)}, {after_last(repr(' '), 100)}, st + 2400)"
    return f"""
    RECURSIVE src AS ({source}),
    ends AS (SELECT {keys}, t, 0 AS st, CASE WHEN 2400 >= length(t) THEN length(t) ELSE {split.replace('st + 2400', '0 + 2400')} END AS en FROM src WHERE length(t) > 0),
    c AS (
        SELECT {keys}, t, 0 AS n, st, en FROM ends
        UNION ALL
        SELECT {keys}, t, n, st, CASE WHEN st + 2400 >= length(t) THEN length(t) ELSE {split} END AS en
        FROM (SELECT {of}, c.t, c.n + 1 AS n, greatest(c.st + 1, c.en - 400) AS st, c.en AS last FROM c WHERE c.en < length(c.t))
    ),
    chunks AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY n) - 1 AS chunk_index, st, en, trim(substring(t, st + 1, en - st), {BLANKS}) AS piece
        FROM c WHERE trim(substring(t, st + 1, en - st), {BLANKS}) <> '')
    """


DOCS = f"SELECT doc_id, trim(coalesce(text, ''), {BLANKS}) AS t FROM documents"


@query(f"WITH {chunk_sql(DOCS.replace('FROM documents', 'FROM documents'), 'doc_id')} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(st AS BIGINT) AS chunk_start, CAST(en AS BIGINT) AS chunk_end, piece AS chunk_text FROM chunks")
def doc_chunks(spark, sf_dir):
    """Every document in boundary-aware overlapping chunks."""
    found = chunking.chunk(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "chunk_start", "chunk_end")], "chunk_text")


@query(f"WITH {chunk_sql(DOCS, 'doc_id')} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(piece)) AS BIGINT) AS chars, CAST(max(length(piece)) AS BIGINT) AS longest FROM chunks GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    """A1: the number of chunks of each document, and their lengths."""
    found = chunking.chunk(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    size = F.length("chunk_text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(size).cast("long").alias("chars"), F.max(size).cast("long").alias("longest"))


SECTIONS = f"""SELECT doc_id, CAST(i AS INT) AS section_index, '[' || h || ']' || chr(10) || chr(10) || t AS t, h FROM (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS i, trim(unnest(parts), {BLANKS}) AS t, 'part ' || generate_subscripts(parts, 1) AS h
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE t <> ''"""


@query(f"WITH {chunk_sql(SECTIONS, 'doc_id, section_index, h')} SELECT doc_id, section_index, h AS section_heading, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, chunk_index) - 1 AS chunk_index, piece AS chunk_text FROM chunks")
def section_chunks_tagged(spark, sf_dir):
    """Chunks of sections with their heading, numbered through the document."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_index", "content_text"))
    parts = parts.withColumn("heading_text", F.concat(F.lit("part "), (F.col("section_index") + 1).cast("string"))).withColumn("page_start", F.lit(1))
    found = chunking.chunk_sections(parts, paper="doc_id")
    return found.select("doc_id", "section_index", "section_heading", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


@query("SELECT source, count(*) AS papers, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def doc_label_join(spark, sf_dir):
    """Each document with its label, summed by source. The labels are shuffled unless small."""
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("papers"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


PAGES = f"""SELECT page_id, trim(regexp_replace(coalesce(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), '\\s+', ' ', 'g'), {BLANKS}) AS heading,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), {BLANKS}) AS body FROM pages"""


@query(f"SELECT page_id, heading, CAST(length(body) AS BIGINT) AS body_chars, md5(body) AS body_md5 FROM ({PAGES})")
def html_title_body(spark, sf_dir):
    """Heading and body of a page's markup, as page records of the ingest."""
    html = F.col("html")
    heading = T.strip(T.collapse(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    body = T.strip(T.collapse(F.regexp_replace(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1), r"(?s)<[^>]*>", " ")))
    return table(spark, sf_dir, "pages").select("page_id", heading.alias("heading"), F.length(body).cast("long").alias("body_chars"), F.md5(body).alias("body_md5"))


@query()
def markdown_strip(spark, sf_dir):
    """Documents as plain terminal text (thirteen ordered substitutions, some with look-around)."""
    plain = T.strip_markdown(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(plain).cast("long").alias("plain_chars"), F.md5(plain).alias("plain_md5"))
