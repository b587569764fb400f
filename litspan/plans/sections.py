"""Queries of section assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators import sections as X
from litspan.plans.headings import SHIFTED
from litspan.plans.registering import query
from litspan.sources.tables import literal, table


@query(f"""WITH p AS ({SHIFTED}), h AS (SELECT DISTINCT paper, s::INT AS page_start, s::INT + 4 AS page_end, 'part ' || s AS heading FROM (SELECT paper, unnest(range(1, max(page) + 1, 4)) AS s FROM p GROUP BY paper)),
    j AS (SELECT h.paper, page_start, string_agg(text, chr(10) || chr(10) ORDER BY page) AS content FROM h JOIN p ON p.paper = h.paper AND p.page BETWEEN greatest(1, page_start - 1) AND page_end AND trim(text, ' ' || chr(10)) <> '' GROUP BY ALL)
    SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY page_start) - 1 AS INT) AS section_index, page_start, CAST(length(trim(content, ' ' || chr(10))) AS INT) AS content_length, md5(trim(content, ' ' || chr(10))) AS content_md5 FROM j""")
def section_page_join(spark, sf_dir):
    """Sections from the texts of their pages and the page before."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select((F.col("doc_id") % 50).alias("paper"), (F.floor(F.col("doc_id") / 50) + 1).cast("int").alias("page"), "text")
    starts = pages.groupBy("paper").agg(F.max("page").alias("last")).select("paper", F.explode(F.sequence(F.lit(1), "last", F.lit(4))).alias("page_start"))
    heads = starts.select("paper", "page_start", (F.col("page_start") + 4).alias("page_end"), F.concat(F.lit("part "), F.col("page_start").cast("string")).alias("heading"))
    return X.build(heads, pages).select("paper", "section_index", "page_start", "content_length", F.md5("content_text").alias("content_md5"))
