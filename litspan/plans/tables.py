"""Queries of table maintenance and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.operators import store
from litspan.operators import store_tables as stored
from litspan.plans.registering import query
from litspan.sources.scratch import folder
from litspan.sources.tables import table


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS paper_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE d.source END AS title, CASE WHEN d.doc_id IS NULL THEN 'new' ELSE d.lang END AS status
    FROM documents d FULL JOIN (SELECT doc_id * 2 AS doc_id, quality FROM labels) l ON d.doc_id = l.doc_id""")
def paper_upsert(spark, sf_dir):
    """L4: new metadata updates titles, keeps the status of papers that exist, and adds the others."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.col("lang").alias("status"))
    new = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("paper_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("title"), F.lit("new").alias("status"))
    return store.upsert(old, new, "paper_id", ["title"])


@query("SELECT doc_id, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'new' FROM labels WHERE toxic = 1")
def paper_replace_partition(spark, sf_dir):
    """Whole papers replaced."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("version"))
    return store.replace(old, table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("new").alias("version")), "doc_id")


@query("SELECT status, count(*) AS papers, sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END)::BIGINT AS errors FROM (SELECT CASE WHEN doc_id % 11 = 0 OR length(text) < 400 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'x' WHEN length(text) < 400 THEN 'y' END AS error FROM documents) GROUP BY status")
def paper_lifecycle(spark, sf_dir):
    """L6, P36, ST11: statuses after an ingest."""
    down = F.when(F.col("doc_id") % 11 == 0, F.lit("PDF not found (404)"))
    status, error = store.lifecycle(down, F.lit(True), F.length("text") >= 400)
    outcome = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), status.alias("status"), F.nullif(error, F.lit("")).alias("error_msg"))
    papers = outcome.select("paper_id", F.lit("processing").alias("status"), F.lit("old").alias("error_msg"))
    marked = store.mark(papers, outcome)
    return marked.groupBy("status").agg(F.count("*").alias("papers"), F.count_if(F.col("error_msg").isNotNull()).alias("errors"))


@query("SELECT doc_id, NOT (coalesce(quality, 0) = 1 AND length(text) > 2000) AS needs_ingest FROM documents LEFT JOIN labels USING (doc_id)")
def ingest_needed(spark, sf_dir):
    """E9's first step: papers that are ready and have chunks are left alone."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", store.needs_ingest(F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "processing"), F.when(F.length("text") > 2000, 3)).alias("needs_ingest"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def cascade_delete(spark, sf_dir):
    """Children whose paper is gone go too."""
    papers = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return store.cascade(table(spark, sf_dir, "labels").select("doc_id"), papers, "doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 77")
def paper_get(spark, sf_dir):
    """A paper by its id, pushed down to the scan."""
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 77).select("doc_id", "lang", "source").limit(1)


@query("SELECT source, n_chunks, n_sections FROM (SELECT source, count(*) AS n_chunks, count(DISTINCT lang) AS n_sections FROM documents GROUP BY source)")
def chunk_count(spark, sf_dir):
    """A1: chunks and sections of each paper."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("lang").alias("n_sections"))


def _papers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 3 == 0, "ready").when(F.col("doc_id") % 3 == 1, "").alias("status"), F.lit("References").alias("reference_heading"), F.col("n_chars").cast("long").alias("reference_count"), "source")


@query("SELECT doc_id AS paper_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE 'References' END AS reference_heading, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE n_chars END::BIGINT AS reference_count FROM documents")
def references_cleared(spark, sf_dir):
    """What is known of references is taken back for chosen papers."""
    chosen = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("paper_id"))
    return store.clear_references(_papers(spark, sf_dir), chosen).drop("status")


@query("SELECT l.doc_id * 2 AS paper_id, CASE WHEN d.doc_id IS NOT NULL AND d.doc_id % 3 = 0 THEN 'ready' ELSE 'not_found' END AS status FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2")
def paper_statuses(spark, sf_dir):
    """Statuses of requested papers."""
    asked = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("paper_id"))
    return store.statuses(asked, _papers(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(NULL AS VARCHAR) AS title, CAST(n_chars AS INT) AS reference_count, 20 AS n_columns FROM documents")
def paper_schema(spark, sf_dir):
    """L1: rows brought to the declared columns and types."""
    found = store.declared(_papers(spark, sf_dir), store.PAPERS)
    return found.select("paper_id", "title", "reference_count", F.lit(len(found.columns)).alias("n_columns"))


@query("""SELECT r.doc_id AS paper_id, CASE WHEN r.doc_id % 13 = 0 THEN 503 ELSE 200 END AS code, CASE WHEN r.doc_id % 13 = 0 THEN NULL WHEN r.doc_id % 5 = 0 THEN 'failed' WHEN d.doc_id % 3 = 0 AND n > 0 THEN 'already_ready' ELSE 'accepted' END AS status,
    CASE WHEN r.doc_id % 13 = 0 THEN 'Paper store not available (POSTGRES_DSN missing or DB init failed).' WHEN r.doc_id % 5 = 0 THEN 'No PDF URL is available for this paper.' WHEN d.doc_id % 3 = 0 AND n > 0 THEN 'Paper downloaded.' END AS message,
    CASE WHEN r.doc_id % 13 <> 0 AND r.doc_id % 5 <> 0 AND d.doc_id % 3 = 0 AND n > 0 THEN n ELSE 0 END::BIGINT AS chunks
    FROM (SELECT doc_id * 2 AS doc_id FROM labels) r LEFT JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents WHERE doc_id % 4 <> 0) GROUP BY doc_id) c USING (doc_id)""")
def ingest_requests(spark, sf_dir):
    """Requests to ingest: no store, no url, already ready, accepted."""
    p = F.col("paper_id")
    asked = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("paper_id")).select("paper_id", F.when(p % 5 != 0, "http://c.org/x.pdf").otherwise(" ").alias("pdf_url"), (p % 13 != 0).alias("store_up"))
    chunks = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("paper_id"), F.explode(F.split("text", "\n")).alias("c")).select("paper_id")
    return store.ingest_answers(asked, _papers(spark, sf_dir), chunks).select("paper_id", "code", "status", "message", "chunks")


@query("""SELECT doc_id, source, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(max(length(line)) AS BIGINT) AS longest FROM (
    SELECT doc_id, source, CASE WHEN doc_id % 20 = 3 THEN 'new ' ELSE '' END || unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 20 <> 4) GROUP BY doc_id, source""")
def store_layout(spark, sf_dir):
    """Chunks and papers stored in buckets by paper; one paper of twenty is replaced, one deleted; chunks are summed and joined to papers without an exchange."""
    docs = table(spark, sf_dir, "documents")
    cut = lambda df, before: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).withColumn("line", F.concat(F.lit(before), "line"))
    layout = stored.Layout("doc_id", ("chunk_index",))
    papers = stored.Layout("doc_id").write(docs.where("doc_id % 20 <> 4").select("doc_id", "source"), stored.version(spark, "papers"), folder(spark, "papers"))
    chunks = layout.write(cut(docs, ""), stored.version(spark, "chunks"), folder(spark, "chunks"))
    again = docs.where("doc_id % 20 = 3")
    chunks = layout.replaced(chunks, cut(again, "new "), docs.where("doc_id % 20 IN (3, 4)").select("doc_id"), stored.version(spark, "chunks"), folder(spark, "chunks"))
    size = F.length("line")
    summed = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("chars"), F.max(size).cast("long").alias("longest"))
    return stored.joined(papers, summed, "doc_id").select("doc_id", "source", "n", "chars", "longest")
