"""Queries of vector retrieval and context packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.operators import retrieval as R
from litspan.operators import vector_index as V
from litspan.plans.registering import query
from litspan.sources.scratch import folder
from litspan.sources.tables import table


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_index"), F.col("label").alias("paper"), "embedding")


def _vector(spark, sf_dir, vec_id):
    """One stored vector as a scalar subquery: part of the plan, nothing runs while it is made."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").limit(1).scalar()


COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
HIT = f"SELECT e.vec_id AS chunk_index, e.label AS paper, {COS} AS score, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = %d) q"


@query(f"SELECT chunk_index, score FROM ({HIT % 3} WHERE e.label = 3 ORDER BY raw DESC, chunk_index LIMIT 12)")
def cosine_topk_specific(spark, sf_dir):
    """The twelve nearest chunks of a paper."""
    found = R.top_k(_chunks(spark, sf_dir).where(F.col("paper") == 3), _vector(spark, sf_dir, 3), 12)
    return found.select("chunk_index", F.round("score", 6).alias("score"))


@query(f"SELECT chunk_index, paper, score, row_number() OVER (ORDER BY chunk_index) AS position FROM ({HIT % 7} ORDER BY raw DESC, chunk_index LIMIT 50)")
def cosine_topk_structural(spark, sf_dir):
    """The fifty nearest of the corpus, numbered in document order."""
    from pyspark.sql import Window

    found = R.top_k(_chunks(spark, sf_dir), _vector(spark, sf_dir, 7), 50)
    return found.select("chunk_index", "paper", F.round("score", 6).alias("score"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("chunk_index")).cast("long").alias("position"))


BATCH = f"""SELECT question_id, chunk_index, rank, score FROM (SELECT q.vec_id AS question_id, e.vec_id AS chunk_index, {COS} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
    FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 20 = 0) WHERE rank <= 12"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), F.col("label").alias("paper"), F.col("embedding").alias("vector"))


@query(BATCH)
def cosine_topk_batch(spark, sf_dir):
    """K7 for many questions: each asks its own paper."""
    questions = _questions(spark, sf_dir)
    found = R.top_k_batch(questions, _chunks(spark, sf_dir), 12, ["paper"])
    return found.select("question_id", "chunk_index", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _indexed(spark, sf_dir, keys):
    """Cells, and the index as a stored table."""
    chunks = _chunks(spark, sf_dir)
    cells = V.fit_cells(chunks)
    return chunks, cells, V.save(V.build(chunks, cells, keys), folder(spark, "vector-index"))


@query(BATCH)
def vector_index_topk(spark, sf_dir):
    """L2: the questions of ``cosine_topk_batch`` answered by the index with all cells, which gives the exact rows; few chunks are read in full."""
    chunks, cells, blocks = _indexed(spark, sf_dir, ["paper"])
    found = V.nearest(_questions(spark, sf_dir), blocks, chunks, cells, 12, ["paper"])
    return found.select("question_id", "chunk_index", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query()
def vector_index_probes(spark, sf_dir):
    """L2: the corpus asked by as few cells as find 0.95 of the exact twelve for a hundred of the questions. Approximate, so it has no SQL; tests measure its recall."""
    chunks, cells, blocks = _indexed(spark, sf_dir, [])
    questions = _questions(spark, sf_dir).drop("paper")
    probes, _ = V.calibrated(questions.orderBy(F.xxhash64("question_id")).limit(100), blocks, chunks, cells, 12, [])
    found = V.nearest(questions, blocks, chunks, cells, 12, [], probes)
    return found.select("question_id", "chunk_index", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT paper, chunk_index, score FROM (SELECT label AS paper, vec_id AS chunk_index, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings) WHERE r <= 30")
def tail_chunks(spark, sf_dir):
    """The last thirty chunks of each paper."""
    return R.tail(_chunks(spark, sf_dir).drop("embedding"), "paper").select("paper", "chunk_index", "score")


@query(f"""WITH h AS (SELECT chunk_index, score FROM ({HIT % 5} WHERE e.label = 5 ORDER BY raw DESC, chunk_index LIMIT 20)),
    t AS (SELECT vec_id AS chunk_index FROM embeddings WHERE label = 5 ORDER BY vec_id DESC LIMIT 30)
    SELECT chunk_index, score, 'hit' AS origin FROM h UNION ALL SELECT chunk_index, 0.0, 'tail' FROM t WHERE chunk_index NOT IN (SELECT chunk_index FROM h)""")
def ref_merge_hits(spark, sf_dir):
    """Hits and tail, a hit winning over the same tail chunk."""
    paper = _chunks(spark, sf_dir).where(F.col("paper") == 5)
    hits = R.top_k(paper, _vector(spark, sf_dir, 5), 20).select("chunk_index", F.round("score", 6).alias("score"), F.lit("hit").alias("origin"))
    tails = R.tail(paper.select("paper", "chunk_index"), "paper").select("chunk_index", "score", F.lit("tail").alias("origin"))
    return R.merge_tail(hits, tails, ["chunk_index"])


@query("SELECT doc_id, source FROM documents WHERE source ILIKE '%RC1_%' ESCAPE '\\'")
def section_scan(spark, sf_dir):
    """Everything under headings that match a fragment with a live wildcard."""
    return R.section_scan(table(spark, sf_dir, "documents"), "RC1_", heading="source").select("doc_id", "source")


@query(f"SELECT chunk_index, score FROM ({HIT % 11} WHERE ('part ' || e.label) ILIKE '%RT 1%' ORDER BY raw DESC, chunk_index LIMIT 9)")
def section_topk(spark, sf_dir):
    """K8: the nearest chunks under a heading."""
    named = _chunks(spark, sf_dir).withColumn("section_heading", F.concat(F.lit("part "), F.col("paper").cast("string")))
    return R.top_k(R.section_scan(named, "RT 1"), _vector(spark, sf_dir, 11), 9).select("chunk_index", F.round("score", 6).alias("score"))


@query("""SELECT source, doc_id, CAST(CASE WHEN cum <= 12000 THEN n ELSE 12000 - (cum - n) END AS BIGINT) AS packed_chars FROM
    (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM documents WHERE length(text) > 0)
    WHERE cum <= 12000 OR (cum - n <= 12000 AND 12000 - (cum - n) > 200)""")
def context_pack(spark, sf_dir):
    """Each source's documents while they fit 12 000 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return R.pack_context(docs, "source", [F.asc("doc_id")], "text", 12_000).select("source", "doc_id", F.length("packed").cast("long").alias("packed_chars"))


REFERENCE_SCORE = "CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE CAST(doc_id * 37 % 101 AS DOUBLE) / 101 + 0.001 END"


@query(f"""SELECT source, doc_id, CAST(CASE WHEN cum <= 40000 THEN n ELSE 40000 - (cum - n) END AS BIGINT) AS packed_chars FROM
    (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY CAST({REFERENCE_SCORE} <> 0 AS INT), {REFERENCE_SCORE} DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM documents WHERE length(text) > 0)
    WHERE cum <= 40000 OR (cum - n <= 40000 AND 40000 - (cum - n) > 200)""")
def context_pack_references(spark, sf_dir):
    """The references mode with the tail before the others by score, each source's documents while they fit 40 000 characters; tasks cut before the exchange."""
    n = F.col("doc_id")
    score = F.when(n % 3 == 0, 0.0).otherwise((n * 37 % 101).cast("double") / 101 + 0.001)
    hits = table(spark, sf_dir, "documents").select("source", "doc_id", n.alias("chunk_index"), score.alias("score"), "text")
    packed = R.pack_context(hits, "source", R.hit_order(hits, "references", tail_first=True), "text", R.MODES["references"][1])
    return packed.select("source", "doc_id", F.length("packed").cast("long").alias("packed_chars"))
