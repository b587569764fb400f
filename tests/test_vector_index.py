"""The index of vectors: exact with all cells, recall with few, and how much of the table is read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspan.operators import retrieval as R
from litspan.operators import vector_index as V
from litspan.plans import registry
from litspan.sources.scratch import folder

K = 12


def clustered(spark, centers=40, each=50, size=16):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(centers, size))
    points = (middle[:, None] + rng.normal(size=(centers, each, size)) * 0.25).reshape(-1, size)
    rows = [(k, k % 3, p.tolist()) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "chunk_index long, paper int, embedding array<double>").repartition(4)


def asking(chunks, every=20):
    return chunks.where(F.col("chunk_index") % every == 0).select(F.col("chunk_index").alias("question_id"), "paper", F.col("embedding").alias("vector"))


def rows(df):
    return sorted((r.question_id, r["rank"], r.chunk_index) for r in df.collect())


def test_few_probes_on_clustered_vectors(spark):
    """With 0.95 of the exact hits found, a question reads less than a fifth of the codes, and less than a fiftieth of the chunks in full."""
    chunks = clustered(spark)
    cells = V.fit_cells(chunks)
    path = folder(spark, "cells")
    blocks = V.save(V.build(chunks, cells, []), path)
    questions = asking(chunks).drop("paper")
    exact = {(q, c) for q, _, c in rows(R.top_k_batch(questions.withColumn("one", F.lit(1)), chunks.withColumn("one", F.lit(1)), K, ["one"]))}
    probes, recall = V.calibrated(questions, blocks, chunks, cells, K, [])
    found = {(q, c) for q, _, c in rows(V.nearest(questions, blocks, chunks, cells, K, [], probes))}
    assert len(found & exact) / len(exact) == pytest.approx(recall) and recall >= 0.95
    share = V.asked(questions, cells, [], probes).join(blocks, "cell").select((F.size("asked") * F.size("ids")).alias("n")).agg(F.sum("n")).first()[0] / (questions.count() * chunks.count())
    assert share < 0.2
    assert V.candidates(questions, blocks, cells, K, [], probes).count() < 0.02 * questions.count() * chunks.count()
    one = blocks.where(F.col("cell") == 3)
    assert len(one.inputFiles()) <= len(blocks.inputFiles()) and "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("keys", [[], ["paper"]])
def test_all_cells_give_the_exact_rows(spark, keys, monkeypatch):
    """With vectors that are null, zero, broken, of another length and repeated; each question asks its paper, or everything."""
    chunks = clustered(spark, 10, 12)
    odd = [(900, 1, None), (901, 1, []), (902, 1, [0.0] * 16), (903, 1, [1.0] * 15), (904, 1, [None] + [1.0] * 15), (905, 2, [1.0] * 16), (906, 2, [1.0] * 16), (907, 7, [2.0] * 16), (908, None, [1.0] * 16)]
    chunks = chunks.union(spark.createDataFrame(odd, chunks.schema))
    cells = V.fit_cells(chunks, cells=6)
    blocks = V.build(chunks, cells, keys)
    questions = asking(chunks, 7).where("chunk_index not in (901, 903, 904)" if False else "true")
    questions = questions.where(~F.col("question_id").isin(903)).union(spark.createDataFrame([(5000, 7, [1.0] * 16), (5001, 2, None)], "question_id long, paper int, vector array<double>"))
    if not keys:
        questions = questions.drop("paper")
    exact = R.top_k_batch(questions.withColumn("one", F.lit(1)), chunks.where(F.col("embedding").isNull() | (F.size("embedding") != 15)).withColumn("one", F.lit(1)).drop(*([] if keys else ["paper"])), K, [*keys, "one"])
    got = V.nearest(questions, blocks, chunks.where(F.col("embedding").isNull() | (F.size("embedding") != 15)), cells, K + 3, keys)
    mine = [(q, c) for q, r, c in rows(got) if c != 903]
    per = {}
    for q, c in mine:
        per.setdefault(q, []).append(c)
    want = {}
    for q, _, c in rows(exact):
        want.setdefault(q, []).append(c)
    assert {q: c[:K] for q, c in per.items()} == want


def test_no_vectors(spark):
    chunks = spark.createDataFrame([(1, 0, None), (2, 0, [])], "chunk_index long, paper int, embedding array<double>")
    cells = V.fit_cells(chunks)
    questions = spark.createDataFrame([(7, [1.0])], "question_id long, vector array<double>")
    assert rows(V.nearest(questions, V.build(chunks, cells, []), chunks, cells, 5, [])) == [(7, 1, 1), (7, 2, 2)]
    nothing = chunks.where("false")
    assert V.nearest(questions, V.build(nothing, V.fit_cells(nothing), []), nothing, V.fit_cells(nothing), 5, []).count() == 0


def test_query_of_few_probes(spark, sf_dir):
    """Recall over the given vectors, which have no clusters: the probes follow, the chunks read in full stay few."""
    found = {(r.question_id, r.chunk_index) for r in registry.QUERIES["vector_index_probes"](spark, sf_dir).collect()}
    chunks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_index"), F.col("label").alias("paper"), "embedding")
    questions = asking(chunks).drop("paper")
    exact = {(q, c) for q, _, c in rows(R.top_k_batch(questions.withColumn("one", F.lit(1)), chunks.withColumn("one", F.lit(1)), K, ["one"]))}
    assert len(found & exact) / len(exact) >= 0.93
    cells = V.fit_cells(chunks)
    read = V.candidates(questions, V.build(chunks, cells, []), cells, K, []).count()
    assert read < 0.2 * questions.count() * chunks.count()


def test_pairs_of_questions_and_chunks_are_no_rows(spark, monkeypatch):
    """The hits of a plain comparison of all pairs, in several blocks of both sides; what is shuffled is vectors and at most k rows for each question and block."""
    monkeypatch.setattr(R, "BLOCK", (16, 50))
    chunks = clustered(spark, 10, 40).union(spark.createDataFrame([(900 + k, k % 3, [1.0] * 16) for k in range(40)], "chunk_index long, paper int, embedding array<double>"))
    questions = asking(chunks, 5)
    both = questions.withColumn("vector", R.unit(F.col("vector"))).join(chunks.withColumn("embedding", R.unit(F.col("embedding"))), "paper").withColumn("score", R.dot(F.col("embedding"), F.col("vector")))
    pairs: dict[int, list] = {}
    for r in both.select("question_id", "score", "chunk_index").collect():
        pairs.setdefault(r.question_id, []).append((-r.score, r.chunk_index))
    expected = sorted((q, k + 1, c, -s) for q, hits in pairs.items() for k, (s, c) in enumerate(sorted(hits)[:K]))
    found = R.top_k_batch(questions, chunks.withColumn("text", F.col("chunk_index").cast("string")), K, ["paper"])
    assert sorted((r.question_id, r["rank"], r.chunk_index, r.score) for r in found.collect()) == expected
    assert found.where("text = chunk_index").count() == len(expected)
    plan = found._jdf.queryExecution().analyzed().toString().lower()
    assert "cogroup" in plan and "zip_with" not in plan
