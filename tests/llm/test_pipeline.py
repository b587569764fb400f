"""The queries' contracts on the smallest tables, and the pipeline against its own rules."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from litspan.llm import ngrams, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, sf_dir, name):
    table = {"op1": "embeddings", "op2": "pages", "op5": "pages"}.get(name.split("_")[0], "documents")
    rows = queries.QUERIES[name](spark, sf_dir)
    if name.startswith(("op12", "op13")):
        assert rows.count()  # held against their SQL below
        return
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert rows.count() == n if name != "op10_packing" else rows.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**7, None, "en", None, 0), (10**7 + 1, "12 34", "en", "x", 5), (10**7 + 2, "the that for with and", None, "x", 21), (10**7 + 2, "the that for with and", None, "x", 21)], docs.schema)
    columns, docs, seen = docs.columns, docs.union(odd), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert docs.columns == columns
        seen.append((before, docs))
    kept = {r.doc_id for r in seen[0][1].collect()}
    assert not kept & {10**7, 10**7 + 1} and 10**7 + 2 in kept and len(kept) == seen[0][0].select("doc_id").distinct().count() - 2
    groups = ngrams.jaccard_join(seen[1][0]).select("doc_id", "component_id").distinct().collect()
    assert {r.doc_id for r in seen[1][1].collect()} == {r.component_id for r in groups}
    assert seen[1][1].where(f"doc_id = {10**7 + 2}").count() == 1
    assert seen[2][1].count() == seen[2][0].count() and seen[2][1].where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
    assert seen[3][1].select("doc_id").distinct().count() == seen[3][0].count()


def test_pipeline_of_no_documents(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_repeated_ids(spark, sf_dir):
    """One id with different texts, null ids, and extra columns with the names that the stages use inside."""
    say = "the cat and the dog went to the house with the man and they said that it was good for all of them"
    near = say.replace("good", "fine")
    rows = [(1, say), (1, say), (1, "write to a@b.org about the house and the garden that they have"), (2, say), (3, near + " indeed"), (None, say), (None, "another text that is for the people of the town and the land"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or ""), 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, mark int, Words int, language_ int, spans int, row_key int")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, sf_dir)
    assert first.columns == docs.columns and sorted((r.doc_id or 0 for r in first.collect())) == [0, 0, 1, 1, 1, 2, 3]
    second = stages["near_duplicates"](spark, first, sf_dir)
    assert second.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text[:5]) for r in second.collect()) == [(0, "anoth"), (1, "the c"), (1, "write"), (3, "the c")]
    third = stages["personal_data"](spark, second, sf_dir)
    assert third.columns == docs.columns and sorted(r.text[:16] for r in third.collect() if r.doc_id == 1) == ["the cat and the ", "write to [EMAIL]"]
    assert all((r.mark, r.Words, r.language_, r.spans, r.row_key) == (1, 2, 3, 4, 5) and r.n_chars == len(r.text) for r in third.collect())
    assert stages["packing"](spark, third, sf_dir).count() >= 4
