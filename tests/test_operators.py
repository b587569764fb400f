from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspan.operators import references, retrieval, state, store, titles
from litspan.operators.search import Request, chunk_plan, query_text


def test_requests_that_are_refused():
    for bad in (Request(), Request(topic=" "), Request(from_year=1800), Request(topic="x", max_results=501), Request(topic="x", start=-1), Request(topic="x", sort_by="size")):
        with pytest.raises(ValueError):
            bad.check()
    assert Request(categories=("cs.CL",)).check()


def test_query_text():
    r = Request(topic='"deep" nets', author="O'Neil", from_year=2021, to_year=2019, categories=("cs.CL", " ", "cs.LG"))
    assert query_text(r) == '(ti:"deep nets" OR abs:"deep nets") AND au:"ONeil" AND submittedDate:[201901010000 TO 202112312359] AND (cat:cs.CL OR cat:cs.LG)'
    assert query_text(Request()) == ""


def test_chunk_plan_stops_at_the_cap():
    assert chunk_plan(0, 450) == [(0, 200), (200, 200), (400, 200)]
    assert chunk_plan(4900, 9999) == [(4900, 100)]


@pytest.mark.parametrize(("sizes", "budget", "kept"), [([500, 500, 500], 1200, [500, 500]), ([500, 500, 500], 1400, [500, 500, 400]), ([2400] * 3, 2400, [2400]), ([100], 50, []), ([900], 500, [500])])
def test_packing_of_contexts(spark, sizes, budget, kept):
    hits = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "q int, i int, body string")
    out = retrieval.pack_context(hits, "q", [F.asc("i")], "body", budget)
    assert [len(r.packed) for r in out.orderBy("i").collect()] == kept


def test_wildcards_of_section_fragments(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a\\qb",), ("50% off",)], "h string")
    like = lambda f: {r.h for r in df.where(retrieval.section_like(F.col("h"), f)).collect()}
    assert like("A_B") == {"a_b", "axb"} and like("\\_") == {"a_b"} and like("\\q") == {"a\\qb"} and like("50\\%") == {"50% off"}


def brute_run(numbers):
    seen, order = set(), []
    for n in numbers:
        if n not in seen:
            seen.add(n)
            order.append(n)
    best, run = [], []
    for n in order:
        run = [*run, n] if run and n == run[-1] + 1 else [n]
        if len(run) > len(best):
            best = run
    return best


def test_longest_runs(spark):
    rng = random.Random(3)
    lists = [[1, 2, 3, 7, 8], [1, 2, 3, 2, 4, 5], [5, 9, 3], [1, 2, 5, 6]] + [[rng.randint(1, 9) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    df = spark.createDataFrame([(p, i, n) for p, x in enumerate(lists) for i, n in enumerate(x)], "paper int, pos int, n int")
    for r in references.longest_run(df, "paper").collect():
        best = brute_run(lists[r.paper])
        assert (r.run_start, r.run_length, r.run_end) == (best[0], len(best), best[-1])


def test_fuzzy_ratio_of_the_fixture(spark):
    asked = spark.createDataFrame([(1, "Responsible AI in healthcare"), (2, "")], "request_id int, query string")
    papers = spark.createDataFrame([(1, "Responsible AI for Healthcare"), (2, "Bananas")], "paper_id int, title string")
    found = titles.fuzzy_titles(asked, papers).collect()
    assert [(r.request_id, r.paper_id, round(r.ratio, 6), r.accepted) for r in found] == [(1, 1, 0.912281, True)]


def test_upsert_takes_the_last_new_row(spark):
    old = spark.createDataFrame([("a", "A", "ready"), ("b", "B", "ready")], "k string, title string, status string")
    new = spark.createDataFrame([("a", "A1", "x", 1), ("a", "A2", "x", 2), ("c", "C", "x", 1)], "k string, title string, status string, at int")
    out = store.upsert(old, new, "k", ["title"], order="at")
    assert sorted(tuple(r) for r in out.collect()) == [("a", "A2", "ready"), ("b", "B", "ready"), ("c", "C", "x")]


def test_partition_overwrite_keeps_other_papers(spark, tmp_path):
    path = str(tmp_path / "chunks")
    store.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "paper_bucket int, t string"), path)
    store.write_partitions(spark.createDataFrame([(2, "c")], "paper_bucket int, t string"), path)
    assert sorted((r.paper_bucket, r.t) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_cache_serves_stale_only_after_a_failure(spark):
    log = [(1, 0.0, False), (2, 5.0, True), (3, 11.0, True), (4, 12.0, False), (5, 40.0, True), (6, 90.0, True)]
    df = spark.createDataFrame([("k", *r) for r in log], "key string, i int, s double, down boolean")
    out = state.cache_replay(df, "key", "s", "i", failed="down", ttl=10, stale=20)
    assert [r.outcome for r in out.orderBy("i").collect()] == ["MISS", "HIT", "STALE", "MISS", "STALE", "ERROR"]


def test_token_bucket(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([0.0, 0.0, 0.0, 0.5, 0.6])], "key string, i int, s double")
    out = state.token_bucket(df, "key", "s", "i", rate=2.0, burst=2).orderBy("i").collect()
    assert [r.granted for r in out] == [True, True, False, True, False] and out[2].wait == 0.5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "paper int, pos int, n int")
    assert references.longest_run(none, "paper").count() == 0
    assert state.token_bucket(spark.createDataFrame([], "key string, i int, s double"), "key", "s", "i").count() == 0


def test_settings_and_disabled_models(spark):
    from litspan.functions.providers import DisabledChat, HashingEmbedder
    from litspan.settings import Settings

    spark.conf.set("litspan.page_size", "25")
    assert Settings.of(spark).page_size == 25 and Settings.of(spark).rate == 2.0
    spark.conf.unset("litspan.page_size")
    chat = DisabledChat()
    assert (chat.classify("x"), chat.intent("x")["action"], chat.answer("x")) == ("specific", "chat", None)
    vectors = HashingEmbedder(8).embed(["a b", "", None, "a b"])
    assert (vectors[0] == vectors[3]).all() and vectors[1][0] == 1


def test_texts_become_python_strings_by_the_batch(spark):
    """A worker has one batch of texts as Python strings, however many rows arrive at once: a model that tells the longest list of texts in its process."""
    from litspan.functions.providers import BATCH, embed_documents

    class Watching:
        dimensions = 2

        def embed(self, texts):
            import gc

            held = max(len(x) for x in gc.get_objects() if type(x) is list and x and type(x[0]) is str and x[0].startswith("text number "))
            return np.array([[held, len(texts)]] * len(texts))

    texts = spark.range(0, 500, 1, 1).select(F.concat(F.lit("text number "), "id").alias("text"))
    told = [r.v for r in texts.select(embed_documents(F.col("text"), Watching).alias("v")).collect()]
    assert len(told) == 500 and max(v[1] for v in told) == BATCH
    assert max(v[0] for v in told) == BATCH


def test_vectors_are_the_models(spark):
    """Nulls, no rows and lengths that no batch divides; queries have the instruction before them."""
    import pyarrow as pa

    from litspan.functions.providers import QUERY_PREFIX, HashingEmbedder, _embedded, embed_documents, embed_queries

    texts = [None if k % 7 == 3 else f"word{k} and word{k % 5}" for k in range(75)] + ["", "漢字 é"]
    want = HashingEmbedder().embed(texts).astype("float32").tolist()
    whole = pa.array(texts)
    got = [v for part in _embedded(iter([whole.slice(0, 40), whole.slice(40, 0), whole.slice(40)]), HashingEmbedder()) for v in part.to_pylist()]
    assert got == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    found = rows.select("i", embed_documents(F.col("text")).alias("d"), embed_queries(F.col("text")).alias("q")).orderBy("i").collect()
    asked = HashingEmbedder().embed([QUERY_PREFIX + (t or "") for t in texts]).astype("float32").tolist()
    assert [r.d for r in found] == want and [r.q for r in found] == asked
    assert rows.where("false").select(embed_documents(F.col("text"))).count() == 0


def test_reference_hits_tail_first(spark):
    hits = spark.createDataFrame([(1, 0.4), (9, 0.0), (3, 0.9)], "chunk_index int, score double")
    order = lambda **k: [r.chunk_index for r in hits.orderBy(*retrieval.hit_order(hits, "references", **k)).collect()]
    assert order() == [1, 3, 9] and order(tail_first=True) == [9, 3, 1]


def test_markdown_against_plain_substitutions(spark, sf_dir):
    """The thirteen substitutions one after the other, by Python's own engine, on documents and on marks of all kinds."""
    import re

    from pyspark.sql import functions as F

    from litspan.functions import text as T

    marks = ["# Title\n> quote\n**bold** and *it* and __u__ and _v_ `code`\n---\n![pic](http://x) [link](http://y) ~~gone~~", "```py\nx = 1\n```\n***both***", "a * b * c _ d _", None, ""]
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = [(k, t) for k, t in enumerate(marks + docs)]
    out = {r.k: r.plain for r in spark.createDataFrame(rows, "k int, t string").select("k", T.strip_markdown(F.col("t")).alias("plain")).collect()}
    for k, t in rows:
        plain = t or ""
        for pattern, kept in T.MARKDOWN:
            plain = re.sub(pattern, kept.replace("$1", r"\1"), plain)
        assert out[k] == plain


class Chat:
    """A model that says what it was asked; questions with a bang make it fail."""

    def classify(self, question):
        return " Structural.\n" if "whole" in question else "nonsense"

    def intent(self, message):
        if "!" in message:
            raise RuntimeError("down")
        return {"action": "search", "topic": message, "from_year": 2020}

    def answer(self, prompt):
        return f"  says {len(prompt)} " if "Alpha" in prompt else ""


def test_models_through_providers(spark):
    from pyspark.sql import functions as F

    from litspan.functions import providers as P
    from litspan.operators import qa as Q

    rows = spark.createDataFrame([(1, "what is the whole of it"), (2, "why"), (3, None), (4, "no!")], "n int, q string")
    found = rows.withColumn("label", P.classified(F.col("q"), Chat)).withColumn("i", P.intended(F.col("q"), Chat)).select("n", Q.question_label(F.col("q"), F.col("label")).alias("label"), "i.action", "i.topic", "i.from_year")
    got = {r.n: (r.label, r.action, r.topic, r.from_year) for r in found.collect()}
    assert got == {1: ("structural", "search", "what is the whole of it", 2020), 2: ("specific", "search", "why", 2020), 3: ("specific", None, None, None), 4: ("specific", None, None, None)}
    chunks = spark.createDataFrame([("p", 0, "Alpha text", "I", [1.0, 0.0]), ("q", 0, "other", "I", [1.0, 0.0])], "paper_id string, chunk_index int, text string, section_heading string, embedding array<float>")
    asked = spark.createDataFrame([(1, "p", "why so", [1.0, 0.0]), (2, "q", "why so", [1.0, 0.0]), (3, "r", "why so", [1.0, 0.0])], "question_id int, paper_id string, question string, vector array<float>")
    heads = spark.createDataFrame([], "paper_id string, pos int, heading string")
    out = {r.question_id: r.answer for r in Q.answer_batch(asked, chunks, heads, chat=Chat).collect()}
    prompt = "Excerpts from the paper:\n\nAlpha text\n\n---\n\nQuestion: why so"
    assert out == {1: f"says {len(prompt)}", 2: Q.NO_MODEL + "other", 3: Q.NO_CONTENT}


def test_no_window_of_a_paper_holds_sections_texts(spark):
    from litspan.operators import sections

    heads = spark.createDataFrame([(1, "A", 1, 1), (1, "B", 4, 4), (1, "C", 6, 6)], "paper int, heading string, page_start int, page_end int")
    pages = spark.createDataFrame([(1, 1, "one"), (1, 3, " "), (1, 4, ""), (1, 6, "six")], "paper int, page int, text string")
    built = sections.build(heads, pages)
    assert sorted((r.section_index, r.heading_text, r.content_text) for r in built.collect()) == [(0, "A", "one"), (1, "C", "six")]
    plan = built._jdf.queryExecution().analyzed().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "Window [row_number" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) < depth(line)), len(plan))
            assert not any("content_text" in x for x in plan[i + 1 : below])


@pytest.mark.parametrize("name", ["ref_longest_run", "ref_confidence", "ref_entries_in_run"])
def test_runs_come_from_one_exchange(spark, sf_dir, name):
    """The rows of a paper are read and exchanged once, and joined with nothing."""
    from litspan.plans import registry

    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
