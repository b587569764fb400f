"""Topics by the inverted index against reading every text."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from litspan.operators import postings as P
from litspan.sources.scratch import folder

WORDS = "graph graphs paragraph art party the of deep deeper sub-graph café CAFÉ naïve x1 2020 aaaa 漢字 漢".split()


def generated(n, seed=1):
    rng = random.Random(seed)
    text = lambda m: rng.choice([" ", "  ", "\n", ", "]).join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, m)))
    return [(k, text(5), text(30)) for k in range(n)] + [(n, None, "deep graph"), (n + 1, "Deep Graph", None), (n + 2, "", ""), (n + 3, "Only here: zebra-zebra", "(!) zebra (!)"), (n + 4, "art " * 3000, "the")]


ASKED = ["graph", "art", "deep graph", "graph, the", "aa", "aaa", " The ", "para", "graph\nthe", "the  of", "!", "(!)", "zebra-z", "nowhere", "", None, "  ", "café", "é", "漢", "字", "x1", "2020", "graphs deeper", "t", "e", "deep graph deep graph", "-graph", "graph-", ": zebra"]


def slow(papers, asked, k):
    out = []
    for r, topic in asked:
        w = (topic or "").strip().lower()
        if not w:
            continue
        found = [(-(2 * (t or "").lower().count(w) + (b or "").lower().count(w)), p) for p, t, b in papers]
        out += [(r, n, p, -s) for n, (s, p) in enumerate(sorted(x for x in found if x[0])[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, block, patterns", [(10, 256, 1 << 14), (3, 4, 7), (1, 1, 3)])
def test_equals_the_scan(spark, monkeypatch, k, block, patterns):
    monkeypatch.setattr(P, "PATTERNS", patterns)
    monkeypatch.setattr(P, "LOOK", 1 if k == 1 else 4)
    papers, asked = generated(300), list(enumerate(ASKED))
    p = spark.createDataFrame(papers, "paper_id long, title string, abstract string").repartition(3)
    r = spark.createDataFrame(asked, "request_id int, topic string")
    index = P.save(P.build(p, block=block), folder(spark, "topics"))
    assert sorted(tuple(x) for x in P.top(r, index, p, k).collect()) == slow(papers, asked, k)


def test_blocks_that_cannot_reach_the_best_are_left_out(spark):
    """A word that all papers have: after the first look only its best blocks are read, and the stored buckets of other words aren't."""
    papers = [(k, "", "graph " * (1 + k % 50) + "filler") for k in range(3000)]
    p = spark.createDataFrame(papers, "paper_id long, title string, abstract string").coalesce(2)
    blocks, words = P.save(P.build(p, block=16), folder(spark, "topics"))
    told = P.expanded([(1, "graph")], words, "request_id", spark.createDataFrame([(1,)], "request_id int").schema["request_id"].dataType)
    able = P.asked_blocks(blocks, told)
    assert able.where("most >= 50").count() < 0.05 * able.count()
    plan = able._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket#" in plan
    assert len(blocks.select("bucket").distinct().collect()) == 2 and len(able.select("bucket").distinct().collect()) == 1
    got = P.top(spark.createDataFrame([(1, "graph")], "request_id int, topic string"), (blocks, words), p, 5).collect()
    assert [(x.paper_id, x.relevance) for x in sorted(got, key=lambda x: x["rank"])] == [(49 + 50 * j, 50) for j in range(5)]


def test_empty_sides(spark):
    p = spark.createDataFrame([], "paper_id string, title string, abstract string")
    r = spark.createDataFrame([("q", "graph"), ("s", "!")], "request_id string, topic string")
    index = P.save(P.build(p), folder(spark, "topics"))
    assert P.top(r, index, p, 5).count() == 0
    some = spark.createDataFrame([("a", "graph!", None)], p.schema)
    index = P.save(P.build(some), folder(spark, "topics"))
    assert sorted(tuple(x) for x in P.top(r, index, some, 5).collect()) == [("q", 1, "a", 2), ("s", 1, "a", 2)]
    assert P.top(r.where("false"), index, some, 5).count() == 0


def test_a_task_turns_its_papers_over_itself(spark, monkeypatch):
    """No row for each word of each paper is exchanged or sorted; segments, however small, hold each paper's words once, in blocks by falling weight."""
    p = spark.createDataFrame([(1, "graph", "deep graph")], "paper_id long, title string, abstract string")
    plan = P.build(p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    papers = [(k, (t or "").lower(), (b or "").lower()) for k, t, b in generated(90)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*papers, strict=True)], names=["paper_id", "title", "body"])
    want = {(w, k, 2 * P.WORD.findall(t).count(w) + P.WORD.findall(b).count(w)) for k, t, b in papers for w in P.WORD.findall(t + " " + b)}
    for segment, few, sent in ((1 << 22, 256, 1 << 14), (100, 7, 5), (1, 1, 1)):
        for name, value in (("SEGMENT", segment), ("FEW", few), ("SENT", sent)):
            monkeypatch.setattr(P, name, value)
        blocks = [x for b in P._segments(iter([batch.slice(0, 40), batch.slice(40), batch.slice(0, 0)]), 4) for x in b.to_pylist()]
        assert sorted((x["word"], i, w) for x in blocks for i, w in zip(x["ids"], x["weights"], strict=True)) == sorted(want)
        assert all(len(x["ids"]) <= 4 and x["weights"] == sorted(x["weights"], reverse=True) and x["most"] == x["weights"][0] for x in blocks)
        assert len({x["word"] for x in blocks if x["first"]}) == len({w for w, _, _ in want})
        if segment > 100:
            assert sum(x["first"] for x in blocks) == len({w for w, _, _ in want})


def test_a_paper_meets_all_its_topics_once(spark, monkeypatch):
    """A text isn't repeated for each topic that it may hold; the counts are those of a scan, in slices of any size."""
    monkeypatch.setattr(P, "FEW", 2)
    rows = [(1, "graph", "a graph", [{"r": 7, "topic": "graph"}, {"r": 8, "topic": "no"}]), (2, "", "aaaa", [{"r": 9, "topic": "aa"}]), (3, "x", "y", [{"r": 7, "topic": "graph"}]), (4, "漢字", "é漢", [{"r": 5, "topic": "漢"}, {"r": 7, "topic": "é"}]), (5, "", "no no", [{"r": 8, "topic": "no"}])]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["p", "t", "b", "asked"])
    got = [tuple(x.values()) for b in P._counted(iter([batch, batch.slice(3)]), ["r", "p", "relevance"]) for x in b.to_pylist()]
    assert got == [(7, 1, 3), (9, 2, 2), (5, 4, 3), (7, 4, 1), (8, 5, 2), (5, 4, 3), (7, 4, 1), (8, 5, 2)]
    texts = spark.createDataFrame([(1, "graph", "a graph")], "paper_id long, __t string, __b string")
    asked = spark.createDataFrame([(k, "graph") for k in range(40)], "request_id int, topic string")
    met = P._checked(asked.selectExpr("request_id", "1L AS paper_id"), asked, texts, "request_id", "paper_id")
    assert sorted(tuple(x) for x in met.collect()) == [(k, 1, 3) for k in range(40)]


def test_parts_are_summed_before_they_give_words(spark):
    """What stands for a topic's parts is summed part by part; only the rarest part's words become rows, and none where another part is nowhere."""
    words = spark.createDataFrame([(w, 2, 3) for w in ("graph", "graphs", "paragraph", "art", "aaa", "zebra")], "word string, papers long, most int")
    kind = spark.createDataFrame([(1,)], "request_id int").schema["request_id"].dataType
    asked = [(1, "graph"), (2, "graph art"), (3, "graph nowhere"), (4, "aa"), (5, "h zeb"), (6, "(art)")]
    got = sorted((x.request_id, x.word, x.times, x.others) for x in P.expanded(asked, words, "request_id", kind).collect())
    assert got == [(1, "graph", 1, 6), (1, "graphs", 1, 6), (1, "paragraph", 1, 6), (2, "art", 1, 0), (4, "aaa", 2, 0), (5, "zebra", 1, 0), (6, "art", 1, 0)]
    pieces = [p for _, t in asked for p in P.parts(t)]
    batch = pa.RecordBatch.from_arrays([pa.array(["graph", "graphs"] * 500), pa.array([2] * 1000), pa.array([3] * 1000)], names=["word", "papers", "most"])
    sums = [x for b in P._summed(iter([batch, batch]), list(dict.fromkeys(pieces))) for x in b.to_pylist()]
    assert len(sums) <= len(set(pieces)) and {"piece": 0, "papers": 4000, "whole": 6000} in sums
