"""Titles by automaton and by bounds, against comparing all pairs."""

from __future__ import annotations

import difflib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from litspan.operators import titles as N
from litspan.plans import registry

WORDS = "deep shallow network graph learning of for vision language model survey study attention sparse dense retrieval corpus large small zero quantum xylem jazz".split()


def key(t):
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", (t or "").lower()).split())


def generated(n, seed=2, longest=9):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def slow(asked, papers):
    """Per request (paper, ratio, accepted) by every pair's ratio."""
    out = {}
    for i, q in asked:
        ratios = [(-difflib.SequenceMatcher(a=key(q), b=key(t)).ratio(), p) for p, t in papers if key(t)] if key(q) else []
        best = sorted(x for x in ratios if -x[0] >= N.SUGGEST)[:10]
        if best:
            accepted = -best[0][0] >= N.ACCEPT
            out[i] = [(p, round(-s, 9), accepted) for s, p in (best[:1] if accepted else best)]
    return out


def found(df, request="request_id", paper="paper_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (-r.ratio, r[paper])):
        out.setdefault(r[request], []).append((r[paper], round(r.ratio, 9), r.accepted))
    return out


def test_ten_thousand_titles(spark):
    """The same suggestions as all pairs give, of which fewer than one in a hundred is compared in full."""
    rng = random.Random(3)
    papers = list(enumerate(generated(10_000)))
    asked = [(k, "".join(c for c in t if rng.random() > 0.06)) for k, (_, t) in enumerate(papers[:12])]
    asked += [(100, "nothing like it 123"), (101, ""), (102, None), (103, "!!"), (104, " ".join(["deep survey"] * 9)), (105, "a"), (106, papers[50][1])]
    p = spark.createDataFrame(papers, "paper_id int, title string").repartition(3)
    r = spark.createDataFrame(asked, "request_id int, query string")
    assert found(N.fuzzy_titles(r, p)) == slow(asked, papers)

    own = N.Asked([(i, key(q)) for i, q in asked if key(q)])
    texts = sorted((key(t) for _, t in papers), key=len)
    length, bits, beyond, codes = N.features(pa.array(texts))
    pairs = [(r, t) for a in own.able(length, bits, beyond) for r, t in zip(*a, strict=True)]
    request, title = (np.array(x) for x in zip(*pairs, strict=True))
    passed = 2 * own.subsequence(request, codes[title]) >= N.SUGGEST * (own.length[request] + length[title]) - N.EDGE
    short = own.length[request] <= N.WORD
    assert (passed & short).sum() < 0.01 * short.sum() + 0.01 * len(papers) * len(own.names)


def test_bounds_hold_for_every_pair():
    """Long titles, many equal characters: the ratio never exceeds the bounds."""
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("etabcz 09") for _ in range(rng.randint(1, 90))).strip() for _ in range(150)} | {"e" * 80, "z" * 40, "etaoin" * 40} - {""}, key=len)
    own = N.Asked([(k, t) for k, t in enumerate(texts)])
    length, bits, beyond, codes = N.features(pa.array(texts))
    able = {(int(r), int(t)) for a in own.able(length, bits, beyond) for r, t in zip(*a, strict=True)}
    n = len(texts)
    most = own.subsequence(np.repeat(np.arange(n), n), codes[np.tile(np.arange(n), n)]).reshape(n, n)
    for r in range(n):
        for t in range(n):
            matcher = difflib.SequenceMatcher(a=texts[r], b=texts[t])
            assert sum(b.size for b in matcher.get_matching_blocks()) <= most[r, t]
            assert matcher.ratio() < N.SUGGEST or (r, t) in able


def test_accepted_titles_raise_the_bounds(spark):
    """Requests with a close title leave hardly any other title to compare, and their rows are those of all pairs."""
    rng = random.Random(6)
    papers = [(k, " ".join("".join(rng.choices("etaoinsrhldcum", k=rng.randint(2, 9))) for _ in range(8))) for k in range(3000)]
    asked = [(k, t[2:]) for k, t in papers[:40]]
    p, r = spark.createDataFrame(papers, "paper_id int, title string"), spark.createDataFrame(asked, "request_id int, query string")
    told = [tuple(x) for x in N.leasts(N.keyed(r, "request_id", "query"), N.keyed(p, "paper_id", "title"), "request_id").collect()]
    assert len(told) == len(asked) and sum(x[2] >= N.ACCEPT for x in told) > 0.9 * len(told)
    length, bits, beyond, _ = N.features(pa.array(sorted((key(t) for _, t in papers), key=len)))
    left = lambda rows: sum(len(found) for _, found in N.Asked(rows).able(length, bits, beyond))
    assert left(told) < 0.05 * left([x[:2] for x in told])
    assert found(N.fuzzy_titles(r, p)) == slow(asked, papers)


@pytest.mark.parametrize("rows", [1, 3, 1 << 14])
def test_blocks_of_requests(spark, monkeypatch, rows):
    monkeypatch.setattr(N, "ROWS", rows)
    papers = [*enumerate(generated(200, seed=5)), (1000, None), (1001, "?"), (1002, "Deep  GRAPH"), (1003, "deep graph")]
    asked = [(1, "deep"), (2, "Graph network"), (3, "deep graph"), (4, "nowhere"), (5, ""), (6, None), (7, "deep"), (8, "e")]
    p, r = spark.createDataFrame(papers, "paper_id long, title string"), spark.createDataFrame(asked, "request_id int, query string")
    want = []
    for i, q in asked:
        if key(q):
            exact = [p for p, t in papers if key(t) == key(q)]
            want += [(i, min(exact), "exact")] if exact else [(i, p, "substring") for p, t in papers if key(q) in key(t)]
    assert sorted(tuple(x) for x in N.title_matches(r, p).collect()) == sorted(want)
    assert found(N.fuzzy_titles(r, p)) == slow(asked, papers)


def test_empty_sides(spark):
    p, r = spark.createDataFrame([], "paper_id string, title string"), spark.createDataFrame([("a", "deep")], "request_id string, query string")
    assert N.title_matches(r, p).count() == 0 == N.fuzzy_titles(r, p).count()
    assert N.title_matches(r.where("false"), p).count() == 0 == N.fuzzy_titles(r.where("false"), p).count()


def test_registered_query_equals_all_pairs(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = [(r.doc_id, r.text[:70]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 70).alias("text")).collect()]
    asked = [(d, t[2:62].replace("th", "d")) for d, t in docs if d % 20 == 0]
    got = registry.QUERIES["title_match_fuzzy"](spark, sf_dir)
    rounded = lambda x: {k: sorted((p, round(s, 6), a) for p, s, a in v) for k, v in x.items()}
    assert rounded(found(got, paper="doc_id")) == rounded(slow(asked, docs))


def test_equal_titles_and_requests_are_compared_once(spark, monkeypatch):
    """Copies give the rows of all pairs, in the order of their papers, and don't multiply what is compared."""
    rng = random.Random(9)
    kinds = generated(12, seed=7, longest=12)
    papers = [(k, rng.choice(kinds)) for k in range(400)]
    asked = [(k, t[:1] + t[3:]) for k, t in enumerate(kinds * 3)] + [(100, "deep"), (101, "graph nets small corpus")]
    p = spark.createDataFrame(papers, "paper_id int, title string").repartition(5)
    r = spark.createDataFrame(asked, "request_id int, query string")
    told = []
    monkeypatch.setattr(N, "blocks", lambda rows, of=N.blocks: (told.append(b) or b for b in of(rows)))
    assert found(N.fuzzy_titles(r, p)) == slow(asked, papers)
    assert sum(map(len, told)) == len({key(q) for _, q in asked})


def test_blocks_of_pairs_are_those_of_difflib():
    """Equal runs, runs that cross, texts of a whole word: the same number of characters, or less than is needed."""
    rng = random.Random(1)
    text = lambda n: key("".join(rng.choice("etab n") for _ in range(rng.randint(1, n)))) or "a"
    asked = [text(64) for _ in range(40)] + ["e" * 64, "ab" * 32, "a"]
    texts = [text(120) for _ in range(80)] + [x[:20] + "tn" + x[22:] for x in asked] + ["ab" * 40, "e" * 90]
    own = N.Asked(list(enumerate(asked)))
    titles = N.Titles(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["paper", "t"]))
    request, title = np.repeat(np.arange(len(asked)), len(texts)), np.tile(np.arange(len(texts)), len(asked))
    want = np.array([sum(b.size for b in difflib.SequenceMatcher(a=asked[i], b=titles.texts[j]).get_matching_blocks()) for i, j in zip(request, title, strict=True)])
    assert (own.matching(request, titles.codes[title], np.zeros(len(want))) == want).all()
    need = np.full(len(want), np.median(want))
    some = own.matching(request, titles.codes[title], need)
    assert ((some == want) | ((some < need) & (want < need))).all()

    # the order of some characters leaves every pair that can count
    counted = [np.concatenate(x) for x in zip(*own.counted(titles.length, titles.bits, titles.beyond), strict=True)]
    left = set(zip(*(x.tolist() for x in N.in_order(own, titles, *counted)), strict=True))
    ratio = 2 * want / (own.length[request] + titles.length[title])
    assert {(int(i), int(j)) for i, j in zip(request[ratio >= N.SUGGEST], title[ratio >= N.SUGGEST], strict=True)} <= left


def test_many_like_titles_raise_the_bound(spark):
    """Where ``most`` titles are like a request that none is accepted for, the others must be as like as those."""
    stem = "quantum corpus attention zero sparse "
    papers = [(k, stem + " ".join(w)) for k, w in enumerate(zip(generated(30, 1, 1), generated(30, 2, 1), generated(30, 3, 1), strict=True))]
    asked = [(1, stem + "0123 987"), (2, "xyz")]
    p, r = spark.createDataFrame(papers, "paper_id int, title string"), spark.createDataFrame(asked, "request_id int, query string")
    distinct = N.keyed(p, "paper_id", "title").dropDuplicates(["__t"])
    told = {x[0]: x[2] for x in N.leasts(N.keyed(r, "request_id", "query"), distinct, "request_id", 3).collect()}
    ratios = sorted((difflib.SequenceMatcher(a=asked[0][1], b=t).ratio() for t in {t for _, t in papers}), reverse=True)
    assert N.SUGGEST < told[1] <= ratios[2] < N.ACCEPT and told[2] == N.SUGGEST
    assert found(N.fuzzy_titles(r, p)) == slow(asked, papers)
