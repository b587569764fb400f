"""A session's handlers turn by turn: lists in parts, titles near and far, selectors, a search that waits, odd rows."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from litspan.operators import handlers as H
from litspan.plans import registry
from litspan.settings import Settings

SMALL = Settings(prefetch=3, page_size=2, loaded_most=9)
PAPERS = [(f"q:{'a' if k < 12 else 'b'}", k + 1 if k < 12 else k - 11, f"p{k}", ["Deep graphs", "Shallow graphs", "Graph theory of trees", "Zebra fish", "On art", "On art and war"][k % 6] + (" again" if k >= 6 else ""), f"Ann {k % 4}") for k in range(16)]


def run(spark, turns):
    rows = spark.createDataFrame(
        [(s, t, a.get("answer", "other"), a.get("action", "chat"), a.get("query"), a.get("author"), a.get("index"), a.get("title")) for s, t, a in turns],
        "session long, turn int, answer string, action string, query string, author string, index int, title string",
    )
    papers = spark.createDataFrame(PAPERS, "query string, position int, paper string, title string, authors string")
    out = H.replay(rows, H.lists(papers, SMALL.loaded_most), settings=SMALL)
    return {(r.session, r.turn): (r.outcome, r.paper, r.start, r.shown, r.loaded, r.waiting) for r in out.collect()}


def test_one_long_session(spark):
    search, nxt = {"action": "search", "query": "q:a"}, {"action": "next"}
    steps = [
        (nxt, ("no-search", None, None, 0, 0, None)),
        ({"action": "open", "title": "x"}, ("no-search", None, None, 0, 0, None)),
        (search, ("list", None, 0, 2, 3, None)),
        (nxt, ("list", None, 2, 2, 6, None)),
        ({"action": "open", "index": 1}, ("open", "p2", None, 1, 6, None)),  # of the page
        ({"action": "open", "index": 3}, ("open", "p2", None, 1, 6, None)),  # of the list
        ({"action": "open", "index": 8}, ("open", "p7", None, 1, 9, None)),  # loads more
        ({"action": "open", "index": 11}, ("beyond", None, None, 0, 9, None)),  # the cap
        ({"action": "open", "index": 0}, ("bad-index", None, None, 0, 9, None)),
        ({"action": "open", "title": "  DEEP-graphs "}, ("open", "p0", None, 1, 9, None)),
        ({"action": "open", "title": "graphs"}, ("choices", None, None, 4, 9, None)),
        ({"action": "open", "title": "Graph theory of treees"}, ("open", "p2", None, 1, 9, None)),  # nearly
        ({"action": "open", "title": "nothing alike"}, ("no-title", None, None, 0, 9, None)),
        ({"action": "open", "title": " ?! "}, ("usage", None, None, 0, 9, None)),
        ({"action": "open", "author": "ANN 3", "query": "q:x"}, ("open", "p3", None, 1, 9, None)),  # one of the page
        ({"action": "open", "author": "Ann 0", "query": "q:x"}, ("choices", None, None, 3, 9, None)),
        ({"action": "open", "author": "Bob", "query": "q:b"}, ("ask-new", None, None, 0, 9, "q:b")),
        ({"answer": "no"}, ("stay", None, None, 0, 9, None)),
        ({"answer": "yes"}, ("chat", None, None, 0, 9, None)),
        ({"action": "open", "author": "Bob", "query": "q:b"}, ("ask-new", None, None, 0, 9, "q:b")),
        ({"action": "open"}, ("usage", None, None, 0, 9, None)),  # something else: the search is dropped
        ({"action": "open", "author": "Bob", "query": "q:b"}, ("ask-new", None, None, 0, 9, "q:b")),
        ({"answer": "yes"}, ("list", None, 0, 2, 3, None)),
        (nxt, ("list", None, 2, 2, 4, None)),
        (nxt, ("no-more", None, None, 0, 4, None)),
        ({"action": "search", "query": "q:none"}, ("list", None, 0, 0, 0, None)),
        (nxt, ("no-more", None, None, 0, 0, None)),
        ({"action": "open", "author": "Ann", "query": "q:b"}, ("usage", None, None, 0, 0, None)),
        ({"action": "search"}, ("search-usage", None, None, 0, 0, None)),
    ]
    turns = [(1, t, a) for t, (a, _) in enumerate(steps)] + [(2, 0, search), (2, 1, nxt)]
    out = run(spark, turns)
    for t, (a, want) in enumerate(steps):
        assert out[1, t] == want, (t, a)
    assert out[2, 1] == ("list", None, 2, 2, 6, None)


def test_no_turns(spark):
    rows = spark.createDataFrame([], "session long, turn int, answer string, action string, query string, author string, index int, title string")
    papers = spark.createDataFrame(PAPERS, "query string, position int, paper string, title string, authors string")
    assert H.replay(rows, H.lists(papers, 5)).count() == 0


def test_conversations_reach_every_handler(spark):
    """On sf0.01 the registered query equals its recursive SQL, and every outcome that data can reach occurs."""
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES["session_handlers"](spark, folder)
    got = sorted(map(repr, (tuple(r[x] for x in sorted(df.columns)) for r in df.collect())))
    want = c.sql(registry.ORACLES["session_handlers"])
    assert got == sorted(map(repr, want.select(*sorted(want.columns)).fetchall()))
    outcomes = {r.outcome for r in df.select("outcome").distinct().collect()}
    assert outcomes >= {"list", "open", "choices", "no-title", "no-search", "beyond", "chat"}, outcomes
    assert df.where(F.col("waiting").isNotNull()).count() > 0
