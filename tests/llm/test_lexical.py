"""The lexical search against scoring every document for every item, on odd rows and in the smallest blocks and slices."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from litspan.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k=10):
    counts = [Counter(found(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    wanted = defaultdict(set)
    for i, text in items:
        wanted[i] |= set(found(text))
    out = []
    for i, own in wanted.items():
        scored = []
        for (d, _), c in zip(docs, counts, strict=True):
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is not None, d if d is not None else 0))
        out += [(i, rank, d if there else None, -s) for rank, (s, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def generated(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "The", "the", "漢字", "a1"]
    text = lambda m: " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, m)))
    docs = [(k, text(80)) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (None, "the w1 w2"), (5, "the w1 w2"), (5, "the w1 w2"), (n + 2, "w59 " * 20_000), (n + 3, "...")] + [(n + 10 + k, "same text of ties w58") for k in range(30)]
    items = [(k, text(12)) for k in range(25)] + [(3, "w58 more"), (99, None), (100, "nowhere else"), (None, "ties of w58"), (101, "the THE The")]
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_equals_scoring_everything(spark, most):
    docs, items = generated(400)
    d = spark.createDataFrame([(*r, "x", 0.0) for r in docs], "doc_id long, text string, item_id string, score double").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string").repartition(2)
    out = lexical.search(d, i, most=most)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == slow(docs, items)


def test_slices_and_blocks_of_entries(monkeypatch):
    """The same best documents however the sorted entries are cut."""
    import pyarrow as pa

    docs, items = generated(120, seed=2)
    pairs = [(i, t) for i, (_, text) in enumerate(items) for t in sorted(set(found(text)))]

    class Shared:
        value = lexical.Index(pairs)

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    counts = {n: c for b in lexical._counts(iter([batch.select([1])]), Shared) for n, c in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    weight = lexical.weights(counts[-1], np.array([counts.get(n, 0) for n in range(len(Shared.value.number))]))
    results = []
    for slice_, entries in ((1 << 21, 1 << 21), (50, 7), (1, 1)):
        monkeypatch.setattr(lexical, "SLICE", slice_)
        monkeypatch.setattr(lexical, "ENTRIES", entries)
        results.append([b.to_pylist() for b in lexical._scores(iter([batch, batch.slice(3, 0)]), Shared, len(items), weight, counts[-1], counts[-2], 10)])
    assert results[0] == results[1] == results[2] and results[0]


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    for kind, top in ((np.uint32, 1 << 32), (np.uint32, 50), (np.uint64, 1 << 60), (np.uint32, 1)):
        keys = rng.integers(0, top, 5000).astype(kind)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.uint32))) == 0


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    query = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == [] == lexical.search(some, items).collect() == lexical.search(docs, query).collect()
    named = lexical.search(some.selectExpr("cast(doc_id AS string) AS name", "text"), query, id_column="name").collect()
    assert [tuple(r) for r in named][0][:3] == (1, 1, "1")
