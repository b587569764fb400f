"""Near-duplicate vectors and documents, and components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex

from litspan.llm import common, components, embeddings, ngrams


def brute_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(350, k) for k in range(351, 400)]
    found = components.connected_components(spark.createDataFrame([*edges, (5, 5), edges[0]], "a long, b long"))
    want = brute_components(400, edges)
    got = {r.node: r.component for r in found.collect()}
    assert got == {x: want[x] for a, b in edges if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_around_hubs(spark, monkeypatch):
    """Stars, and hubs that are the largest of their neighbours, with hubs met by broadcast."""
    monkeypatch.setattr(common, "HOTTEST", 4)
    edges = [(0, k) for k in range(1, 200)] + [(900, k) for k in range(300, 400)] + [(399, 950), (950, 951), (10, 960), (960, 970)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(1000, edges)
    assert got == {x: want[x] for e in edges for x in e}


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = np.concatenate([base, base[:10] + 0.15 * rng.standard_normal((10, 16)), base[:1] + 0.02 * rng.standard_normal((60, 16)), base[5:6] * 3.0])
    return [x.astype("float32").tolist() for x in rows]


def check_vectors(spark, extra, **settings):
    data = vectors()
    rows = [(i, v) for i, v in enumerate(data)] + [(300 + i, data[1]) for i in range(5)] + extra
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, **settings).collect() if r.vec_id is not None}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    near = [[len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9 for _, b in good] for _, a in good]
    groups = brute_components(len(good), [(i, j) for i in range(len(good)) for j in range(i) if near[i][j]])
    for k, i in enumerate(ids):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (sum(near[k]) - 1, ids[groups[k]], ids[groups[k]] == i)
    return out


def test_vectors_against_all_pairs(spark):
    bad = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, []), (205, [float("inf")] * 16), (206, [1.0, 2.0])]
    out = check_vectors(spark, bad, recall=0.999999)
    for i in range(200, 207):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CROWD", 20)
    check_vectors(spark, [], recall=0.999999, block=16)
    monkeypatch.setattr(embeddings, "FEW_KEYS", 0)
    monkeypatch.setattr(common, "HOTTEST", 4)
    check_vectors(spark, [], recall=0.999999, block=16)


def test_one_id_for_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.99]), (4, [0.05, 1.0]), (4, [1.0, -0.05])]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = []
    near = [[a[0] * b[0] + a[1] * b[1] >= 0.9 * np.hypot(*a) * np.hypot(*b) for _, b in rows] for _, a in rows]
    groups = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near[i][j]])
    for k, (i, _) in enumerate(rows):
        least = min(x for (x, _), g in zip(rows, groups, strict=True) if g == groups[k])
        want.append((i, sum(near[k]) - 1, least, i == least))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()) == sorted(want)


def test_vectors_empty_and_null_ids(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    out = embeddings.near_duplicates(df).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in out) == [(-1, 0, True), (3, 1, True), (3, 1, True)]


def texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    base = [make(rng.randint(5, 120)) for _ in range(60)]
    out = [" ".join(b) for b in base]
    hot = make(80)
    for _ in range(90):
        x = list(hot)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(80)] = rng.choice(words)
        out.append(" ".join(x))
    out += SCRIPTS + [out[0]] * 7 + [out[3].upper() + "!", "", "  ", "one two", "One  two", None, "?!", "x" * 200_000, ("long " * 3) + " ".join(make(30_000))]
    return out


SCRIPTS = [
    "नमस्ते दुनिया कैसे हो आप आज यहाँ", "नमस्तो दुनिये कैसा हे आपा आजु यहाि", "สวัสดี ชาวโลก วันนี้ เป็น อย่างไร บ้าง", "สวัสดู ชาวโลกี วันนู้ เป็ด อย่างใร บ้าน", "مُحَمَّد كَتَبَ كِتَابًا فِي المَدِينَة الكَبِيرَة", "مُحِمَّد كُتِبَ كُتَّابًا فَي المُدِينَة الكُبِيرَة",
    "e\u0301te\u0301 a\u0300 la plage de nice avec toi", "ete a la plage de nice avec toi", "\u1c89 \ua7cb \U000105c0 x y z", "\u1c89 \ua7cb \U000105c1 x y z", "İstanbul ve ÇOK güzel bir şehir", "snake_case_word and two more of them",
]


def grams_of(text):
    """The n-grams by a tokenizer of its own."""
    words = regex.findall(r"[\p{L}\p{N}\p{M}_]+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_ngrams_by_another_tokenizer():
    rng = random.Random(3)
    every = SCRIPTS + texts() + ["".join(rng.choice("ab é\u0301\u0302,_1\n") for _ in range(60)) for _ in range(300)]
    many = ngrams.ngram_sets([t or "" for t in every], ngrams.Words())
    for t, found in zip(every, many, strict=True):
        assert len(found) == len(grams_of(t))
        assert (found == ngrams.ngram_sets([t or ""], ngrams.Words())[0]).all()
    assert len({f.tobytes() for f in many[: len(SCRIPTS)]}) == len(SCRIPTS)


def brute_documents(rows):
    sets = [grams_of(t) for _, t in rows]
    n = len(rows)
    near = [[bool(sets[i] and sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    groups = brute_components(n, [(i, j) for i in range(n) for j in range(i) if near[i][j]])
    return [(sum(near[i]) - bool(sets[i]), rows[groups[i]][0]) for i in range(n)]


@pytest.mark.parametrize("small", [512, 8])
def test_documents_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(ngrams, "SMALL", small)
    if small == 8:  # splits, blocks, levels of size and keys that are broadcast
        monkeypatch.setattr(ngrams, "BLOCK", 16)
        monkeypatch.setattr(common, "HOTTEST", 8)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, i % 3, "clash", 1.0) for i, t in rows], "doc_id long, text string, node int, key string, sketch double")
    out = {r.doc_id: r for r in ngrams.jaccard_join(df).collect()}
    assert len(out) == len(rows)
    for (i, _), (links, component) in zip(rows, brute_documents(rows), strict=True):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links, component, component == i)


def test_documents_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert ngrams.jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    out = ngrams.jaccard_join(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.component_id, r.kept) for r in out) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_recall_of_pairs_near_the_threshold(spark):
    """Isolated pairs with a similarity from 0.8 to 0.85: 0.99 of them are linked, at least."""
    rng = random.Random(12)
    rows, pairs = [], 0
    while pairs < 1500:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120))]
        other = base[: rng.randint(int(len(base) * 0.85), len(base) - 1)]
        a, b = grams_of(" ".join(base)), grams_of(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    found = ngrams.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert found >= 0.99 * 2 * pairs


def test_levels_of_size_compare_all_that_can_be_alike(spark, monkeypatch):
    """One component of texts that grow word by word: no pair within reach is lost."""
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    rows = [(k, " ".join(f"w{i}" for i in range(20 + k))) for k in range(60)]
    out = {r.doc_id: r.n_links for r in ngrams.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = [16 + k for k in range(60)]
    assert all(out[k] == sum(5 * min(a, b) >= 4 * max(a, b) for b in size) - 1 for k, a in enumerate(size))


def test_ids_of_another_type_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOTTEST", 4)
    rows = [("a", "one two three four five six"), ("b", "one two three four five six"), ("c", "another text of a few words"), (None, None), ("d", None)]
    rows += [(None, None)] * 20 + [("e", "said the very same thing once more")] * 30
    out = ngrams.jaccard_join(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    told = {(r.doc_id, r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert told == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), (None, 0, None, True), ("d", 0, "d", True), ("e", 29, "e", True)}
    vectors = [("x", [1.0, 0.0])] * 20 + [("y", [0.0, 1.0]), ("z", [0.01, 1.0])]
    out = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id string, embedding array<float>")).distinct().collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out} == {("x", 19, "x", True), ("y", 1, "y", True), ("z", 1, "y", False)}


def test_runs_reach_the_recall():
    assert ngrams.plan_runs(0.8, 0.9999) >= 7
    bits, tables = embeddings.plan_tables(10**9)
    assert bits >= 20 and tables > 50


def test_near_copies_without_ids_are_linked(spark):
    base = [f"w{k}" for k in range(60)]
    near, lone, other = " ".join([*base, "end"]), [f"v{k}" for k in range(60)], "quite another text of some words"
    rows = [(7, " ".join(base)), (None, near), (None, " ".join(lone)), (None, " ".join([*lone, "end"])), (None, other)]
    out = ngrams.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = spark.createDataFrame(rows, "id long, t string").selectExpr("t", "xxhash64(t) AS row_key").join(out, "row_key").collect()
    told = {r.t: (r.doc_id, r.n_links, r.component_id, r.kept) for r in found}
    assert told[rows[0][1]] == (7, 1, 7, True) and told[near] == (None, 1, 7, False) and told[other] == (None, 0, None, True)
    pair = [told[rows[k][1]] for k in (2, 3)]
    assert [p[:3] for p in pair] == [(None, 1, None)] * 2 and sorted(p[3] for p in pair) == [False, True]


def test_recall_counts_every_split_and_the_sketches():
    meets = 0.8 * (1 - 0.2**ngrams.BRANCHES) ** ngrams.DEPTH
    assert (1 - meets) ** ngrams.plan_runs(0.8, 0.9999) + ngrams.sketch_miss(0.8) <= 1e-4
