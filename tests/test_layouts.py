"""Stored tables, pages at any depth, merging sketches and budgets: results against plain ones, and what their plans do without."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from litspan.operators import ranks, retrieval, sketches
from litspan.operators import store_tables as S
from litspan.sources.scratch import folder

LAYOUT = S.Layout("paper", ("chunk_index",), buckets=4)


def plan(df):
    """The physical plan as it is run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    chunks = spark.range(4000).select((F.col("id") % 100).alias("paper"), F.floor(F.col("id") / 100).cast("int").alias("chunk_index"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    chunks = chunks.union(spark.createDataFrame([(None, 0, "nobody's")], chunks.schema))
    papers = spark.range(90).select(F.col("id").alias("paper"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("title"))
    one = LAYOUT.write(chunks, S.version(spark, "c"), folder(spark, "c"))
    two = S.Layout("paper", buckets=4).write(papers, S.version(spark, "p"), folder(spark, "p"))
    return chunks, papers, one, two


def test_reads_of_a_paper_open_one_bucket(spark, stored):
    _, _, chunks, _ = stored
    got = LAYOUT.of_paper(chunks, 42)
    assert [r.chunk_index for r in got.collect()] == list(range(40))
    # a scan that needn't keep its buckets apart prunes them as well, but doesn't say so
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = plan(LAYOUT.of_paper(chunks, 42))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in text and "PushedFilters: [IsNotNull(paper), EqualTo(paper,42)]" in text
    assert LAYOUT.of_paper(chunks, 1000).count() == 0


def test_bloom_filters_and_sorted_row_groups_are_written(stored):
    import pyarrow.parquet as pq

    _, _, chunks, _ = stored
    for file in chunks.inputFiles():
        part = pq.ParquetFile(file.removeprefix("file:"))
        keys = part.read(["paper"]).column(0).to_pylist()
        assert keys == sorted(keys, key=lambda x: (x is not None, x))
        assert part.metadata.row_group(0).column(0).statistics is not None


def test_counts_joins_and_orphans_need_no_exchange(stored):
    raw, papers, chunks, kept = stored
    for df in (LAYOUT.counts(chunks), S.joined(kept, LAYOUT.counts(chunks), "paper"), S.joined(kept, chunks, "paper"), S.orphans(chunks, kept, "paper")):
        assert "Exchange" not in plan(df)
    assert sorted(map(repr, LAYOUT.counts(chunks).collect())) == sorted(map(repr, raw.groupBy("paper").agg(F.count("*").alias("n")).collect()))
    assert S.joined(kept, chunks, "paper").count() == 3600 and S.orphans(chunks, kept, "paper").count() == 401


def test_replacement_deals_only_what_is_new(spark, stored):
    raw, _, chunks, _ = stored
    new = raw.where("paper = 7").withColumn("text", F.lit("again")).union(raw.where("paper = 3 AND chunk_index = 0").withColumn("paper", F.lit(500).cast("long")))
    after = LAYOUT.replaced(chunks, new, spark.createDataFrame([(7,), (8,), (500,), (7,)], "paper long"), S.version(spark, "c"), folder(spark, "c"))
    want = raw.where("paper NOT IN (7, 8) OR paper IS NULL").union(new)
    assert sorted(map(repr, after.collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, chunks.collect())) == sorted(map(repr, raw.collect()))
    assert "Exchange" not in plan(LAYOUT.counts(after))


ORDER = [("score", True), ("name", False), ("id", False)]


def test_deep_pages_sort_one_range(spark):
    rows = spark.range(60_000).select("id", (F.xxhash64("id") % 1000).cast("double").alias("score"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"))
    index = ranks.rank_index(rows, ORDER, sample=2000)
    whole = [tuple(r) for r in rows.select("score", "name", "id").orderBy(*ranks.sorting(ORDER)).collect()]
    assert index.total == len(whole) and max(index.counts) < 0.06 * index.total
    for start, size in ((0, 10), (30_000, 25), (59_990, 30), (59_999, 1), (12_345, 3000), (70_000, 5), (5, 0)):
        page = ranks.page_at(rows, index, start, size)
        assert [(r.score, r.name, r.id) for r in page.orderBy("position").collect()] == whole[start : start + size]
        assert [r.position for r in page.orderBy("position").collect()] == list(range(start + 1, min(start + size, 60_000) + 1)) or not size
    low = next(i for i, a, b in index.spans() if a <= 30_000 < b)
    assert rows.where(index.within(low, low)).count() == index.counts[low] < 3600


def test_deep_pages_of_small_and_even_tables(spark):
    for rows in ([], [(1, 2.0, "a")], [(k, 1.0, "a") for k in range(50)]):
        df = spark.createDataFrame(rows, "id long, score double, name string")
        index = ranks.rank_index(df, ORDER, ranges=8)
        assert index.total == len(rows)
        assert [r.id for r in ranks.page_at(df, index, 1, 5).orderBy("position").collect()] == [r[0] for r in rows[1:6]]


def test_borders_are_pushed_to_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice", "l_orderkey")
    index = ranks.rank_index(rows, [("l_extendedprice", True), ("l_orderkey", False)])
    text = plan(ranks.page_at(rows, index, index.total // 2, 5))
    assert re.search(r"PushedFilters: \[[^\]]*(LessThanOrEqual|GreaterThanOrEqual)\(l_extendedprice", text)


def test_sketches_merge_within_their_bounds(spark):
    """Quantiles of two hundred merged papers and of each, against exact ranks; distinct texts against their number."""
    rng = random.Random(1)
    rows = [(k % 200, rng.choice([9.0, 9.0, 9.5, 12.0]) + rng.random() + k % 3, f"w{rng.randint(0, 20_000)}") for k in range(60_000)] + [(1, None, None), (1, 3.0, "small"), (500, None, None)]
    df = spark.createDataFrame(rows, "paper int, size double, text string")
    each = sketches.paper_sketches(df, ["paper"])
    whole = sketches.merged(each, []).select("spans", *[sketches.quantile("sizes", q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)], sketches.distinct("words").alias("n")).first()
    sizes = sorted(s for _, s, _ in rows if s is not None and s > 4)
    assert whole.spans == len(rows)
    for share, value in ((0.1, whole.q10), (0.5, whole.q50), (0.9, whole.q90)):
        assert abs(sum(s <= value for s in sizes) / len(sizes) - share) < sketches.RANK_ERROR
    true = len({t for _, _, t in rows if t is not None})
    assert abs(whole.n - true) < 0.05 * true
    for r in each.select("paper", "spans", sketches.quantile("sizes", 0.5).alias("m")).where("paper in (1, 7, 500)").collect():
        own = sorted(s for p, s, _ in rows if p == r.paper and s is not None and s > 4)
        assert r.spans == sum(p == r.paper for p, _, _ in rows)
        assert r.m is None if not own else abs(sum(s <= r.m for s in own) / len(own) - 0.5) < 0.05


def test_sketches_of_changed_papers(spark):
    df = spark.createDataFrame([(k % 5, float(k % 40 + 5), f"w{k % 11}") for k in range(500)], "paper int, size double, text string")
    stored = sketches.paper_sketches(df, ["paper"])
    later = df.where("paper <> 4").withColumn("size", F.when(F.col("paper") == 2, F.col("size") + 10).otherwise(F.col("size")))
    got = sketches.refreshed(stored, later, spark.createDataFrame([(2,), (4,)], "paper int"), ["paper"])
    shown = lambda s: sorted((r.paper, r.spans, r.m, r.n) for r in s.select("paper", "spans", sketches.quantile("sizes", 0.5).alias("m"), sketches.distinct("words").alias("n")).collect())
    assert shown(got) == shown(sketches.paper_sketches(later, ["paper"]))


@pytest.mark.parametrize("budget", [0, 1, 7, 40, 10_000])
def test_budgets_cut_before_the_exchange(spark, budget):
    """Each task passes on no more of a group than its budget holds; the packed rows are those of a running sum over all."""
    rng = random.Random(budget)
    rows = [(rng.choice(["a", "b", "c", None]), k, "x" * rng.choice([0, 1, 2, 5, 9]) if k % 13 else None, rng.random()) for k in range(600)]
    hits = spark.createDataFrame(rows, "q string, i int, body string, score double").repartition(5)
    order = [F.desc("score"), F.asc("i")]
    want = {}
    for q in ("a", "b", "c", None):
        used = 0
        for _, i, body, _ in sorted((r for r in rows if r[0] == q and r[2]), key=lambda r: (-r[3], r[1])):
            if used + len(body) <= budget:
                want[q, i] = body
            elif used <= budget and budget - used > 1:
                want[q, i] = body[: budget - used]
            used += len(body)
    got = retrieval.pack_context(hits, "q", order, "body", budget, least=1)
    assert {(r.q, r.i): r.packed for r in got.collect()} == want
    cut = retrieval.within_budget(hits, "q", order, F.length("body"), F.lit(budget))
    sums = cut.groupBy(F.spark_partition_id(), "q").agg(F.sum(F.length("body")).alias("n")).collect()
    assert all(r.n <= budget + 9 for r in sums)
    text = plan(got)
    assert text.index("MapInArrow") > text.index("Exchange")
