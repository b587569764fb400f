"""Queries and their SQL where engines used to differ: ends of words in any script, sums of doubles."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from litspan.plans import registry


def both(spark, name, table, path):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    expected = c.sql(registry.ORACLES[name])
    got = sorted(map(repr, (tuple(r[k] for k in expected.columns) for r in df.collect())))
    assert got == sorted(map(repr, expected.fetchall()))
    return df


def test_words_end_in_any_script(spark, tmp_path):
    texts = ["Yñ", "yes", "yes\n", "Y1", "y_", " No!", "noñ", "cancelé", "cancel é", "ok", "OKé", None, "да", "yда"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = both(spark, "message_cues", "conversations", tmp_path)
    told = {r.text: r.answer for r in df.collect()}
    assert [told[t] for t in ("Yñ", "yes\n", " No!", "noñ", "cancelé", "cancel é", None, "yда")] == ["other", "yes", "no", "other", "other", "cancel", "other", "other"]


def test_totals_are_summed_in_cents(spark, tmp_path):
    """A half goes up however the rows stand: and doubles may fall on either side of it."""
    prices = [0.1] * 5000, [0.7] * 500 + [150.0], [1000.1, 1000.2, 499.7], [499.7, 1000.2, 1000.1], [1500.0], [3500.0]
    rows = [(k, p) for k, own in enumerate(prices) for p in own]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = both(spark, "prefetch_plan", "orders", tmp_path)
    assert {r.o_custkey: r["size"] for r in df.where(F.col("start_at") == 0).collect()} == {0: 1, 1: 1, 2: 3, 3: 3, 4: 2, 5: 4}
