"""Queries of bibliography parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspan.operators import references as B
from litspan.plans.registering import query
from litspan.sources.tables import table

ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMBERED = f"SELECT l_orderkey AS paper, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS pos FROM lineitem"
RUNS = f"""WITH nums AS ({NUMBERED}), f AS (SELECT paper, n, min(pos) AS p FROM nums GROUP BY paper, n),
    g AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY paper ORDER BY p) + 1 THEN 0 ELSE 1 END AS new FROM f),
    h AS (SELECT *, sum(new) OVER (PARTITION BY paper ORDER BY p) AS i FROM g),
    r AS (SELECT paper, i, count(*) AS len, min(n) AS lo, max(n) AS hi FROM h GROUP BY paper, i),
    best AS (SELECT paper, len, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY len DESC, i) AS k FROM r) WHERE k = 1)"""


def _numbers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("n"), *ORDER)
    return lines.select("paper", "n", F.row_number().over(Window.partitionBy("paper").orderBy(*ORDER)).alias("pos"))


def _runs(spark, sf_dir):
    """Each paper's count of numbers and run: rows, counts and runs come from one exchange."""
    return B.with_run(_numbers(spark, sf_dir), "paper").groupBy("paper").agg(*[F.first(c).alias(c) for c in ("every", "run_start", "run_length", "run_end")])


@query(f"{RUNS} SELECT paper, lo AS run_start, len AS run_length, hi AS run_end FROM best")
def ref_longest_run(spark, sf_dir):
    """The longest run of line numbers of each order."""
    return _runs(spark, sf_dir).select("paper", "run_start", "run_length", "run_end")


@query(f"{RUNS} SELECT paper, round(least(0.99, 0.65 + 0.25 * len / every + CASE WHEN len >= 5 THEN 0.2 ELSE 0.05 END), 6) AS confidence FROM best JOIN (SELECT paper, count(*) AS every FROM nums GROUP BY paper) USING (paper)")
def ref_confidence(spark, sf_dir):
    """The confidence of a numbered list."""
    return _runs(spark, sf_dir).select("paper", F.round(B.numbered_confidence(F.col("every"), F.col("run_length")), 6).alias("confidence"))


@query(f"{RUNS} SELECT nums.paper, count(*) AS kept FROM nums JOIN best USING (paper) WHERE n BETWEEN lo AND hi GROUP BY nums.paper")
def ref_entries_in_run(spark, sf_dir):
    """Entries whose number lies in the run."""
    numbers = B.with_run(_numbers(spark, sf_dir), "paper")
    return numbers.where(F.col("n").between(F.col("run_start"), F.col("run_end"))).groupBy("paper").agg(F.count("*").alias("kept"))
