"""Sizes and counts of papers as sketches that merge: quantiles (KLL) and distinct values (HyperLogLog), stored with each paper.

A corpus, a year or a category merges the stored sketches of its papers and never reads their spans again. A KLL sketch of parameter k is of bounded size and tells a quantile's rank with an error
that falls as 1/k; a HyperLogLog of ``2^lg`` registers tells a number of distinct values with a relative error of about 0.8 / sqrt(2^lg). What must be exact (the modal size, counts) is counted, not sketched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES, REGISTERS = 200, 12
RANK_ERROR = 0.0265  # of a quantile's rank at k = 200, two-sided with probability 0.99 for one quantile
LEAST = 4.0  # sizes up to it are none


def paper_sketches(spans: DataFrame, by: list[str], size: str = "size", text: str = "text", k: int = QUANTILES, registers: int = REGISTERS) -> DataFrame:
    """For each paper: ``spans`` (exact), ``sizes`` (KLL of sizes above LEAST) and ``words`` (HyperLogLog of texts). Null sizes and texts count for nothing. One exchange, of sketches."""
    real = F.when(F.col(size) > LEAST, F.col(size).cast("double"))
    return spans.groupBy(*by).agg(F.count("*").alias("spans"), F.kll_sketch_agg_double(real, F.lit(k)).alias("sizes"), F.hll_sketch_agg(F.col(text).cast("string"), F.lit(registers)).alias("words"))


def merged(sketches: DataFrame, by: list[str], k: int = QUANTILES) -> DataFrame:
    """The sketches of groups of papers: the same columns, by ``by`` (none: one row)."""
    parts = [F.sum("spans").alias("spans"), F.kll_merge_agg_double("sizes", F.lit(k)).alias("sizes"), F.hll_union_agg("words").alias("words")]
    return sketches.groupBy(*by).agg(*parts)


def quantile(sizes: Column | str, share: float) -> Column:
    """The size at a share of the sketch's rows; null of an empty sketch."""
    return F.when(F.kll_sketch_get_n_double(sizes) > 0, F.kll_sketch_get_quantile_double(sizes, F.lit(share)))


def distinct(words: Column | str) -> Column:
    """The estimated number of distinct texts."""
    return F.hll_sketch_estimate(words)


def refreshed(stored: DataFrame, spans: DataFrame, changed: DataFrame, by: list[str], **how) -> DataFrame:
    """Stored sketches with those of changed papers made anew: only their spans are read."""
    fresh = paper_sketches(spans.join(changed, by, "left_semi"), by, **how)
    return stored.join(changed, by, "left_anti").unionByName(fresh)
