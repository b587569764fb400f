"""Pages at any depth: where in an order a row number falls, from counts of ranges, so that only its range is sorted.

Borders are taken from a sample; one pass counts the rows between them. The counts tell which ranges a page lies in, the borders are predicates that a reader
can push down, and what is sorted is the rows of those ranges. An order's columns hold no null, and a unique one ends it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000  # rows from which borders are taken, at most about twice
RANGES = 24
Order = list[tuple[str, bool]]


def after(order: Order, row: tuple) -> Column:
    """Whether a row comes after another one, given by its values in the order's columns (name, whether descending)."""
    past, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, row, strict=True):
        c, v = F.col(name), F.lit(value)
        past, equal = past | (equal & ((c < v) if down else (c > v))), equal & (c == v)
    return past


def sorting(order: Order) -> list[Column]:
    return [F.desc(n) if down else F.asc(n) for n, down in order]


@dataclass(frozen=True)
class Ranks:
    """Borders of an order's ranges, and how many rows are in each: range i holds what comes after border i - 1 and not after border i."""

    order: Order
    borders: list[tuple]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """Ranges with the numbers of rows before and through them."""
        so_far = 0
        for i, n in enumerate(self.counts):
            yield i, so_far, so_far + n
            so_far += n

    def within(self, low: int, high: int) -> Column:
        """Predicate of the ranges from ``low`` to ``high``. The leading column's bounds stand alone, as readers push them down."""
        parts = []
        name, down = self.order[0]
        for i, outer in ((low - 1, True), (high, False)):
            if 0 <= i < len(self.borders):
                past, v = after(self.order, self.borders[i]), F.lit(self.borders[i][0])
                parts.append((F.col(name) <= v if down else F.col(name) >= v) & past if outer else (F.col(name) >= v if down else F.col(name) <= v) & ~past)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def rank_index(rows: DataFrame, order: Order, ranges: int = RANGES, sample: int = SAMPLE) -> Ranks:
    """The index of an order: two passes, over the key columns only. The driver sees a border and a count for each range."""
    keys = rows.select(*[n for n, _ in order])
    n = keys.count()
    step = max(1, n // sample)
    some = keys.where(F.pmod(F.xxhash64(*keys.columns), F.lit(step)) == 0).orderBy(*sorting(order)).limit(4 * sample)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*sorting(order)))  # over the sample alone, which is bounded
    kept = some.withColumn("__r", number).where(F.col("__r") % max(1, min(n, sample) // ranges) == 0).drop("__r").orderBy(*sorting(order)).collect()
    borders = [tuple(r) for r in kept[: 2 * ranges]]
    if not borders:
        return Ranks(order, [], [n])
    place = reduce(lambda a, b: a + b, [after(order, b).cast("int") for b in borders])
    counts = dict(keys.select(place.alias("range")).groupBy("range").count().collect())
    return Ranks(order, borders, [counts.get(i, 0) for i in range(len(borders) + 1)])


def page_at(rows: DataFrame, index: Ranks, start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` (from 0) of the order, with ``position`` from 1. Only the ranges that hold them are sorted."""
    met = [(i, lo) for i, lo, hi in index.spans() if lo < start + size and hi > start]
    if not met or size <= 0:
        return rows.where(F.lit(False)).withColumn("position", F.lit(0))
    (low, before), (high, _) = met[0], met[-1]
    by = sorting(index.order)
    top = rows.where(index.within(low, high)).orderBy(*by).offset(start - before).limit(size)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)) + start)
