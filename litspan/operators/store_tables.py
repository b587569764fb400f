"""Stored tables laid out for their reads: bucketed by paper and sorted in it, with Bloom filters on the key.

Scans of a paper, replacements, counts and joins by paper then need no exchange: Spark plans them on the buckets. A point read opens one bucket of the table and skips
row groups by their statistics and filters. A replacement writes a new version of the table beside the old one, from the old rows of other papers and the new ones, bucket by bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


@dataclass(frozen=True)
class Layout:
    """How a table is stored: its key, the columns it is sorted by within the key, and the number of buckets (equal for tables that are joined)."""

    key: str
    order: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def write(self, rows: DataFrame, name: str, path: str) -> DataFrame:
        """Write the table ``name`` at ``path``, one file for each bucket. Null keys have a bucket, too."""
        dealt = rows.repartition(self.buckets, self.key)
        writer = dealt.write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key, *self.order)
        writer.option("path", path).option(f"parquet.bloom.filter.enabled#{self.key}", "true").format("parquet").saveAsTable(name)
        return rows.sparkSession.table(name)

    def replaced(self, table: DataFrame, new: DataFrame, papers: DataFrame, name: str, path: str) -> DataFrame:
        """The table's next version: without the rows of ``papers`` (one column, the key), with ``new`` ones. The old rows stay in their buckets; only the new ones and the keys are dealt."""
        kept = table.join(papers.select(self.key).distinct(), self.key, "left_anti")
        return self.write(kept.select(*table.columns).unionByName(new.select(*table.columns)), name, path)

    def of_paper(self, table: DataFrame, paper) -> DataFrame:
        """The rows of one paper in their order: one bucket is opened."""
        return table.where(F.col(self.key) == F.lit(paper)).orderBy(*self.order) if self.order else table.where(F.col(self.key) == F.lit(paper))

    def counts(self, table: DataFrame, name: str = "n") -> DataFrame:
        """Rows of each paper, counted where they are."""
        return table.groupBy(self.key).agg(F.count("*").alias(name))


def joined(parents: DataFrame, children: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A parent's rows with its children's; tables of equal layouts are joined bucket by bucket. The hint keeps tables of any size from being sent whole."""
    return parents.hint("merge").join(children, key, how)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose paper isn't stored: what a foreign key forbids."""
    return children.hint("merge").join(parents.select(key), key, "left_anti")


def version(spark: SparkSession, name: str) -> str:
    """A table name that isn't taken."""
    k = 1
    while spark.catalog.tableExists(f"{name}_v{k}"):
        k += 1
    return f"{name}_v{k}"
