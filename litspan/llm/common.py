"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that setting is absent, a session in
    one process (tests) gets a temporary folder of its machine; on a cluster that is an error, as executors share no such folder.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="litspan-checkpoint-"))
    # what a plan knows of its columns is kept with a checkpoint, and grows with every union of joins in a loop until planning takes all memory
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(name, before)


HOTTEST = 1024


def join_told(rows: DataFrame, told: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined by ``key`` to ``told``, which has one row for each key; ``how`` is left or inner.

    ``count`` is a column of ``told``: how many of the ``total`` rows have the key, at least. Keys with more than the share 1 / HOTTEST of
    them, of which there are fewer than HOTTEST, are broadcast, so that their rows stay where they are; the others meet in a shuffle, and null keys don't.
    """
    hot = F.col(count) * HOTTEST > F.lit(total)
    few, rest = told.where(hot), told.where(~hot)
    full = rows.where(F.col(key).isNotNull())
    if few.isEmpty():
        both = full.join(told, key, how)
    else:
        both = full.join(F.broadcast(few), key).unionByName(full.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key, how))
    return both if how == "inner" else both.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


TASK_BYTES, TASK_ROWS = 64 << 20, 500_000


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in partitions of about TASK_ROWS: a loop over a small table doesn't write a file for each shuffle partition in each round."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def measured(docs: DataFrame, text_column: str) -> tuple[int, int]:
    """The number of rows, and of shuffle partitions for their texts: the session's, or more so that one holds about TASK_BYTES."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0))).first()
    return rows, max(shuffle_width(docs), -(-size // TASK_BYTES))


def slices(batch: pa.RecordBatch, weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose weights add up to about ``most`` (a row above it stands alone)."""
    start = total = 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(weights):
        yield start, len(weights)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (case counts for nothing)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """A string column as a list; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split a stream sorted by ``keys`` into one table per key; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(n):
            if rows[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, rows[i]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
