"""Ordered folds: state that runs along a key's rows in order.

Rows are dealt out by key, sorted within the partition and streamed through Arrow batches, with one key's state held at a time. No
group is collected, so a key with a third of all rows costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Step, outputs: str) -> DataFrame:
    """Add columns to each row: ``step(state, input values) -> (state, output values)`` in the order within the key.

    Result columns: keys, order, and ``outputs`` (a DDL string).
    """
    kept = list(dict.fromkeys([*keys, *order]))
    rows = df.select(*kept, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, *keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [outputs])
    empty = df.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    names = empty.columns
    kinds = [f.type for f in to_arrow_schema(empty.schema)][len(kept) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))], strict=True))
            values = list(zip(*[batch.column(k).to_pylist() for k in range(len(kept), batch.num_columns)], strict=True))
            out = []
            for key, value in zip(at, values, strict=True):
                if key != last or state is None:
                    last, state = key, start()
                state, result = step(state, value)
                out.append(result)
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=names)

    return dealt.mapInArrow(run, schema)
