"""Tables of a data folder, read by Spark so that any store its readers know will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, columns: str, values: str) -> DataFrame:
    """A small fixed frame from SQL rows, as used by fixtures: columns "a, b", values "(1, 'x'), (2, 'y')"."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
