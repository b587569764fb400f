"""Binary files of papers, and the checks their bytes must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_error(content: Column, status: Column | None = None) -> Column:
    """Why bytes (and the status they came with) are no usable PDF; null if they are."""
    http = F.lit(None).cast("string")
    if status is not None:
        http = (
            F.when(status == 404, "PDF not found (404)").when(status == 403, "Access denied (403)").when(status == 429, "Rate limited (429)")
            .when(status >= 500, F.concat(F.lit("Server error ("), status.cast("string"), F.lit(")"))).when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))
        )
    empty = content.isNull() | (F.length(content) == 0)
    return F.coalesce(http, F.when(empty, "Empty response body"), F.when(F.substring(content, 1, 4) != F.lit(b"%PDF"), "Response is not a PDF"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below a path: path, length, content, error (a file that fails is a row, not an exception)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "length", "content", pdf_error(F.col("content")).alias("error"))
