"""The corpus pipeline: language filter, near-duplicate removal, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``, and others that the input has, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspan.llm import langid, ngrams, packing, pii
from litspan.llm.common import checkpointed, fresh, read_table

MIN_SCORE = 0.5  # posterior below which a document's language counts as unknown


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), and those whose language stays unsure, go. Repeated rows share their fate."""
    language, score = fresh(docs.columns, "language_"), fresh(docs.columns, "score_")
    found = langid.identify(docs, out=(language, score))
    return found.where((F.col(language) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays.

    Rows that repeat an id and a text are one document; texts without words (null and empty ones too) are nobody's copy and all stay. Of several texts with one id each has its own fate.
    """
    found = ngrams.jaccard_join(docs)
    mark = fresh(docs.columns, "mark")
    told = found.select("kept", "n_links", F.struct(F.col("doc_id").alias("id"), "row_key").alias(mark))
    keyed = docs.withColumn(mark, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row_key")))
    kept = keyed.join(told.where(~F.col("kept")).select(mark).distinct(), mark, "left_anti")
    repeated = told.where(F.col("kept") & (F.col("n_links") > 0)).groupBy(mark).count().where("count > 1")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    return kept.dropDuplicates([mark]).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and ``n_chars`` follows. No document goes; null and empty texts stay as they are, repeated rows are alike."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces, with their token ids (unsigned 16-bit). A null or empty text is its closing id, repeated rows are packed each; columns but the id go."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: The stages are learned or iterative; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; between them lineage is cut in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs


QUERIES = {"pipeline": lambda spark, sf_dir: packing.piece_checksums(run(spark, sf_dir))}
ORACLES: dict[str, str] = {}
