"""The queries opN_<name>: each applies one operator to its whole table and returns its digest."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspan.llm import bpe, divergence, embeddings, fingerprints, htmltext, langid, lexical, licenses, ngrams, packing, pii, urls, wordbpe
from litspan.llm.common import read_table
from litspan.llm.oracles import ORACLES

QUERIES: dict = {}
__all__ = ["ORACLES", "QUERIES"]


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; digests of both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), path)
    return bpe.decode_documents(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the training fold."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, carry=["doc_id"])
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; a row for each piece with the checksum of its ids."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.piece_checksums(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every whole text."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = htmltext.extract(read_table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of the whole table."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and component of every document, by word five-grams with a similarity of 0.8."""
    found = ngrams.jaccard_join(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "component_id", "kept")


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base counts and digest, and all spans."""
    found = pii.find(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.joined("base")), 256).alias("base_sha256"), F.expr(pii.joined("concat(base, more)")).alias("spans"))


@query
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the streaming transducer and decoded as the library spells it; digests of both."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = wordbpe.encode_documents(read_table(spark, sf_dir, "documents"), path)
    return wordbpe.decode_documents(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and each source's ten most typical terms."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
