"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Empty tables go through every stage as empty tables.
A stage bounds the session's Arrow batches, as its rows are read after it has returned.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, common, line_dedup, mixing, ngram_join, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _bounded(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what importance resampling selects: as many documents as the models take for good, untoxic text."""
    return quality.select(docs, _labels(spark, sf_dir)).where("selected").select(*COLUMNS)


@_bounded
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more; n_chars follows. A document that loses all its text goes."""
    kept = line_dedup.dedup_lines(docs).where("n_dropped = 0 OR trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@_bounded
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, keep one row: that of the smallest id.

    Rows that repeat an id, or have none (first), are documents of their own, in the order of their texts.
    """
    own = common.numbered(docs, "row")
    groups = ngram_join.jaccard_join(own.select(F.col("row").alias("doc_id"), "text"), n=5, num=80, den=100)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("row"))
    return own.join(gone, "row", "left_anti").select(*COLUMNS)


@_bounded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: rounded draws, so that what is left of other domains has its bound of the tokens. Ids repeat with copies.

    Domains are known from the documents as they were before the first stage: what that one leaves of junk and toxic text
    is too little, and too unlike the rest of it, to tell it by.
    """
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixed = mixing.mix(docs, _labels(spark, sf_dir), mixing.AFTER_FILTER, at_most=True, known=known).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


@_bounded
def bpe_encoding_and_decoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its ids, and what they decode to; null texts count as empty."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_encoding_and_decoding),
]

#: Importance resampling, component search and BPE are not for SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; a stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for _, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), "stage")
        if written is not None:
            common.unsave(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
