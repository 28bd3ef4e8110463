"""The corpus pipeline: quality, line dedup, near-dedup, mixing, tokens. Each stage reads what the last one wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.llm import byte_bpe, line_dedup, mixing, quality_classifier, simhash
from lendframe.llm.common import release, stored, unused

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go: NULL and blank texts too. An empty table stays empty."""
    return quality_classifier.classify(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by three documents or more stay in one of them; n_chars follows the text, a NULL text becomes empty."""
    kept = line_dedup.line_dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id; one without id if none of the group has any."""
    return simhash.representatives(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document that is taken twice is two rows."""
    sized = stored(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words")), "mix-sizes")
    mixed = mixing.taken(docs.select(*COLUMNS), mixing.plan(sized, "words"))
    (copy,) = unused(mixed, "copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row encoded to byte-level BPE ids, and the digest of what they decode to."""
    coded = byte_bpe.encode_and_decode(
        docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select("doc_id", "source", *byte_bpe.digests())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", mixture),
    ("byte_bpe", tokens),
]

#: The classifier's fit can't be written in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # what the stage before wrote has been read
        release(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
