"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage is one operator over all that its predecessor kept. All but the last return the columns
of documents; the last adds the ids, their number, and the digest of the decoded text.

Cases that hold for all stages: an empty table stays empty; null ids, languages and sources are values
like any other; rows are told apart by their place in a written table, so repeated ids and rows don't
matter; texts of any length are read whole; columns beyond those of documents are passed on by all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, exact_dedup, mixing, near_dedup, quality
from folioscope.llm.runtime import documents, durable, small_batches

#: Share of the tokens that are left when the mixture is drawn.
MIXTURE = 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and blank texts go; repeated rows go or
    stay together."""
    small_batches(spark)
    return quality.keep_good(docs)


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id; a null text equals the empty one. Of rows that repeat
    that id and text any one stays."""
    return exact_dedup.drop_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity of five-word shingles (0.8 or more), the first row of the least
    id. Texts without words are linked with nothing and stay."""
    small_batches(spark)
    return near_dedup.keep_one(docs, 5, 80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture of sources selects, each once: whole epochs beyond the first would bring
    back copies. Texts without tokens are never selected; ties at the end of a prefix go by id and text."""
    return mixing.keep_mixture(docs, MIXTURE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and what decoding them gives. A null text has no ids."""
    small_batches(spark)
    ids = bpe.encode_column(docs.select("doc_id", "lang", "source", "n_chars", "text"))
    return bpe.decode_column(ids).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equals),
    ("n-gram Jaccard join", one_of_similar),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", token_ids),
]
#: SQL has no form of the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "pipeline-" + "-".join(name.lower().split()))
    return docs
