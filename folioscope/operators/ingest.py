"""Ingest by content: what is known is skipped, what is half done resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asset_index(assets: DataFrame) -> DataFrame:
    """(sha256, asset_dir, processed) of (asset_dir, metadata, chunks): hidden folders and metadata
    without a hash are left out; of equal hashes the last folder counts."""
    sha = F.get_json_object("metadata", "$.source_sha256")
    read = assets.where(~F.col("asset_dir").startswith(".")).select(sha.alias("sha256"), "asset_dir", (F.col("chunks") > 0).alias("processed")).where("sha256 IS NOT NULL AND sha256 <> ''")
    return read.groupBy("sha256").agg(F.max(F.struct("asset_dir", "processed")).alias("x")).select("sha256", "x.asset_dir", "x.processed")


def plan(sources: DataFrame, index: DataFrame) -> DataFrame:
    """sources (path, sha256) with status: skipped, resumed or ingested; of equal new contents the
    first path is ingested and the others are skipped."""
    first = sources.groupBy("sha256").agg(F.min("path").alias("first"))
    known = sources.join(first, "sha256").join(index, "sha256", "left")
    status = F.when(F.col("processed"), "skipped").when(F.col("path") != F.col("first"), "skipped").when(F.col("processed").isNotNull(), "resumed").otherwise("ingested")
    return known.select("path", "sha256", "asset_dir", status.alias("status"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cache_misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys that a cache (key, value) has no usable value for."""
    return keys.join(cache.where(F.col("value").isNotNull()).select("key"), "key", "left_anti")
