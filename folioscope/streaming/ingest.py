"""The same ingest on a stream: a micro-batch is planned against the index and added to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import ingest


def index_at(spark: SparkSession, path: str) -> DataFrame:
    """The index table, empty if it isn't there yet."""
    schema = "sha256 string, asset_dir string, processed boolean, batch bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run(stream: DataFrame, index_path: str, outcome_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None):
    """Start ingesting a stream of (path, sha256) and return the query; it ends when all there is is read.

    A batch that is run again after a failure replaces its own files, so its outcome is written once.
    process turns new sources into (sha256, asset_dir, processed).
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = index_at(spark, index_path).where(F.col("batch") < number)
        latest = known.groupBy("sha256").agg(F.max_by(F.struct("asset_dir", "processed"), "batch").alias("x")).select("sha256", "x.asset_dir", "x.processed")
        planned = ingest.plan(batch, latest).persist()
        try:
            new = planned.where("status <> 'skipped'")
            done = process(new) if process else new.select("sha256", F.substring("sha256", 1, 12).alias("asset_dir"), F.lit(True).alias("processed"))
            planned.write.mode("overwrite").parquet(f"{outcome_path}/batch={number}")
            done.select("sha256", "asset_dir", "processed").write.mode("overwrite").parquet(f"{index_path}/batch={number}")
        finally:
            planned.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, sha256) of a folder's files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.schema(schema).format("binaryFile").option("maxFilesPerTrigger", per_batch).load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"))
