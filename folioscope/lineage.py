"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a temporary one; on a
    cluster executors couldn't read that, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cuts(*dfs: DataFrame) -> list[DataFrame]:
    """Each of dfs cut, side by side: for tables that don't need each other. The first error in order is raised
    when all have ended."""
    spark = dfs[0].sparkSession
    shared_folder(spark)  # made once, where none is set
    with ThreadPoolExecutor(len(dfs)) as pool:
        made = [pool.submit(inheritable_thread_target(spark)(cut), df) for df in dfs]
    return [m.result() for m in made]
