"""Writing results. Spark's committers stage and rename, so readers never see half a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    """chunks (doc_id, filename, content) as a table partitioned by document, replacing what was there."""
    chunks.write.mode("overwrite").partitionBy("doc_id").parquet(path)


def metadata_json(columns: list[Column]) -> Column:
    """A row's values as JSON without nulls."""
    return F.to_json(F.struct(*columns))


def sorted_json(m: Column) -> Column:
    """A map as JSON in order of keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def run_artifacts(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """(run_id, kind, artifact): a JSON text a run with its documents in order."""
    docs = scores.groupBy("run_id", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_name", "blended", "error"))).alias("docs"))
    full = runs.join(docs, ["run_id", "kind"], "left")
    return full.select("run_id", "kind", F.to_json(F.struct("run_id", "mean_blended", "prompt_versions", F.transform("docs", lambda d: d.dropFields("pos")).alias("docs"))).alias("artifact"))


def append_lineage(rows: DataFrame, path: str) -> None:
    """JSON lines that are only ever added to."""
    rows.write.mode("append").json(path)


def manifest(states: DataFrame) -> DataFrame:
    """(doc_id, manifest) of (doc_id, status, stages, error): running, failed or complete."""
    good = F.col("status").isin("running", "failed", "complete")
    status = F.when(good, F.col("status")).otherwise(F.raise_error(F.lit("unknown status")).cast("string"))
    return states.select("doc_id", F.to_json(F.struct(status.alias("status"), "stages", "error")).alias("manifest"))


def present_artifacts(listed: DataFrame, there: DataFrame, always: str) -> DataFrame:
    """Listed paths that exist, and the manifest itself in any case."""
    kept = listed.join(there.select("path").distinct().withColumn("exists", F.lit(True)), "path", "left")
    return kept.where(F.col("exists") | (F.col("path") == always)).drop("exists")


def write_transcripts(rows: DataFrame, path: str, force: bool = False) -> None:
    """Refuses to replace unless forced."""
    rows.write.mode("overwrite" if force else "errorifexists").json(path)


def work_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def next_version(versions: DataFrame) -> DataFrame:
    """(name, version): one above the highest, three digits at least."""
    return versions.groupBy("name").agg((F.max(F.substring("version", 2, 9).cast("int")) + 1).alias("n")).select("name", F.format_string("v%03d", "n").alias("version"))


def new_versions(offered: DataFrame, there: DataFrame) -> DataFrame:
    """Offered versions that don't exist yet; an existing one is never replaced."""
    return offered.join(there.select("name", "version"), ["name", "version"], "left_anti")


def archive_name(stamp: Column, taken: Column) -> Column:
    """A stamp, or the first of stamp-2, stamp-3 and so on that isn't taken."""
    tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.when(i == 1, stamp).otherwise(F.concat(stamp, F.lit("-"), i.cast("string"))))
    return F.element_at(F.array_except(tries, taken), 1)
