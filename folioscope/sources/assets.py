"""Folders of documents: what a source is turned into, graphs of its chunks, archives, reuse and locks.

A folder is a partition of a table of files (asset_dir, filename, content); Spark's committers stage
and rename, so a folder is there as a whole or not at all.
"""

from __future__ import annotations

import fcntl
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from folioscope.functions import text as T
from folioscope.operators import graph
from folioscope.sources import files

#: What a summary leaves in a folder, and where earlier ones go; fixed values.
SUMMARY_FILES, SUMMARY_RUNS = ("summary.md", "chunk_summary.md", "summary_evidence.md", "summary_graph"), "_summary_runs"
_MARKDOWN = (".md", ".markdown")


def asset_files(docs: DataFrame) -> DataFrame:
    """(path, asset_dir, filename, content) of docs (path, content, markdown, toc, title, authors, name).

    A folder is named by the canonical name and holds the Markdown text, its table of contents,
    metadata with the source's hash, the name, and the source itself unless that is Markdown.
    """
    text = lambda c: c.cast("binary")
    meta = F.to_json(F.struct("title", "authors", F.sha2("content", 256).alias("source_sha256")))
    entry = lambda name, content: F.struct(name.alias("filename"), content.alias("content"))
    kind = F.regexp_extract(files.file_name(F.col("path")), r"(\.[^.]*)$", 1)
    own = F.when(~F.lower(kind).isin(*_MARKDOWN), entry(F.concat("name", kind), F.col("content")))
    every = F.array_compact(F.array(
        entry(F.concat("name", F.lit(".md")), text(F.col("markdown"))),
        entry(F.lit("headers.md"), text(F.coalesce("toc", F.lit("")))),
        entry(F.lit("metadata.json"), text(meta)),
        entry(F.lit("canonical_name.txt"), text(F.concat("name", F.lit("\n")))),
        own,
    ))
    return docs.select("path", F.col("name").alias("asset_dir"), F.inline(every))


def asset_outcomes(sources: DataFrame, there: DataFrame, force: bool = False) -> DataFrame:
    """sources (path, asset_dir) with status written, replaced or exists: a folder that is there, or that
    an earlier path gets, is only replaced by force, and then the last path's is the one that stays."""
    ranked = sources.select("path", "asset_dir").distinct().withColumn("n", F.row_number().over(Window.partitionBy("asset_dir").orderBy(F.desc("path") if force else F.col("path"))))
    known = ranked.join(there.select("asset_dir").distinct().withColumn("old", F.lit(True)), "asset_dir", "left")
    lost = F.lit("replaced" if force else "exists")
    status = F.when((F.col("n") > 1) | (F.col("old") & F.lit(not force)), lost).otherwise("written")
    return known.select("path", "asset_dir", status.alias("status"))


def there_in(spark: SparkSession, root: str) -> DataFrame:
    """(asset_dir) of the folders below a root; none if there is no root."""
    try:
        return spark.read.format("binaryFile").option("basePath", root).load(f"{root}/asset_dir=*").select(F.col("asset_dir").cast("string").alias("asset_dir")).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "asset_dir string")


def write_assets(made: DataFrame, outcomes: DataFrame, root: str, force: bool = False) -> None:
    """Files of asset_files whose outcome is written. Forced folders are replaced whole, all others stay."""
    wanted = made.join(outcomes.where("status = 'written'").select("path", "asset_dir"), ["path", "asset_dir"], "left_semi").drop("path")
    writer = wanted.repartition("asset_dir").write.partitionBy("asset_dir")
    (writer.option("partitionOverwriteMode", "dynamic").mode("overwrite") if force else writer.mode("append")).parquet(root)


def archive_plan(found: DataFrame, taken: DataFrame, stamp: Column) -> DataFrame:
    """(asset_dir, name, target): where summary files (asset_dir, name) are moved before a new run: a folder
    of the stamp, or the first of stamp-2, stamp-3 that isn't taken (asset_dir, run)."""
    from folioscope.sources import sinks

    runs = taken.groupBy("asset_dir").agg(F.collect_set("run").alias("runs"))
    own = found.where(F.col("name").isin(*SUMMARY_FILES)).join(runs, "asset_dir", "left")
    run = sinks.archive_name(stamp, F.coalesce("runs", F.array().cast("array<string>")))
    return own.select("asset_dir", "name", F.concat_ws("/", "asset_dir", F.lit(SUMMARY_RUNS), run, "name").alias("target"))


def reuse(wanted: DataFrame, there: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Results of there for keys that are wanted, and what make gives for the others, or for all by force."""
    if force:
        return make(wanted)
    kept = there.join(wanted.select(key).distinct(), key, "left_semi")
    return kept.unionByName(make(wanted.join(there.select(key), key, "left_anti")))


def graph_files(graphs: DataFrame, selected: DataFrame, markdown: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document, chunk, filename, content): each chunk's graph, its selected part and that part's text.

    graphs and selected (doc_id, graph), markdown (doc_id, markdown) are of chunks' graphs; chunks
    (doc_id, document, chunk) says which chunk of which document doc_id stands for.
    """
    said = chunks.join(graphs.select("doc_id", "graph"), "doc_id").join(selected.select("doc_id", F.col("graph").alias("part")), "doc_id", "left").join(markdown, "doc_id", "left")
    entry = lambda name, c: F.struct(F.lit(name).alias("filename"), F.col(c).alias("content"))
    every = F.filter(F.array(entry("graph.json", "graph"), entry("selected_subgraph.json", "part"), entry("selected_subgraph.md", "markdown")), lambda x: x["content"].isNotNull())
    return said.select("document", "chunk", F.inline(every))


def graph_index(docs: DataFrame, made: DataFrame, root: Column) -> DataFrame:
    """(document, index) for docs (document): the Markdown list of graph_files in order of chunks, with
    the selected parts' texts; root is the folder of a document."""
    path = lambda name: F.concat(F.lit("`"), F.concat_ws("/", root, F.lit("chunks"), "chunk", F.lit(name)), F.lit("`"))
    text = F.max(F.when(F.col("filename") == "selected_subgraph.md", F.col("content")))
    one = made.groupBy("document", "chunk").agg(text.alias("text"))
    line = lambda label, name: F.concat(F.lit(f"- {label}: "), path(name))
    listing = F.concat_ws("\n", line("Graph JSON", "graph.json"), line("Selected subgraph JSON", "selected_subgraph.json"), line("Selected subgraph Markdown", "selected_subgraph.md"))
    part = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("chunk")), listing, T.strip(F.col("text")))
    parts = one.withColumn("part", part).groupBy("document").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]).alias("parts"))
    whole = docs.select("document").distinct().join(parts, "document", "left")
    body = F.coalesce(F.array_join("parts", "\n\n"), F.lit("No chunk graph artifacts were produced."))
    return whole.select("document", F.concat(T.strip(F.concat(F.lit("# Chunk Graphs\n\n"), body)), F.lit("\n")).alias("index"))


def write_graph_files(made: DataFrame, path: str) -> None:
    """A table partitioned by document; the documents written are replaced, others stay."""
    made.repartition("document").write.partitionBy("document").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def cached_graphs(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keys (doc_id, key) in a cache (key, graph). A graph that can't be read is a miss.
    What is selected from a graph is worked out anew, so it is no part of a key."""
    usable = cache.where(graph.is_readable(F.col("graph"))).groupBy("key").agg(F.min("graph").alias("graph"))
    return keys.join(usable, "key"), keys.join(usable.select("key"), "key", "left_anti")


def graph_key(chunks: DataFrame, name: Column, **settings: object) -> DataFrame:
    """(doc_id, key): a document's name, its chunks (doc_id, pos, filename, text) in order, and whatever
    settings graphs are built with (prompt version, models, limits, threshold). Texts go in as hashes."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "filename", F.sha2("text", 256).alias("sha"))))
    said = chunks.withColumn("_name", name).groupBy("doc_id", "_name").agg(listed.alias("chunks"))
    fixed = [F.lit(f"{k}={v}") for k, v in sorted(settings.items())]
    return said.select("doc_id", T.key_of(F.col("_name"), F.to_json("chunks"), *fixed).alias("key"))


class LockHeld(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def run_lock(path: str) -> Iterator[None]:
    """One run at a time on the driver's machine; a held lock is an error at once. The system ends the lock
    with the process, so nothing stale stays. Streams have theirs in the checkpoint."""
    with open(path, "a") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise LockHeld(path) from e
        yield
