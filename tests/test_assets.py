"""Folders of documents, graphs of chunks, archives, reuse, locks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph
from folioscope.sources import assets

DOCS = "path string, content binary, markdown string, toc string, title string, authors array<string>, name string"


def docs(spark, *rows):
    return spark.createDataFrame([(p, c, "# T\n", "- T", "T", ["A"], n) for p, c, n in rows], DOCS)


def folder(spark, root):
    return {(r["asset_dir"], r["filename"]): bytes(r["content"]) for r in spark.read.parquet(root).collect()}


def test_folders_are_written_whole(spark, tmp_path):
    root = str(tmp_path / "assets")
    made = assets.asset_files(docs(spark, ("/v/b.EPUB", b"one", "x_a"), ("/v/a.md", b"two", "y_a"), ("/v/c.pdf", b"three", "x_a")))
    told = assets.asset_outcomes(made, assets.there_in(spark, root))
    assert {(r["path"], r["status"]) for r in told.collect()} == {("/v/b.EPUB", "written"), ("/v/a.md", "written"), ("/v/c.pdf", "exists")}
    assets.write_assets(made, told, root)
    found = folder(spark, root)
    assert {k[1] for k in found if k[0] == "x_a"} == {"x_a.md", "x_a.EPUB", "headers.md", "metadata.json", "canonical_name.txt"}
    assert {k[1] for k in found if k[0] == "y_a"} == {"y_a.md", "headers.md", "metadata.json", "canonical_name.txt"}
    assert json.loads(found["x_a", "metadata.json"]) == {"title": "T", "authors": ["A"], "source_sha256": hashlib.sha256(b"one").hexdigest()}
    assert found["x_a", "canonical_name.txt"] == b"x_a\n"
    again = assets.asset_files(docs(spark, ("/v/d.pdf", b"new", "x_a")))
    told = assets.asset_outcomes(again, assets.there_in(spark, root))
    assert [r["status"] for r in told.collect()] == ["exists"]
    assets.write_assets(again, told, root)
    assert folder(spark, root) == found
    told = assets.asset_outcomes(again, assets.there_in(spark, root), force=True)
    assets.write_assets(again, told, root, force=True)
    now = folder(spark, root)
    assert now["x_a", "x_a.pdf"] == b"new" and ("x_a", "x_a.EPUB") not in now and ("y_a", "y_a.md") in now


def test_of_forced_sources_the_last_stays(spark):
    made = assets.asset_files(docs(spark, ("/v/b.pdf", b"one", "n"), ("/v/c.pdf", b"two", "n")))
    told = assets.asset_outcomes(made, spark.createDataFrame([("n",)], "asset_dir string"), force=True)
    assert {(r["path"], r["status"]) for r in told.collect()} == {("/v/b.pdf", "replaced"), ("/v/c.pdf", "written")}


def test_archives(spark):
    found = spark.createDataFrame([("d", "summary.md"), ("d", "x.md"), ("e", "summary_graph")], "asset_dir string, name string")
    taken = spark.createDataFrame([("d", "20260101T000000Z"), ("d", "20260101T000000Z-2")], "asset_dir string, run string")
    rows = assets.archive_plan(found, taken, F.lit("20260101T000000Z")).collect()
    assert {r["target"] for r in rows} == {"d/_summary_runs/20260101T000000Z-3/summary.md", "e/_summary_runs/20260101T000000Z/summary_graph"}


def test_reuse(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    there = spark.createDataFrame([("a", "old"), ("z", "old")], "k string, v string")
    make = lambda rows: rows.withColumn("v", F.lit("new"))
    got = lambda **more: {(r["k"], r["v"]) for r in assets.reuse(wanted, there, "k", make, **more).collect()}
    assert got() == {("a", "old"), ("b", "new")} and got(force=True) == {("a", "new"), ("b", "new")}


def test_graphs_of_chunks(spark, tmp_path):
    graphs = spark.createDataFrame([("d/1", "{1}"), ("d/2", "{2}")], "doc_id string, graph string")
    selected = spark.createDataFrame([("d/1", "{s}")], "doc_id string, graph string")
    markdown = spark.createDataFrame([("d/1", "# S\n")], "doc_id string, markdown string")
    chunks = spark.createDataFrame([("d/1", "d", "001_a"), ("d/2", "d", "002_b")], "doc_id string, document string, chunk string")
    made = assets.graph_files(graphs, selected, markdown, chunks)
    assert {(r["chunk"], r["filename"]) for r in made.collect()} == {("001_a", "graph.json"), ("001_a", "selected_subgraph.json"), ("001_a", "selected_subgraph.md"), ("002_b", "graph.json")}
    path = str(tmp_path / "graphs")
    assets.write_graph_files(made, path)
    assets.write_graph_files(made, path)
    both = spark.createDataFrame([("d",), ("e",)], "document string")
    index = {r["document"]: r["index"] for r in assets.graph_index(both, spark.read.parquet(path), F.lit("/g")).collect()}
    assert index["e"] == "# Chunk Graphs\n\nNo chunk graph artifacts were produced.\n"
    head = "# Chunk Graphs\n\n## 001_a\n\n- Graph JSON: `/g/chunks/001_a/graph.json`\n- Selected subgraph JSON: `/g/chunks/001_a/selected_subgraph.json`\n- Selected subgraph Markdown: `/g/chunks/001_a/selected_subgraph.md`\n\n# S\n\n## 002_b\n"
    assert index["d"].startswith(head) and index["d"].endswith("selected_subgraph.md`\n")


def test_graph_cache(spark):
    nodes = spark.createDataFrame([("d", 0, "n", "claim", "l", "s", "t", 1, 0.5, {})], graph.NODES)
    edges = spark.createDataFrame([], graph.EDGES)
    whole = graph.to_json(nodes, edges).first()["graph"]
    keys = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k3"), ("d", "k4")], "doc_id string, key string")
    cache = spark.createDataFrame([("k1", whole), ("k2", whole[:-5]), ("k3", '{"nodes": [{"id": 1}]}')], "key string, graph string")
    hits, misses = assets.cached_graphs(keys, cache)
    assert [r["doc_id"] for r in hits.collect()] == ["a"] and sorted(r["doc_id"] for r in misses.collect()) == ["b", "c", "d"]
    chunks = spark.createDataFrame([("a", 1, "1.md", "x"), ("a", 2, "2.md", "y")], "doc_id string, pos int, filename string, text string")
    key = lambda rows, **s: assets.graph_key(rows, F.lit("a"), **s).first()["key"]
    assert key(chunks, limit=8) == key(chunks.orderBy(F.desc("pos")), limit=8) != key(chunks, limit=9)
    assert key(chunks, limit=8) != key(chunks.withColumn("text", F.lit("x")), limit=8) and len(key(chunks)) == 24


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with assets.run_lock(path):
        with pytest.raises(assets.LockHeld), assets.run_lock(path):
            pass
    with assets.run_lock(path):
        pass
