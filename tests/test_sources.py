"""Files in, files out, streams."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files, sinks
from folioscope.streaming import ingest


def epub(spine=True, encrypted=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        items = '<item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two%20.xhtml" media-type="application/xhtml+xml"/><item id="c" href="x.css" media-type="text/css"/>'
        order = '<spine><itemref idref="b"/><itemref idref="a"/></spine>' if spine else "<spine/>"
        z.writestr("OPS/book.opf", f'<package xmlns:dc="urn:dc"><metadata><dc:title>My Book</dc:title><dc:creator>Ann</dc:creator></metadata><manifest>{items}</manifest>{order}</package>')
        z.writestr("OPS/one.xhtml", "<h1>One</h1><p>first</p>")
        z.writestr("OPS/two .xhtml", "<h1>Two</h1><p>second</p>")
    return out.getvalue()


def test_epub():
    assert files.epub_markdown(epub()) == "# My Book\n\nBy Ann\n\n# Two\n\nsecond\n\n# One\n\nfirst\n"
    assert files.epub_markdown(epub(False)).endswith("second\n")


def test_documents_of_any_format(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(epub())
    (tmp_path / "a_b.md").write_text("# Title\nBy Bo\n")
    (tmp_path / "c.TXT").write_text("plain é")
    found = {r["source_format"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert found["epub"]["title"] == "My Book" and found["epub"]["authors"] == "Ann"
    assert found["markdown"]["title"] == "Title" and found["text"]["title"] == "C" and found["text"]["markdown"] == "plain é"
    assert found["text"]["sha256"] == hashlib.sha256("plain é".encode()).hexdigest()
    (tmp_path / "d.doc").write_text("x")
    with pytest.raises(Exception, match="unsupported source"):
        files.documents(spark, str(tmp_path)).collect()


def test_corpus_and_names(spark, tmp_path):
    for name in ("b.md", "a.md", "c.txt"):
        (tmp_path / name).write_text(name)
    assert [r["name"] for r in files.corpus(spark, str(tmp_path)).collect()] == ["a.md", "b.md"]
    with pytest.raises(Exception, match="missing document: z.md"):
        files.corpus(spark, str(tmp_path), ["a.md", "z.md"]).collect()


def test_run_files_of_three_layouts(spark, tmp_path):
    flat = {"run_id": "zz", "mean_blended": 0.9, "prompt_versions": {"p": "v001"}, "docs": [{"doc_name": "a", "blended": 0.9, "error": None}]}
    deep = {"run_id": "g", "mean_blended": 0.8, "prompt_versions": {}, "docs": [{"doc_name": "a", "score": {"blended": 0.8}}]}
    for path, body in (("runs/zz.json", flat), ("claim_graph/g/run.json", deep), ("merged_summary/m/run.json", deep | {"run_id": "m"})):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(body, indent=2))
    runs, scores = files.eval_runs(spark, str(tmp_path))
    assert [(r["run_id"], r["kind"]) for r in runs.collect()] == [("g", "graph"), ("m", "merged"), ("zz", "standard")]
    assert {(r["kind"], r["blended"]) for r in scores.collect()} == {("graph", 0.8), ("merged", 0.8), ("standard", 0.9)}
    written = {r["kind"]: json.loads(r["artifact"]) for r in sinks.run_artifacts(runs, scores).collect()}
    assert written["standard"]["docs"] == [{"doc_name": "a", "blended": 0.9}]


def test_calibration_and_manifests(spark, tmp_path):
    case = {"name": "n", "facts": ["f"], "summary": "s", "expected_covered": [True], "claims": [], "document": "d", "expected_supported": []}
    (tmp_path / "n.json").write_text(json.dumps(case))
    assert [tuple(r) for r in files.calibration_cases(spark, str(tmp_path)).collect()] == [("n", "coverage", 0, "f", True)]
    listed = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest(), 1)], "id string, sha256 string, size_bytes int")
    there = spark.createDataFrame([("a", bytearray(b"x"))], "id string, content binary")
    assert files.trusted_corpus(listed, there).count() == 1 and files.trusted_corpus(listed, there).first()["id"] == "a"
    with pytest.raises(Exception, match="SHA-256 differs"):
        files.trusted_corpus(listed, there.withColumn("content", F.lit(bytearray(b"y")))).collect()
    with pytest.raises(Exception, match="not in the folder"):
        files.trusted_corpus(listed, there.limit(0)).collect()


def test_small_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\n one \n\ntwo\nthree\n")
    assert [r["sample"] for r in files.samples(spark, str(tmp_path / "list.txt"), 2).collect()] == ["one", "two"]
    lines = spark.createDataFrame(list(enumerate(["# c", "", "export A='x=y'", "B = 2", "A=z", "=n"])), "line int, text string")
    assert {(r["key"], r["value"]) for r in files.dotenv(lines).collect()} == {("A", "z"), ("B", "2")}
    prompts = spark.createDataFrame([("p", "v010", "t", "v002"), ("p", "v002", "u", "v002")], "name string, version string, text string, active string")
    assert [(r["number"], r["is_active"]) for r in files.prompt_versions(prompts).collect()] == [(2, True), (10, False)]
    assert sinks.next_version(prompts).first()["version"] == "v011"
    assets = spark.createDataFrame([("d", "a.md"), ("d", "a.pdf"), ("d", "headers.md")], "asset_dir string, name string")
    assert tuple(files.asset_sources(assets).first()) == ("d", "a.md", "a.pdf")
    vault = spark.createDataFrame([("/v/b.pdf",), ("/v/.x.pdf",), ("/v/a.epub",), ("/v/n.md",), ("/v/assets/q.pdf",)], "path string")
    assert [r["path"] for r in files.vault_sources(vault, "/v/assets").collect()] == ["/v/a.epub", "/v/b.pdf"]
    assert files.audio_window_seconds() == 4800
    assert spark.range(1).select(sinks.archive_name(F.lit("s"), F.array(F.lit("s"), F.lit("s-2"))).alias("n")).first()["n"] == "s-3"


def test_stream_and_batch_agree(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(6):
        (source / f"f{i}.txt").write_text(f"text {i % 4}")

    def ingested():
        stream = ingest.files(spark, str(source), 2)
        ingest.run(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return {r["path"].rsplit("/", 1)[-1]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = ingested()
    assert sorted(first.values()) == ["ingested"] * 4 + ["skipped"] * 2
    (source / "g.txt").write_text("text 0")
    (source / "h.txt").write_text("new")
    again = ingested()
    assert again["g.txt"] == "skipped" and again["h.txt"] == "ingested" and {k: again[k] for k in first} == first
