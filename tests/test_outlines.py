"""Outline corpora, annotations, names of runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files, outlines

INPUT = b"# Contents\n- One (H2, line 3, 4 lines)\n- Two (H2, line 9, 4 lines)\n"
LINES = [
    "---", "document:", "  title: A Book", "  level: H1", "  line: 1", "",
    "section:", "  level: TODO", "  first_heading: TODO", "  line: TODO", "",
    "chapter:", "  level: H2", '  first_heading: "One: \\"x\\""', "  line: 03", "",
    "subchapter:", "  level: TODO", "  first_heading: TODO", "  line: TODO", "---",
]


def text(**changed):
    lines = list(LINES)
    for at, line in changed.items():
        lines[int(at[1:])] = line
    return ("\n".join(lines) + "\n").encode()


def read(spark, *outputs):
    rows = spark.createDataFrame([(str(i), INPUT, o) for i, o in enumerate(outputs)], "id string, input binary, output binary")
    return [(r["annotation"], r["problem"]) for r in outlines.annotations(rows).orderBy(F.col("id").cast("int")).collect()]


def test_annotations(spark):
    [(said, wrong)] = read(spark, text() + INPUT)
    assert wrong is None and said["document.title"] == "A Book" and said["chapter.level"] == "H2"
    assert said["chapter.first_heading"] == 'One: "x"' and said["chapter.line"] == "3" and said["section.line"] == "TODO"


def test_annotations_that_are_wrong(spark):
    bad = {
        "the input is changed": text() + INPUT[:-1] + b"x",
        "not UTF-8": b"\xff" + text() + INPUT,
        "not 21 lines": b"\n" + text() + INPUT,
        "line 7 isn't 'section:'": text(x6="sections:") + INPUT,
        "no document.title": text(x2="  title:  ") + INPUT,
        "document.level is neither TODO nor H1 to H6": text(x3="  level: H7") + INPUT,
        "chapter.line is neither TODO nor a positive number": text(x14="  line: 0") + INPUT,
        "chapter.first_heading isn't a string": text(x13='  first_heading: "open') + INPUT,
        "the fences don't end with a line feed": text()[:-1] + b"\r\n" + INPUT,
    }
    assert read(spark, *bad.values()) == [(None, why) for why in bad]
    blank = spark.createDataFrame([("a", None, None), ("b", b"", text())], "id string, input binary, output binary")
    found = {r["id"]: r["problem"] for r in outlines.annotations(blank).collect()}
    assert found == {"a": "the input is changed", "b": None}


def test_pending_outlines_and_status(spark):
    rows = spark.createDataFrame([("p", INPUT, None), ("c", INPUT, text() + INPUT), ("w", INPUT, text(x12="  level: H3") + INPUT), ("b", INPUT, b"x")], "id string, input binary, output binary")
    filled = rows.withColumn("output", F.coalesce("output", outlines.pending(F.col("input"))))
    found = {r["id"]: (r["predicted"], r["expected"], r["status"], r["problem"]) for r in outlines.evaluate(filled).collect()}
    assert found["p"] == ("H2", None, "pending", None) and found["c"] == ("H2", "H2", "correct", None)
    assert found["w"] == ("H2", "H3", "incorrect", None) and found["b"][2:] == (None, "the input is changed")


def candidates(spark, n):
    return spark.createDataFrame([(f"A B/{i:02d}/headers.md", i + 1, b"x" * (i + 1)) for i in range(n)], "source string, entry_count int, content binary")


@pytest.mark.parametrize(("count", "ranks"), [(1, [5]), (2, [0, 9]), (4, [0, 3, 6, 9])])
def test_corpus(spark, count, ranks):
    rows = outlines.corpus(candidates(spark, 10), count).collect()
    assert [r["source"] for r in rows] == [f"A B/{i:02d}/headers.md" for i in ranks]
    source, content = rows[0]["source"], bytes(rows[0]["input"])
    short = lambda x: hashlib.sha256(x).hexdigest()[:12]
    assert rows[0]["id"] == f"a-b-{ranks[0]:02d}-headers-md-{short(source.encode())}-{short(content)}"
    assert bytes(rows[0]["output"]).endswith(content) and len(bytes(rows[0]["output"]).splitlines()) == 22


def test_corpus_is_written_once_and_trusted(spark, tmp_path):
    with pytest.raises(ValueError, match="2 outlines"):
        outlines.corpus(candidates(spark, 2), 3)
    path = str(tmp_path / "corpus")
    outlines.write_corpus(outlines.corpus(candidates(spark, 5), 3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        outlines.write_corpus(outlines.corpus(candidates(spark, 5), 2), path)
    manifests = spark.read.text(f"{path}/manifest", wholetext=True).withColumnRenamed("value", "manifest")
    listed = outlines.manifest_cases(manifests)
    content = spark.read.parquet(f"{path}/cases").select("id", F.col("input").alias("content"))
    assert sorted(r["entry_count"] for r in files.trusted_corpus(listed, content).collect()) == [1, 3, 5]


@pytest.mark.parametrize("change", [
    {"version": 2}, {"version": True}, {"cases": []}, {"more": 1}, {"id": "A"}, {"source": "/a"}, {"source": "a/../b"}, {"sha256": "0"}, {"size_bytes": -1}, {"entry_count": "1"}, {"extra": 1},
])
def test_manifests_are_strict(spark, change):
    case = {"id": "a-1", "source": "a/headers.md", "sha256": "0" * 64, "entry_count": 1, "size_bytes": 3}
    whole = {"version": 1, "cases": [case]}
    for key, value in change.items():
        (whole if key in ("version", "cases", "more") else case)[key] = value
    rows = spark.createDataFrame([(json.dumps(whole),)], "manifest string")
    with pytest.raises(Exception, match="manifest"):
        outlines.manifest_cases(rows).collect()


def test_names(spark):
    names = ["a", "A.b_c-9", "", "-a", "a b", "a" * 64, "a" * 65, "a\n", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r["ok"] for r in rows.select("i", outlines.is_run_id(F.col("n")).alias("ok")).orderBy("i").collect()] == [True, True, False, False, False, True, False, False, False]
    one = lambda values: spark.createDataFrame([(values,)], "v array<string>").select(outlines.prompt_overrides(F.col("v")).alias("m"))
    assert one(["a=1", "b=x=y", "a=2"]).first()["m"] == {"a": "2", "b": "x=y"} and one([]).first()["m"] == {}
    for wrong in (["a"], ["=1"], ["a="]):
        with pytest.raises(Exception, match="NAME=VERSION"):
            one(wrong).collect()
    unknown = one(["z=1", "b=1", "a=1"]).select(outlines.unknown_names(F.col("m"), F.array(F.lit("a"))).alias("u"))
    assert unknown.first()["u"] == ["b", "z"]
