"""Ingest with state: batches, copies, work that is half done."""

from pyspark.sql import functions as F

from folioscope.streaming import ingest, stateful


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.md").write_text(text)


def outcomes(spark, path):
    return sorted((r["path"].rsplit("/", 1)[-1][:-3], r["status"], r["processed"]) for r in spark.read.parquet(str(path)).collect())


def test_batches_know_what_was_before(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run(per_batch):
        stateful.run(ingest.files(spark, str(source), per_batch), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    put(source, a="one", b="two", c="one")
    run(1)
    first = outcomes(spark, tmp_path / "out")
    assert len(first) == 3 and sorted(s for _, s, _ in first) == ["ingested", "ingested", "skipped"] and ("b", "ingested", True) in first
    put(source, d="two", e="three", f="three")
    run(10)
    second = outcomes(spark, tmp_path / "out")
    assert len(second) == 6 and {("d", "skipped", True), ("e", "ingested", True), ("f", "skipped", True)} <= set(second)
    run(10)  # nothing is new
    assert outcomes(spark, tmp_path / "out") == second
    index = {r["sha256"]: (r["asset_dir"], r["processed"]) for r in stateful.index_of(spark.read.parquet(str(tmp_path / "out"))).collect()}
    hashes = {r[0] for r in spark.createDataFrame([("one",), ("two",), ("three",)], "t string").select(F.sha2("t", 256)).collect()}
    assert index == {h: (h[:12], True) for h in hashes}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != stateful.PROVIDER


def test_half_done_work_is_resumed(spark, tmp_path):
    source, done = tmp_path / "in", tmp_path / "done"
    source.mkdir()
    done.mkdir()
    folder = str(done)

    def process(sha256, path):
        """Complete at the second try."""
        import os

        mark = os.path.join(folder, sha256)
        if os.path.exists(mark):
            return sha256[:12], True
        open(mark, "w").close()
        return sha256[:12], False

    def run(retry=None):
        stateful.run(ingest.files(spark, str(source), 10), str(tmp_path / "out"), str(tmp_path / "check"), process, retry).awaitTermination()

    put(source, a="one", b="two")
    run()
    assert outcomes(spark, tmp_path / "out") == [("a", "ingested", False), ("b", "ingested", False)]
    put(source, c="one")
    run()
    assert ("c", "resumed", True) in outcomes(spark, tmp_path / "out")
    put(source, d="one", e="two", f="two")
    run()
    got = outcomes(spark, tmp_path / "out")
    assert {("d", "skipped", True), ("e", "resumed", True), ("f", "skipped", True)} <= set(got) and len(got) == 6


def test_a_timer_resumes_work(spark, tmp_path):
    source, done = tmp_path / "in", tmp_path / "done"
    source.mkdir()
    done.mkdir()
    folder = str(done)

    def process(sha256, path):
        import os

        mark = os.path.join(folder, sha256)
        first = not os.path.exists(mark)
        open(mark, "w").close()
        return sha256[:12], not first

    put(source, a="one")
    for name in "xy":
        stateful.run(ingest.files(spark, str(source), 10), str(tmp_path / "out"), str(tmp_path / "check"), process, 0).awaitTermination()
        put(source, **{name: name})
    stateful.run(ingest.files(spark, str(source), 10), str(tmp_path / "out"), str(tmp_path / "check"), process, 0).awaitTermination()
    got = outcomes(spark, tmp_path / "out")
    assert ("a", "ingested", False) in got and ("a", "resumed", True) in got
