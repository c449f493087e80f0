"""Structure, chunking, graphs, evidence, evaluation, ingest and model calls on small tables."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking, evals, evidence, graph, ingest, models, report, structure, transcripts
from folioscope.sources.html import markdown_of

BOOK = "intro\n# Book\nby me\n## One\na\n### Deep\nb\n## Two\nc"


def parsed(spark, text):
    lines = structure.document_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    heads = structure.headings(lines)
    return lines, heads, structure.chapter_levels(heads)


def test_headings_and_chapter_level(spark):
    _, heads, levels = parsed(spark, BOOK)
    assert [tuple(r)[1:] for r in heads.orderBy("line").collect()] == [(1, 1, "Book"), (3, 2, "One"), (5, 3, "Deep"), (7, 2, "Two")]
    assert levels.first()["chapter_level"] == 2
    assert parsed(spark, "# A\n# B\n## C")[2].first()["chapter_level"] == 1
    assert spark.range(1).select(structure.listed_levels(F.lit("- a (H1, line 1)\n- b (h2, LINE 7)\nx")).alias("x")).first()["x"] == [1, 2]


def test_sections_and_chapters(spark):
    lines, heads, levels = parsed(spark, BOOK)
    sections = structure.fact_sections(lines, heads, levels).orderBy("section_index").collect()
    assert [r["title"] for r in sections] == ["Document Preamble", "Book > One", "Book > Two"]
    assert sections[0]["text"] == "intro\n# Book\nby me" and sections[2]["text"] == "## Two\nc"
    found = structure.chapters(lines, heads, levels).orderBy("segment").collect()
    assert [(r["title"], [tuple(p) for p in r["parents"]]) for r in found] == [("One", [(1, "Book")]), ("Two", [(1, "Book")])]
    whole = structure.fact_sections(*parsed(spark, "just text")).collect()
    assert [r["title"] for r in whole] == ["Full document"]


def test_two_kinds_of_title_path(spark):
    _, heads, _ = parsed(spark, "# A\n## B\n# C\n### D")
    assert structure.earlier_shallower(heads).where("title = 'D'").first()["title_path"] == "A > B > C > D"
    assert structure.open_parents(heads).where("title = 'D'").first()["parents"] == [(1, "C")]


def test_chapter_files(spark):
    lines, heads, levels = parsed(spark, BOOK)
    parts = structure.chapters(lines, heads, levels).select("doc_id", "segment", "title", "parents", "text").withColumn("parts", F.when(F.col("segment") == 1, 2).otherwise(1)).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    found = structure.chapter_files(parts, F.lit("book.md")).orderBy("filename").collect()
    assert [r["filename"] for r in found] == ["001_one_part_1.md", "002_one_part_2.md", "003_two.md"]
    assert found[2]["content"] == "[Back to full document](../book.md)\n\n# Book\n\n## Two\nc\n"


def test_paragraphs_keep_fences():
    assert chunking.paragraphs_of("a\n\n```py\nx\n\ny\n```\n\nb\nc\n \n") == ["a", "```py\nx\n\ny\n```", "b\nc"]
    assert chunking.paragraphs_of("````\n```\n\n```\n````\n\nz") == ["````\n```\n\n```\n````", "z"]
    assert chunking.paragraphs_of("```\na\n```info\n\nb\n```") == ["```\na\n```info\n\nb\n```"]
    assert chunking.paragraphs_of("") == []


def test_small_paragraphs(spark):
    merge = lambda *sizes: [len(x) for x in spark.range(1).select(chunking.merge_small(F.array(*[F.lit("x" * n) for n in sizes])).alias("m")).first()["m"]]
    assert merge(5, 10, 250) == [269] and merge(250, 30) == [282] and merge(3) == [3] and merge(200, 200) == [200, 200]


def test_cuts_and_tails():
    assert chunking.cuts_of([60, 60, 60], [0.1, 0.9], 50, 150) == [1]
    assert chunking.cuts_of([200, 200], [1.0], 50, 150) == [1]
    assert chunking.cuts_of([100] * 5, [0.5, 0.5, 0.5, 0.5], 200, 250) == [2, 4]
    assert chunking.cuts_of([10], [], 50, 150) == [] == chunking.cuts_of([], [], 1, 2)
    assert [len(c) for c in chunking.chunk_runs(["x" * 360, "y" * 80], [1], 50, 100)] == [442]
    assert [len(c) for c in chunking.chunk_runs(["x" * 460, "y" * 80], [1], 50, 100)] == [460, 80]


def test_packing(spark):
    pack = lambda sizes, most, items=1 << 30: spark.range(1).select(chunking.pack(F.array(*map(F.lit, sizes)), most, items).alias("p")).first()["p"]
    assert pack([4, 4, 4, 4], 10) == [0, 0, 1, 1] and pack([11, 1], 10) == [0, 1]
    full = pack([1] * 100, 10**6, 96)
    assert full.count(0) == 96 and full.count(1) == 4


def test_semantic_chunks(spark):
    docs = spark.createDataFrame([("d", "\n\n".join(["alpha " * 60, "beta " * 70, "beta " * 70])), ("e", "short")], "doc_id string, text string")
    found = chunking.semantic_chunks(docs, lambda texts: [[1.0, 0.0] if "alpha" in t else [0.0, 1.0] for t in texts], 50, 200)
    rows = sorted((r["doc_id"], r["chunk"], r["text"][:5]) for r in found.collect())
    assert rows == [("d", 1, "alpha"), ("d", 2, "beta "), ("e", 1, "short")]


def trap(spark):
    chain = [("s1", "e1"), ("e1", "c1"), ("sX", "eX"), ("eX", "cX"), ("s3", "e3"), ("e3", "c3"), ("c1", "cX"), ("cX", "c3")]
    edges = spark.createDataFrame([("d", i, a, b) for i, (a, b) in enumerate(chain)], "doc_id string, pos bigint, source string, target string")
    items = lambda *ids: spark.createDataFrame([("d", x, i) for i, x in enumerate(ids)], "doc_id string, id string, turn int")
    return edges, items


def test_closure_depends_on_order_if_exact(spark):
    edges, items = trap(spark)
    ids = lambda df: {r["id"] for r in df.collect()}
    everything = {"s1", "e1", "c1", "sX", "eX", "cX", "s3", "e3", "c3"}
    assert ids(graph.closure_exact(edges, items("c1", "c3"))) == everything - {"eX", "sX"}
    assert ids(graph.closure_exact(edges, items("c3", "c1"))) == everything
    assert ids(graph.closure(edges, items("c1", "c3"))) == everything


def built(spark):
    sources = spark.createDataFrame([("d", "document:d", "d", "document", "Doc", "d.md", {"k": "v"})], "doc_id string, id string, key string, type string, label string, source_path string, metadata map<string,string>")
    sections = spark.createDataFrame([("d", 1, "Intro", "first text"), ("d", 2, "More", "second text"), ("d", 3, "Empty", "x")], "doc_id string, section_index int, title string, text string")
    items = spark.createDataFrame([("d", 1, "claim", 1, "Sun is hot", "", "the sun is hot"), ("d", 2, "claim", 1, "Sun is hot", "", "hot sun"), ("d", 2, "concept", 1, "Star", "a burning ball", "stars burn"), ("d", 1, "key_passage", 1, "it burns", "", "matters")], "doc_id string, section_index int, kind string, item_index int, name string, body string, evidence string")
    near = spark.createDataFrame([("d", "Sun is hot", "the sun is hot", 0.9)], "doc_id string, left string, right string, cosine double")
    return graph.build(sources, sections, items, near)


def test_claim_graph(spark):
    nodes, edges = built(spark)
    rows = {r["id"]: r for r in nodes.collect()}
    assert set(rows) == {"document:d", "section:d:1", "section:d:2", "section:d:3", "evidence:d:1:1", "evidence:d:2:1", "claim:d:sun-is-hot:1", "claim:d:sun-is-hot:2", "concept:d:star:1", "key_passage:d:1:1"}
    assert rows["section:d:3"]["score"] == 0 and rows["section:d:1"]["score"] == max(rows[i]["score"] for i in ("claim:d:sun-is-hot:1", "key_passage:d:1:1"))
    assert rows["claim:d:sun-is-hot:1"]["metadata"] == {"k": "v", "section": "Intro", "evidence_id": "evidence:d:1:1"}
    assert [r["type"] for r in nodes.orderBy("pos").collect()][:4] == ["document", "section", "evidence", "claim"]
    kinds = {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()}
    assert kinds == {"contains": 5, "supports": 2, "defines": 1, "highlights": 1}
    vectors = spark.createDataFrame([("d", "Sun is hot", [1.0, 0.0])], "doc_id string, text string, vector array<double>")
    full = graph.add_similar(nodes, edges, vectors, 0.8)
    assert full.where("type = 'similar_to'").first()["weight"] == 1.0
    back = graph.from_json(graph.to_json(nodes, full))
    assert back[0].count() == nodes.count() and back[1].count() == full.count()
    kept, links = graph.select_subgraph(nodes, full, 1)
    assert {"claim:d:sun-is-hot:1", "evidence:d:1:1", "section:d:1", "document:d"} <= {r["id"] for r in kept.collect()} and links.count() >= 3
    assert "## Claims" in graph.render_markdown(nodes, full).first()["markdown"]
    assert graph.graph_counts(nodes, full).first()["similar"] == 1


def test_selection_covers_sections_first(spark):
    nodes = spark.createDataFrame([("d", f"c{i}", "claim", s, float(v)) for i, (s, v) in enumerate([(1, 9), (1, 8), (2, 1), (None, 7), (3, 2)])], "doc_id string, id string, type string, section_index int, score double")
    order = lambda n: [r["id"] for r in graph.ranked_items(nodes, "claim", n).orderBy("rank").collect()]
    assert order(2) == ["c0", "c2"] and order(4) == ["c0", "c2", "c4", "c1"] and order(9) == ["c0", "c2", "c4", "c1", "c3"] and order(0) == []
    assert graph.item_limit(None, 5) == 2 and graph.item_limit(None, 1) == 1 and graph.item_limit(0, 9) == 0
    with pytest.raises(ValueError, match="negative"):
        graph.item_limit(-1, 3)


def test_merged_chunks(spark):
    nodes, edges = built(spark)
    chunk = lambda df: df.withColumn("chunk", F.lit(1))
    as_chunk = chunk(nodes).withColumn("type", F.when(F.col("type") == "document", "chunk").otherwise(F.col("type")))
    root = nodes.where("type = 'document'").withColumn("id", F.lit("document:whole"))
    all_nodes, all_edges = graph.merge_chunks(root, as_chunk, chunk(edges))
    assert all_nodes.orderBy("pos").first()["id"] == "document:whole" and all_nodes.count() == nodes.count() + 1
    assert all_edges.orderBy("pos").first()["target"] == "document:d"
    with pytest.raises(Exception, match="duplicate node id"):
        graph.merge_chunks(root, as_chunk.unionByName(as_chunk.where("type = 'claim'")), chunk(edges))[0].collect()


def test_evidence(spark):
    nodes, edges = built(spark)
    docs = spark.createDataFrame([("d", "doc", "the sun is hot and it burns")], "doc_id string, name string, text string")
    chunks = spark.createDataFrame([("d", 1, "c1", "hot sun")], "doc_id string, chunk int, name string, text string")
    blocks = evidence.source_blocks(docs, chunks)
    assert blocks.count() == 2
    records = {r["node_id"]: r for r in evidence.evidence_records(nodes, blocks, edges).collect()}
    assert len(records) == 6 and records["claim:d:sun-is-hot:1"]["text"] == "the sun is hot" and records["claim:d:sun-is-hot:1"]["exact"] and not records["concept:d:star:1"]["exact"]
    plan = evidence.summary_plan(evidence.evidence_records(nodes, blocks, edges)).collect()
    assert {r["section_path"]: (r["records"], r["words"]) for r in plan} == {"Intro": (3, 135), "More": (3, 135)}
    claims = spark.createDataFrame([("d", "x"), ("d", "y")], "doc_id string, claim string")
    ids = [r["evidence_ids"] for r in evidence.claim_rows(claims, evidence.evidence_records(nodes, blocks, edges)).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 3
    spans = evidence.exact_spans(spark.createDataFrame([(1, "is hot and it burns"), (2, "sun"), (3, "moon")], "item_id bigint, text string"), docs)
    assert sorted(r["item_id"] for r in spans.collect()) == [1, 2]


def test_runs_and_gate(spark):
    shape = "doc_name string, pos int, blended double, error string"
    old = spark.createDataFrame([("a", 0, 0.6, None), ("b", 1, 0.0, "failed"), ("c", 2, 0.5, None)], shape)
    new = spark.createDataFrame([("a", 0, 0.7, None), ("b", 1, 0.9, None), ("c", 2, 0.0, "failed")], shape)
    assert [(r["doc_name"], round(r["delta"], 9)) for r in evals.paired_deltas(old, new).collect()] == [("a", 0.1)]
    means = lambda rows: evals.mean_blended(spark.createDataFrame(rows, shape).withColumn("run", F.lit(1)), ["run"]).first()["mean_blended"]
    assert means([("a", 0, 0.8, None), ("b", 1, 0.0, "x")]) == 0.8 and means([("b", 1, 0.0, "x")]) == 0.0
    gate = lambda *d: evals.gate(spark.createDataFrame([(1, x) for x in d], "run int, delta double"), ["run"]).first()["promoted"]
    assert gate(0.02) and not gate(0.0199) and not gate(0.5, 0.5, -0.1, -0.1) and gate(0.1, 0.0, -0.01)
    assert evals.worst_document(old.withColumn("run", F.lit(1)), ["run"]).first()["doc_name"] == "c"
    assert "| a |" in report.delta_table(evals.paired_deltas(old, new))


def test_judges_and_outlines(spark):
    cases = spark.createDataFrame([("coverage", True, True), ("coverage", True, False), ("support", False, False)], "kind string, expected boolean, actual boolean")
    assert {r["kind"]: (r["correct"], r["total"]) for r in evals.judge_accuracy(cases).collect()} == {"coverage": (1, 2), "support": (1, 1), None: (2, 3)}
    outline = lambda rows: evals.outline_accuracy(spark.createDataFrame(rows, "g int, expected int, predicted int"), ["g"]).first()
    assert tuple(outline([(1, 2, 2), (1, None, 1)]))[1:] == (2, 1, 1, 1, 1.0) and outline([(1, None, 1)])["accuracy"] is None


def test_samples_and_sets(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "n int")
    ranks = lambda k: sorted(r["n"] for r in evals.quantile_sample(rows, ["n"], k).collect())
    assert ranks(3) == [0, 4, 9] and ranks(1) == [4]
    merged = spark.range(1).select(evals.overrides(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first()["m"]
    assert merged == {"a": 1, "b": 3}
    assert [r["n"] for r in evals.missing_names(spark.createDataFrame([(3,), (99,)], "n int"), rows, "n").collect()] == [99]
    with pytest.raises(Exception, match="lengths differ"):
        spark.range(1).select(evals.zip_strict(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)), "facts")).collect()
    facts = spark.createDataFrame([(1, 0, " A  b"), (1, 1, "a B"), (1, 2, ""), (1, 3, "c")], "g int, pos int, fact string")
    assert sorted(r["pos"] for r in evals.distinct_facts(facts, ["g"], "fact", ["pos"]).collect()) == [0, 3]


def test_ingest_plan(spark):
    assets = spark.createDataFrame([("a1", '{"source_sha256": "x"}', 0), ("a2", '{"source_sha256": "x"}', 3), ("a3", '{"source_sha256": "y"}', 0), (".h", '{"source_sha256": "z"}', 1), ("a4", "not json", 1), ("a5", "{}", 1)], "asset_dir string, metadata string, chunks int")
    index = ingest.asset_index(assets)
    assert {(r["sha256"], r["asset_dir"], r["processed"]) for r in index.collect()} == {("x", "a2", True), ("y", "a3", False)}
    sources = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", "z"), ("p4", "z")], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in ingest.plan(sources, index).collect()} == {"p1": "skipped", "p2": "resumed", "p3": "ingested", "p4": "skipped"}


def test_transcripts(spark):
    part = "recording int, offset double, text string, language string, duration double, segments array<struct<start:double,end:double,speaker:string,text:string>>"
    rows = [(1, o, "t", "en" if o else None, 5.0, [(1.0, 2.0, None, "t")]) for o in (120.0, 0.0, 60.0)]
    merged = transcripts.merge(spark.createDataFrame(rows, part)).first()
    assert merged["duration"] == 125.0 and merged["language"] == "en" and merged["text"] == "t t t"
    assert [(s["start"], s["end"]) for s in merged["segments"]] == [(1.0, 2.0), (61.0, 62.0), (121.0, 122.0)]
    windows = spark.range(1).select(chunking.audio_windows(F.lit(125.0), 60).alias("w")).first()["w"]
    assert [tuple(w) for w in windows] == [(0.0, 60.0), (60.0, 60.0), (120.0, 5.0)]


def test_model_calls(spark):
    rows = spark.createDataFrame([("d", 1, "ask A"), ("d", 2, "ask B")], "doc_id string, pos int, text string")
    done = {r["pos"]: r for r in models.complete(rows, F.col("text"), models.RoutedCompleter((("A", "yes"), ("B", " ")))).collect()}
    assert done[1]["result"] == "yes" and done[1]["error"] is None and done[2]["error"] == "blank answer"
    found = models.embed(rows, "doc_id", "pos", "text", models.TermEmbedder()).orderBy("pos").collect()
    assert found[0]["vector"] == [1.0, 1.0, 0.0] and found[1]["vector"] == [0.0, 1.0, 1.0]
    long = spark.createDataFrame([("d", "word " * 400)], "doc_id string, text string")
    assert len(models.compress(long, models.HalvingCompleter(), 100).first()["text"]) // 4 <= 100
    summary = models.map_reduce_summaries(spark.createDataFrame([("d", 1, "one"), ("d", 2, "two")], "doc_id string, chunk int, text string"), "{{text}}", "merge\n{{text}}", models.RoutedCompleter((("merge", "whole"),)), 1000)
    assert summary.first()["summary"] == "whole"
    facts = spark.createDataFrame([("d", 1, "t", "x"), ("d", 2, "u", "y")], "doc_id string, section_index int, title string, text string")
    got = models.section_facts(facts, "{{title}}: {{text}}", models.RoutedCompleter((("x", '{"facts": ["One", "two"]}'), ("y", '{"facts": ["one"]}'))))
    assert sorted(r["fact"] for r in got.collect()) == ["One", "two"]
    judged = models.judge(spark.createDataFrame([("d", 1, "f")], "doc_id string, pos int, item string"), spark.createDataFrame([("d", "s")], "doc_id string, text string"), "{{items}} {{text}}", "covered", models.RoutedCompleter((("1. f", '{"verdicts": [{"covered": true, "evidence": "e"}]}'),)))
    assert judged.first()["good"] is True
    named = models.name_assets(spark.createDataFrame([("d", "text")], "doc_id string, text string"), "{{text}}", models.RoutedCompleter((("text", '{"title": "My Book", "authors": ["Ann"]}'),)))
    assert named.first()["name"] == "my_book_ann"
    assert models.Settings.of(spark).max_claims == 48


def test_improvement_stops_after_failures(spark):
    shape = "doc_name string, pos int, blended double, error string"
    score = lambda v: spark.createDataFrame([("a", 0, v, None)], shape)
    values = {"v2": 0.7, "v3": 0.6, "v4": 0.5, "v5": 0.99}
    turn = iter(values)
    out = models.improve(score(0.5), lambda v: score(values[v]), lambda best, scores: next(turn), "v1", 5)
    assert [(i.version, i.promoted) for i in out] == [("v2", True), ("v3", False), ("v4", False)]


def test_html():
    page = "<html><style>x</style><h1>Top &amp; more</h1><p>one<br>two  three<ul><li>a<li>b</ul><script>no</script></p><div>end"
    assert markdown_of(page) == "# Top & more\n\none\ntwo three\n\n- a\n\n- b\n\nend"
    assert markdown_of("") == ""


def closure_in_turns(edges, order):
    """What a selection takes with it, item by item."""
    into, out = {}, {}
    for source, target in edges:
        into.setdefault(target, []).append(source)
        out.setdefault(source, []).append(target)
    found = set(order)
    for item in order:
        stack = list(into.get(item, ()))
        while stack:
            above = stack.pop()
            if above not in found:
                found.add(above)
                stack += into.get(above, ())
        found.update(out.get(item, ()))
    return found


def test_closure_of_random_graphs_in_turns(spark):
    import random

    rng = random.Random(5)
    graphs = {f"d{g}": [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] for g, (n, m) in enumerate([(5, 9), (12, 20), (30, 45), (60, 80), (60, 200), (40, 39), (200, 260)] * 3)}
    orders = {d: rng.sample([f"n{i}" for i in range(60)], rng.randint(1, 9)) for d in graphs}
    edges = spark.createDataFrame([(d, i, a, b) for d, g in graphs.items() for i, (a, b) in enumerate(g)], "doc_id string, pos int, source string, target string")
    items = spark.createDataFrame([(d, x, i) for d, o in orders.items() for i, x in enumerate(o)], "doc_id string, id string, turn int")
    got = {(r["doc_id"], r["id"]) for r in graph.closure_exact(edges, items).collect()}
    assert got == {(d, x) for d in graphs for x in closure_in_turns(graphs[d], orders[d])}


def test_small_and_large_graphs_have_the_same_closure(spark):
    """Graphs walked in a task, by rounds, and some of each; null ends of edges and null documents too."""
    import random

    rng = random.Random(12)
    graphs = {f"d{i}": [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(rng.randint(1, 50))] for i in range(30)}
    rows = [(d, a, b) for d, g in graphs.items() for a, b in g] + [("d0", None, "n1"), ("d0", "n1", None), (None, "n2", "n1"), ("d1", None, None)]
    edges = spark.createDataFrame(rows, "doc_id string, source string, target string")
    items = spark.createDataFrame([(d, f"n{x}", i) for d in [*graphs, "alone", None] for i, x in enumerate(rng.sample(range(30), 4))] + [("d2", None, 1), ("d0", "n1", 0)], "doc_id string, id string, turn int")
    found = [sorted(map(tuple, graph.closure_exact(edges, items, few).collect()), key=str) for few in (0, 20, 4096)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 150
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walked", "few jobs")
    graph.closure_exact(edges.where("doc_id IS NOT NULL"), items).count()
    assert len(jobs.getJobIdsForGroup("walked")) < 16
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_closure_of_one_large_graph(spark):
    """A tree of 300,000 edges under one document, of which one leaf in a thousand is selected."""
    n = 300_000
    edges = spark.range(1, n).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), F.floor((F.col("id") - 1) / 8).cast("string").alias("source"), F.col("id").cast("string").alias("target"))
    items = spark.range(n - n // 8, n, 1000).select(F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("id"), F.col("id").alias("turn"))
    want = set()
    for i in range(n - n // 8, n, 1000):
        while str(i) not in want:
            want.add(str(i))
            i = (i - 1) // 8 if i else 0
    assert {r["id"] for r in graph.closure_exact(edges, items).collect()} == want


def test_closure_has_no_limit_of_depth(spark):
    edges = spark.createDataFrame([("d", f"n{i + 1}", f"n{i}") for i in range(36)], "doc_id string, source string, target string")
    items = spark.createDataFrame([("d", "n0")], "doc_id string, id string")
    assert {r["id"] for r in graph.closure(edges, items).collect()} == {f"n{i}" for i in range(37)}


def test_similar_pairs_of_clusters_are_all_found_with_few_comparisons(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    n, dim = 6000, 24
    centres = rng.standard_normal((60, dim))
    v = centres[rng.integers(0, 60, n)] + 0.15 * rng.standard_normal((n, dim))
    v[5], v[6] = 0, v[7]
    label = np.where(np.arange(n) < 5500, "a", "b")
    df = spark.createDataFrame([(l, i, x.tolist()) for i, (l, x) in enumerate(zip(label.tolist(), v, strict=True))], "label string, at bigint, v array<double>").repartition(4)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    want = {(l, int(i), int(j)) for l in "ab" for own in [np.flatnonzero(label == l)] for i, j in zip(*np.nonzero(np.triu(u[own] @ u[own].T >= 0.97, 1)), strict=True) for i, j in [(own[i], own[j])]}
    for block in (64, 512):
        got = {(r["label"], r["left"], r["right"]) for r in graph.similar_pairs(df, ["label"], "at", "v", 0.97, block).collect()}
        assert got == want
    ready = df.select(F.col("label").alias("g0"), F.col("at").alias("p"), "v")
    assert graph.compared(graph.cell_units(graph.cells_of(ready, ["g0"], 0.97, 64), ["g0"], 64), ["g0"]) < 0.15 * (5500**2 + 500**2) / 2


def test_section_lengths_of_one_long_document(spark):
    """Every heading looks at those behind it; the frame must not be added up anew for each."""
    n, levels = 4000, [1 + (i * 7 + i // 11) % 6 for i in range(4000)]
    heads = spark.createDataFrame([("a", 2 * i, v, "t") for i, v in enumerate(levels)], "doc_id string, line bigint, level int, title string")
    sized = structure.section_lengths(heads, spark.createDataFrame([("a", 2 * n)], "doc_id string, total_lines bigint"))
    want, following = {}, dict.fromkeys(range(1, 7), n)
    for i in reversed(range(n)):
        want[2 * i] = 2 * (following[levels[i]] - i)
        following |= dict.fromkeys(range(levels[i], 7), i)
    assert {r["line"]: r["line_count"] for r in sized.collect()} == want
    assert "unboundedfollowing" not in sized._jdf.queryExecution().executedPlan().toString().lower()


def test_vectors_are_written_once_for_all_cells_that_they_visit(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(3).standard_normal((600, 16))
    ready = spark.createDataFrame([("a" if i < 590 else "b", i, x) for i, x in enumerate(v.tolist())], "g0 string, p bigint, v array<double>")
    own, written = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(own(df)) or written[-1])
    cells = graph.cells_of(ready, ["g0"], 0.25, 64)
    assert graph.cell_units(cells, ["g0"], 64).count() > 4 * 600
    assert [t.count() for t in written] == [600]
    assert cells.where("NOT visits").count() == 600 and cells.where("visits").count() > 600
