"""Queries of outline corpora, asset folders, graph trees, extraction and evaluation drivers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.lineage import shared_folder
from folioscope.operators import evaluation, models
from folioscope.operators.models import RoutedCompleter
from folioscope.plans.catalogue import query
from folioscope.plans.text_queries import table
from folioscope.sources import assets, outlines
from folioscope.sources.store import ContentStore, through

_TOC = "- A (H2, line 1, 2 lines)\n- B (H2, line 3, 2 lines)\n"
_VERDICTS = '{"verdicts": [{"%s": true, "evidence": "e"}, {"%s": %s, "evidence": "e"}]}'
_PROMPTS = evaluation.Prompts("FACTS {{title}} {{text}}", "COVER {{text}} {{items}}", "CLAIMS {{summary}}", "SUPPORT {{text}} {{items}}", "RUBRIC {{summary}}")


@query("outline_annotations", """
SELECT doc_id, 'H2' AS predicted, CASE doc_id % 4 WHEN 1 THEN 'H2' WHEN 2 THEN 'H3' END AS expected, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'correct' WHEN 2 THEN 'incorrect' END AS status, CASE WHEN doc_id % 4 = 3 THEN 'the input is changed' END AS problem FROM documents
""")
def outline_annotations(spark, sf_dir):
    given = F.concat(F.lit(_TOC), F.coalesce("text", F.lit(""))).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", given.alias("input"))
    level = lambda h: F.replace(outlines.pending(F.col("input")).cast("string"), F.lit("chapter:\n  level: TODO"), F.lit(f"chapter:\n  level: {h}"))
    turn = F.col("doc_id") % 4
    output = F.when(turn == 0, outlines.pending(F.col("input"))).when(turn == 1, level("H2").cast("binary")).when(turn == 2, level("H3").cast("binary")).otherwise(F.concat(F.col("input"), F.lit(b"x")))
    return outlines.evaluate(rows.select(F.col("doc_id").alias("id"), "input", output.alias("output"))).withColumnRenamed("id", "doc_id")


@query("outline_corpus", """
WITH c AS (SELECT source || '/' || lang || '/' || doc_id || '/headers.md' AS source, CAST(doc_id % 7 + 1 AS BIGINT) AS entry_count, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, CAST(strlen(text) AS BIGINT) AS size_bytes FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY entry_count, size_bytes, source) - 1 AS rank, count(*) OVER () AS n FROM s)
SELECT rtrim(left(coalesce(nullif(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'outline'), 48), '-') || '-' || left(sha256(source), 12) || '-' || left(sha256(text), 12) AS id, source, sha256(text) AS sha256, entry_count, size_bytes
FROM r WHERE rank IN (SELECT i * (n - 1) // 24 FROM range(25) t(i))
""")
def outline_corpus(spark, sf_dir):
    source = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"), F.lit("headers.md"))
    found = table(spark, sf_dir, "documents").select(source.alias("source"), (F.col("doc_id") % 7 + 1).alias("entry_count"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return outlines.corpus(found, 25).select("id", "source", "sha256", "entry_count", "size_bytes")


@query("override_arguments", """
WITH d AS (SELECT doc_id, coalesce(lang, 'other') AS lang, coalesce(source, 'none') AS source FROM documents)
SELECT doc_id, CAST(doc_id AS VARCHAR) AS value, CASE WHEN lang = 'other' THEN 'src' ELSE lang || ',src' END AS unknown, regexp_full_match(source || '-' || doc_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS safe FROM d
""")
def override_arguments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("other")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    given = F.array(F.concat("lang", F.lit("=1")), F.concat(F.lit("src="), "source"), F.concat("lang", F.lit("="), F.col("doc_id").cast("string")))
    read = docs.withColumn("m", outlines.prompt_overrides(given))
    return read.select("doc_id", F.col("m")[F.col("lang")].alias("value"), F.array_join(outlines.unknown_names(F.col("m"), F.array(F.lit("other"))), ",").alias("unknown"), outlines.is_run_id(F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias("safe"))


@query("asset_files", """
WITH d AS (SELECT *, 'doc_' || doc_id AS name, coalesce(text, '') AS body FROM documents)
SELECT name AS asset_dir, name || '.md' AS filename, sha256(body) AS sha256 FROM d
UNION ALL SELECT name, 'headers.md', sha256('- ' || name) FROM d
UNION ALL SELECT name, 'metadata.json', sha256('{"title":"' || name || '","authors":["A","B"],"source_sha256":"' || sha256(body) || '"}') FROM d
UNION ALL SELECT name, 'canonical_name.txt', sha256(name || chr(10)) FROM d
UNION ALL SELECT name, name || '.PDF', sha256(body) FROM d WHERE doc_id % 2 = 0
""")
def asset_files(spark, sf_dir):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    body = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".md")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/v/"), name, kind).alias("path"), body.cast("binary").alias("content"), body.alias("markdown"), F.concat(F.lit("- "), name).alias("toc"), name.alias("title"), F.array(F.lit("A"), F.lit("B")).alias("authors"), name.alias("name"))
    return assets.asset_files(docs).select("asset_dir", "filename", F.sha2("content", 256).alias("sha256"))


@query("asset_outcomes", """
WITH s AS (SELECT '/v/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(coalesce(text, '')) AS asset_dir, doc_id FROM documents)
SELECT path, asset_dir, CASE WHEN path <> min(path) OVER (PARTITION BY asset_dir) OR bool_or(doc_id % 5 = 0) OVER (PARTITION BY asset_dir) THEN 'exists' ELSE 'written' END AS status FROM s
""")
def asset_outcomes(spark, sf_dir):
    path = F.concat(F.lit("/v/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    sources = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("asset_dir"))
    return assets.asset_outcomes(sources, sources.where("doc_id % 5 = 0"))


@query("archive_plan", """
SELECT 'd' || doc_id AS asset_dir, 'summary.md' AS name, 'd' || doc_id || '/_summary_runs/20260101T000000Z' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-2' ELSE '-3' END || '/summary.md' AS target FROM documents
""")
def archive_plan(spark, sf_dir):
    folders = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("asset_dir"))
    stamp = "20260101T000000Z"
    found = folders.select("asset_dir", F.explode(F.array(F.lit("summary.md"), F.lit("headers.md"))).alias("name"))
    runs = F.slice(F.array(F.lit(stamp), F.lit(f"{stamp}-2")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return assets.archive_plan(found, folders.select("asset_dir", F.explode(runs).alias("run")), F.lit(stamp))


@query("reused_results", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'made' ELSE 'kept ' || quality END AS result FROM documents LEFT JOIN labels USING (doc_id)")
def reused_results(spark, sf_dir):
    there = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("kept "), F.col("quality").cast("string")).alias("result"))
    return assets.reuse(table(spark, sf_dir, "documents").select("doc_id"), there, "doc_id", lambda rows: rows.withColumn("result", F.lit("made")))


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), F.col("conv_id").cast("string").alias("document"), F.lpad(F.col("turn").cast("string"), 5, "0").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))


@query("graph_trees", r"""
WITH c AS (SELECT conv_id, lpad(CAST(turn AS VARCHAR), 5, '0') AS chunk, turn, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS body FROM conversations),
p AS (SELECT conv_id, chunk, '## ' || chunk || chr(10) || chr(10) || '- Graph JSON: `/g/' || conv_id || '/chunks/' || chunk || '/graph.json`' || chr(10) || '- Selected subgraph JSON: `/g/' || conv_id || '/chunks/' || chunk || '/selected_subgraph.json`' || chr(10) || '- Selected subgraph Markdown: `/g/' || conv_id || '/chunks/' || chunk || '/selected_subgraph.md`' || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || body ELSE '' END AS part FROM c)
SELECT CAST(conv_id AS VARCHAR) AS document, '# Chunk Graphs' || chr(10) || chr(10) || regexp_replace(string_agg(part, chr(10) || chr(10) ORDER BY chunk), '\s+$', '') || chr(10) AS index FROM p GROUP BY conv_id
""")
def graph_trees(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    graphs = chunks.select("doc_id", F.lit("{}").alias("graph"))
    made = assets.graph_files(graphs, graphs, chunks.where("turn % 2 = 0").select("doc_id", F.col("text").alias("markdown")), chunks.select("doc_id", "document", "chunk"))
    return assets.graph_index(chunks.select("document"), made, F.concat_ws("/", F.lit("/g"), "document"))


@query("cached_graphs", """
SELECT conv_id || '/' || turn AS doc_id, turn % 3 = 0 AS hit FROM conversations
""")
def cached_graphs(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("doc_id", "turn", F.sha2("doc_id", 256).alias("key"))
    whole = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("id"), F.lit("claim").alias("type"))).alias("nodes"), F.array().cast("array<struct<source:string,target:string>>").alias("edges")))
    cache = chunks.where("turn % 3 < 2").select("key", F.when(F.col("turn") % 3 == 0, whole).otherwise(F.substring(whole, 1, 9)).alias("graph"))
    hits, misses = assets.cached_graphs(chunks.select("doc_id", "key"), cache)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


_ITEMS = '{"claims": [{"claim": "c", "evidence": " e "}], "concepts": [{"concept": "n", "definition": "d", "evidence": "e"}]}'


@query("section_items", """
WITH s AS (SELECT conv_id, turn, role FROM conversations)
SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS section_index, 'claim' AS kind, 'c' AS name, '' AS body, 'e' AS evidence, CAST(NULL AS VARCHAR) AS error FROM s WHERE role = 'user'
UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 'concept', 'n', 'd', 'e', NULL FROM s WHERE role = 'user'
UNION ALL SELECT conv_id, CAST(turn AS INTEGER), NULL, NULL, NULL, NULL, 'claims, concepts or passages don''t fit' FROM s WHERE role IS DISTINCT FROM 'user'
""")
def section_items(spark, sf_dir):
    role = F.concat(F.lit("<<"), F.coalesce("role", F.lit("")), F.lit(">>"))
    sections = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("section_index"), role.alias("title"), F.coalesce("text", F.lit("")).alias("text"), role.alias("_"))
    keyed = sections.withColumn("text", F.concat("_", "text")).drop("_")
    answers = RoutedCompleter((("<<user>>", _ITEMS), ("<<", '{"claims": [{"claim": "c"}]}')))
    items, errors = evaluation.section_items(keyed, "{{section_title}} {{section_text}} {{max_claims}}", answers)
    none = [F.lit(None).cast("string").alias(c) for c in ("kind", "name", "body", "evidence")]
    return items.select("doc_id", "section_index", "kind", "name", "body", "evidence", F.lit(None).cast("string").alias("error")).unionByName(errors.select("doc_id", "section_index", *none, "error"))


@query("scored_documents", r"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '\s', '', 'g') <> '' THEN coalesce(lang, '') END AS lang FROM documents),
r AS (SELECT *, CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 1 ELSE 0 END::DOUBLE AS coverage, coalesce(lang IN ('en', 'fr'), false)::INTEGER::DOUBLE AS fine FROM d)
SELECT doc_id, coverage, fine AS faithfulness, fine * 0.75::DOUBLE AS rubric, fine AS density, round(fine * (0.45::DOUBLE * coverage + 0.35::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE * 0.75::DOUBLE), 6) AS blended,
  CASE WHEN lang = 'en' THEN 'two' ELSE '' END AS missed, CASE WHEN lang IS NULL THEN 'no summary' WHEN fine = 0 THEN 'verdicts don''t fit' END AS error FROM r
""")
def scored_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("doc_name"), F.col("doc_id").alias("pos"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    told = docs.select("doc_id", F.concat(F.lit("<<"), "lang", F.lit(">> by model")).alias("summary"), F.lit(None).cast("string").alias("error"))
    sections = docs.select("doc_id", F.lit(1).alias("section_index"), F.lit("t").alias("title"), "text")
    answers = RoutedCompleter((
        ("FACTS t ", '{"facts": ["one", "two"]}'), ("COVER <<en>>", _VERDICTS % ("covered", "covered", "false")), ("COVER <<fr>>", _VERDICTS % ("covered", "covered", "true")), ("COVER", "nothing"),
        ("CLAIMS", '{"claims": ["c", "d"]}'), ("SUPPORT", _VERDICTS % ("supported", "supported", "true")), ("RUBRIC", '{"coherence": 5, "organization": 4, "readability": 3, "notes": ""}'),
    ))
    _, scores, _ = evaluation.evaluate(docs.drop("lang"), lambda d: told, sections, answers, "run", {"facts": "v001"}, _PROMPTS)
    return scores.select("doc_id", "coverage", "faithfulness", F.round("rubric", 6).alias("rubric"), "density", F.round("blended", 6).alias("blended"), F.array_join("missed", ",").alias("missed"), "error")


@query("merged_summaries", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'mended en' WHEN lang = 'fr' THEN 'mended other' END AS summary, CASE WHEN lang IN ('en', 'fr') THEN 'merged' END AS merged, CASE WHEN lang IN ('en', 'fr') THEN NULL ELSE 'lost' END AS error FROM documents
""")
def merged_summaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<<"), F.coalesce("lang", F.lit("")), F.lit(">>")).alias("doc_name"), "text")
    good = F.col("doc_name").isin("<<en>>", "<<fr>>")
    standard = docs.select("doc_id", F.when(good, "plain").alias("summary"), F.when(~good, "lost").alias("error"))
    selected = docs.select("doc_id", F.col("doc_name").alias("name"), F.lit("graph").alias("markdown"))
    answers = RoutedCompleter((("GRAPH", "by graph"), ("MERGE", "merged"), ("REPAIR <<en>> graph merged", "mended en"), ("REPAIR", "mended other")))
    by_graph = evaluation.graph_summaries(selected, "GRAPH {{document}} {{graph}}", answers)
    templates = {"merge": "MERGE {{document}} {{standard}} {{graph}}", "repair": "REPAIR {{document}} {{graph}} {{summary}}"}
    return evaluation.merged_summaries(docs, standard, by_graph, selected, templates, answers, _PROMPTS).select("doc_id", "summary", "merged", "error")


@query("stored_answers", r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), h AS (SELECT *, left(text, greatest(1, length(text) // 2)) AS half FROM d)
SELECT doc_id, CASE WHEN served THEN half END AS value, CASE WHEN served THEN NULL ELSE 'nobody is asked' END AS error
FROM (SELECT doc_id, half, text IN (SELECT text FROM d WHERE lang = 'en') AND trim(regexp_replace(half, '\s+', ' ', 'g')) <> '' AS served FROM h)
""")
def stored_answers(spark, sf_dir):
    """Answers about English texts are stored; then all texts are wanted and no model is asked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.key_of(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    kept = ContentStore(spark, f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}")
    through(kept, docs.where("lang = 'en'"), lambda todo: models.complete(todo, F.col("text"), models.HalvingCompleter(), retries=1).withColumnRenamed("result", "value"))
    kept.compact()
    kept.clean()
    return through(kept, docs, lambda todo: todo.select("key", F.lit(None).cast("string").alias("value"), F.lit("nobody is asked").alias("error"))).select("doc_id", "value", "error")
