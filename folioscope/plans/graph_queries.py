"""Queries of vectors, graphs, evaluation, ingest and transcripts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import jsonx
from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.lineage import shared_folder
from folioscope.operators import chunking, evals, evidence, graph, ingest, packing, transcripts
from folioscope.plans.catalogue import query
from folioscope.plans.text_queries import table
from folioscope.streaming import ingest as streamed

_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query("similar_pairs", f"""
SELECT a.label, a.vec_id AS left_id, b.vec_id AS right_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 3) AS weight
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS.format(a='a.embedding', b='b.embedding')} >= 0.3
""")
def similar_pairs(spark, sf_dir):
    found = graph.similar_pairs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.3)
    return found.select("label", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "weight")


@query("boundary_similarity", """
WITH v AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
w AS (SELECT label, vec_id, d, avg(x) OVER (PARTITION BY label, d ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a,
             avg(x) OVER (PARTITION BY label, d ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM v)
SELECT label, vec_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS similarity FROM w WHERE b IS NOT NULL GROUP BY label, vec_id
""")
def boundary_similarity(spark, sf_dir):
    return chunking.boundary_similarities(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 64)


@query("valley_cuts")
def valley_cuts(spark, sf_dir):
    """Cuts of each label's vectors where neighbours are least alike, 3 to 12 items of 100 tokens."""
    near = chunking.boundary_similarities(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 64)
    listed = near.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "similarity"))), lambda x: x["similarity"]).alias("similarities"))
    sized = listed.withColumn("tokens", F.array_repeat(F.lit(100), F.size("similarities") + 1))
    return chunking.valley_cuts(sized, "label", "tokens", "similarities", 300, 1200)


@query("valley_chunks", """
WITH RECURSIVE v AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
w AS (SELECT label, vec_id, d, avg(x) OVER (PARTITION BY label, d ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a, avg(x) OVER (PARTITION BY label, d ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM v),
near AS (SELECT label, vec_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS sim FROM w WHERE b IS NOT NULL GROUP BY label, vec_id),
seq AS (SELECT label, vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS idx, 60 + vec_id % 90 AS size, coalesce(sim, CAST('inf' AS DOUBLE)) AS sim FROM embeddings LEFT JOIN near USING (label, vec_id)),
s AS (SELECT *, sum(size) OVER (ORDER BY idx) AS upto, count(*) OVER () AS n FROM seq),
bounds AS (SELECT a.idx, a.n, greatest(a.idx + 1, max(b.idx) FILTER (WHERE b.upto <= a.upto - a.size + 1200) + 1) AS fin, greatest(a.idx + 1, coalesce(max(b.idx) FILTER (WHERE b.upto < a.upto - a.size + 300), -1) + 2) AS low FROM s a JOIN s b ON b.idx BETWEEN a.idx - 1 AND a.idx + 25 GROUP BY a.idx, a.n),
best AS (SELECT b.idx, min_by(c.idx + 1, struct_pack(x := c.sim, y := c.idx)) AS place FROM bounds b JOIN s c ON c.idx BETWEEN b.low - 1 AND b.fin - 1 WHERE b.fin < b.n AND b.low <= b.fin GROUP BY b.idx),
nxt AS (SELECT b.idx, CASE WHEN fin >= n THEN n ELSE coalesce(place, fin) END AS next FROM bounds b LEFT JOIN best USING (idx)),
orbit AS (SELECT CAST(0 AS BIGINT) AS idx UNION ALL SELECT CAST(x.next AS BIGINT) FROM orbit o JOIN nxt x ON x.idx = o.idx JOIN s ON s.idx = x.next)
SELECT label, vec_id, CAST(sum(CASE WHEN o.idx IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY s.idx) - 1 AS INTEGER) AS chunk FROM s LEFT JOIN orbit o ON o.idx = s.idx
""")
def valley_chunks(spark, sf_dir):
    """All vectors as one sequence, cut where neighbours are least alike, 300 to 1200 tokens a chunk."""
    vectors = table(spark, sf_dir, "embeddings")
    near = chunking.boundary_similarities(vectors, "label", "vec_id", "embedding", 64)
    sized = vectors.select("label", "vec_id", (60 + F.col("vec_id") % 90).alias("size")).join(near, ["label", "vec_id"], "left")
    return packing.valleys(sized, [], [F.col("label"), F.col("vec_id")], F.col("size"), F.col("similarity"), 300, 1200).select("label", "vec_id", "chunk")


def _items(spark, sf_dir) -> DataFrame:
    """Documents as claims of one graph a language: the source's number is the section, a score from
    the text's terms."""
    docs = table(spark, sf_dir, "documents")
    section = F.regexp_extract("source", r"(\d+)", 1).cast("int") + 1
    n = F.size(T.terms(F.col("text")))
    score = F.round(F.least(F.lit(1.0), n / 180) + F.least(F.lit(1.0), n / 280), 4)
    return docs.select(F.col("lang").alias("doc_id"), F.col("doc_id").cast("bigint").alias("pos"), F.format_string("claim:%06d", "doc_id").alias("id"), F.lit("claim").alias("type"), section.alias("section_index"), score.alias("score"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_ITEMS = f"""
items AS (SELECT lang AS doc_id, doc_id AS pos, 'claim:' || lpad(doc_id::VARCHAR, 6, '0') AS id, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) + 1 AS section_index, round(least(1.0, n / 180) + least(1.0, n / 280), 4) AS score
  FROM (SELECT *, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda w: w NOT IN ({_STOP})))) AS n FROM documents))
"""


@query("ranked_subgraph", f"""
WITH {_ITEMS}, phased AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, section_index ORDER BY score DESC, id) = 1 THEN 1 ELSE 0 END AS first FROM items)
SELECT doc_id, id, section_index, score, row_number() OVER (PARTITION BY doc_id ORDER BY first DESC, CASE WHEN first = 1 THEN section_index END, score DESC, id) AS rank FROM phased QUALIFY rank <= 48
""")
def ranked_subgraph(spark, sf_dir):
    """The best item of each section, then the best of the rest up to 48; the limit is the feature."""
    items = _items(spark, sf_dir)
    return graph.ranked_items(items, "claim", 48, carry=("section_index", "score"))


def _star_edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Region, nation, customer and order as a graph; items are all orders."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edge = lambda a, b: (a.cast("string"), b.cast("string"))
    rows = [
        nation.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target")),
        customer.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target")),
        orders.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target")),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("doc_id", F.lit("star"))
    chosen = orders.select(F.lit("star").alias("doc_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return every, chosen


_STAR = """
e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
up AS (SELECT 'o' || o_orderkey AS id FROM orders UNION SELECT e.source FROM up JOIN e ON e.target = up.id)
"""


@query("ancestor_closure", f"WITH RECURSIVE {_STAR} SELECT 'star' AS doc_id, id FROM up")
def ancestor_closure(spark, sf_dir):
    edges, items = _star_edges(spark, sf_dir)
    return graph.closure(edges, items)


@query("induced_edges", f"WITH RECURSIVE {_STAR} SELECT e.source, e.target FROM e WHERE e.source IN (SELECT id FROM up) AND e.target IN (SELECT id FROM up)")
def induced_edges(spark, sf_dir):
    edges, items = _star_edges(spark, sf_dir)
    nodes = edges.select("doc_id", F.col("source").alias("id")).distinct()
    return graph.induced(nodes, edges, graph.closure(edges, items))[1].select("source", "target")


@query("exact_closure", "SELECT CAST(label AS VARCHAR) AS doc_id, unnest(['c' || vec_id, 'e' || vec_id]) AS id FROM embeddings")
def exact_closure(spark, sf_dir):
    """Selection in order over evidence and similarity edges of each label's vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("doc_id"), "vec_id", "embedding")
    near = graph.similar_pairs(v, ["doc_id"], "vec_id", "embedding", 0.25).select("doc_id", F.concat(F.lit("c"), "left").alias("source"), F.concat(F.lit("c"), "right").alias("target"))
    backs = v.select("doc_id", F.concat(F.lit("e"), "vec_id").alias("source"), F.concat(F.lit("c"), "vec_id").alias("target"))
    edges = backs.unionByName(near).withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "target")))
    items = v.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("vec_id"))).select("doc_id", F.concat(F.lit("c"), "vec_id").alias("id"), "turn")
    return graph.closure_exact(edges, items)


@query("exact_spans", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def exact_spans(spark, sf_dir):
    return evidence.exact_spans(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("evidence_plan", """
WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY lang, source) AS first FROM documents),
t AS (SELECT lang, source, first, string_agg('ev:' || doc_id, ' ' ORDER BY doc_id) FILTER (WHERE n <= 8) AS evidence_ids, count(*) AS records FROM r GROUP BY lang, source, first)
SELECT lang AS doc_id, row_number() OVER (PARTITION BY lang ORDER BY first) AS topic, source AS section_path, evidence_ids, records, CAST(greatest(80, least(300, records * 45)) AS BIGINT) AS words FROM t
""")
def evidence_plan(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("source").alias("section_path"), F.col("doc_id").alias("pos"), T.evidence_id(F.col("doc_id").cast("string")).alias("id"))
    return evidence.summary_plan(records).withColumn("evidence_ids", F.array_join("evidence_ids", " "))


def _runs(spark, sf_dir) -> DataFrame:
    """Runs made of labels: run by id, a document a source, its score the share of good quality."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    run = F.concat(F.lit("run-"), F.pmod("doc_id", F.lit(3)).cast("string"))
    sums = joined.groupBy(run.alias("run_id"), F.col("source").alias("doc_name")).agg(F.avg("quality").alias("q"), F.count_if(F.col("toxic") == 1).alias("bad"), F.min("doc_id").alias("pos"))
    return sums.select("run_id", F.lit("standard").alias("kind"), "pos", "doc_name", F.round("q", 6).alias("blended"), F.when(F.col("bad") > 2, F.lit("failed")).alias("error"))


_RUNS = """
runs AS (SELECT 'run-' || (doc_id % 3) AS run_id, source AS doc_name, min(doc_id) AS pos, round(avg(quality), 6) AS blended, CASE WHEN count(*) FILTER (WHERE toxic = 1) > 2 THEN 'failed' END AS error FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
"""


@query("paired_deltas", f"WITH {_RUNS} SELECT a.doc_name, round(b.blended - a.blended, 6) AS delta FROM runs a JOIN runs b USING (doc_name) WHERE a.run_id = 'run-0' AND b.run_id = 'run-1' AND a.error IS NULL AND b.error IS NULL")
def paired_deltas(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evals.paired_deltas(runs.where("run_id = 'run-0'"), runs.where("run_id = 'run-1'")).select("doc_name", F.round("delta", 6).alias("delta"))


@query("promotion_gate", f"""
WITH {_RUNS}, d AS (SELECT b.run_id, round(b.blended - a.blended, 6) AS delta FROM runs a JOIN runs b USING (doc_name) WHERE a.run_id = 'run-0' AND b.run_id <> 'run-0' AND a.error IS NULL AND b.error IS NULL)
SELECT run_id, count(*) AS docs, round(avg(delta), 6) AS mean_delta, count(*) FILTER (WHERE delta >= 0) AS wins, avg(delta) >= 0.02 AND 2 * count(*) FILTER (WHERE delta >= 0) > count(*) AS promoted FROM d GROUP BY run_id
""")
def promotion_gate(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    deltas = runs.where("run_id = 'run-0' AND error IS NULL").select("doc_name", F.col("blended").alias("old")).join(runs.where("run_id <> 'run-0' AND error IS NULL"), "doc_name")
    gated = evals.gate(deltas.select("run_id", F.round(F.col("blended") - F.col("old"), 6).alias("delta")), ["run_id"])
    return gated.select("run_id", "docs", F.round("mean_delta", 6).alias("mean_delta"), "wins", "promoted")


@query("best_of_history", f"WITH {_RUNS} SELECT doc_name, run_id, blended FROM runs WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY doc_name ORDER BY blended DESC, run_id) = 1")
def best_of_history(spark, sf_dir):
    return evals.best_of_history(_runs(spark, sf_dir))


@query("mean_and_worst", f"""
WITH {_RUNS} SELECT run_id, round(coalesce(avg(CASE WHEN error IS NULL THEN blended END), 0.0), 6) AS mean_blended, (SELECT doc_name FROM runs w WHERE w.run_id = runs.run_id AND w.error IS NULL ORDER BY blended, pos LIMIT 1) AS worst FROM runs GROUP BY run_id
""")
def mean_and_worst(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    worst = evals.worst_document(runs, ["run_id"]).select("run_id", F.col("doc_name").alias("worst"))
    return evals.mean_blended(runs, ["run_id"]).join(worst, "run_id", "left").select("run_id", F.round("mean_blended", 6).alias("mean_blended"), "worst")


@query("summary_scores", """
WITH s AS (SELECT source, count(*) AS n, sum(quality) AS covered, sum(1 - toxic) AS supported, sum(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS words FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, round(covered / n, 6) AS coverage, round(supported / n, 6) AS faithfulness, round(least(1.0, covered / greatest(words, 1) * 100), 6) AS density,
       round(0.45 * (covered / n) + 0.35 * (supported / n) + 0.10 * least(1.0, covered / greatest(words, 1) * 100) + 0.10 * 0.5, 6) AS blended FROM s
""")
def summary_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.word_count(F.col("text")).alias("n_words"))
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    kinds = F.array(F.struct(F.lit("fact").alias("kind"), (F.col("quality") == 1).alias("good")), F.struct(F.lit("claim").alias("kind"), (F.col("toxic") == 0).alias("good")))
    rates = evals.verdict_rates(joined.select("source", F.explode(kinds).alias("v")).select("source", "v.*"), ["source"])
    words = joined.groupBy("source").agg(F.sum("n_words").alias("words"))
    scored = evals.score_summaries(rates.join(words, "source").withColumn("rubric", S.rubric_normal([F.lit(3.0), F.lit(3.0)])))
    return scored.select("source", *[F.round(c, 6).alias(c) for c in ("coverage", "faithfulness", "density", "blended")])


@query("judge_accuracy", """
SELECT lang AS kind, count(*) FILTER (WHERE quality = 1 - toxic) AS correct, count(*) AS total, round(count(*) FILTER (WHERE quality = 1 - toxic) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)
""")
def judge_accuracy(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind")), "doc_id")
    return evals.judge_accuracy(cases.select("kind", (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("actual"))).withColumn("accuracy", F.round("accuracy", 6))


@query("outline_accuracy", """
SELECT lang, count(*) AS cases, count(quality) AS annotated, count(*) - count(quality) AS pending, count(*) FILTER (WHERE quality = 1) AS correct, round(CASE WHEN count(quality) > 0 THEN count(*) FILTER (WHERE quality = 1) / count(quality) END, 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def outline_accuracy(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evals.outline_accuracy(cases.select("lang", F.col("quality").alias("expected"), F.lit(1).alias("predicted")), ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("ingest_status", """
WITH src AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS path, sha256(text) AS sha, doc_id FROM documents),
idx AS (SELECT sha, max(asset_dir) AS asset_dir, arg_max(processed, asset_dir) AS processed FROM (SELECT s.sha, 'asset-' || lpad(s.doc_id::VARCHAR, 8, '0') AS asset_dir, quality = 1 AS processed FROM labels JOIN src s USING (doc_id)) GROUP BY sha)
SELECT path, CASE WHEN processed THEN 'skipped' WHEN path <> min(path) OVER (PARTITION BY sha) THEN 'skipped' WHEN processed IS NOT NULL THEN 'resumed' ELSE 'ingested' END AS status FROM src LEFT JOIN idx USING (sha)
""")
def ingest_status(spark, sf_dir):
    sources, index = _ingest(spark, sf_dir)
    return ingest.plan(sources, index).select("path", "status")


def _ingest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    sources = docs.select(F.format_string("doc-%08d", "doc_id").alias("path"), "sha256")
    assets = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.format_string("asset-%08d", "doc_id").alias("asset_dir"), F.to_json(F.struct(F.col("sha256").alias("source_sha256"))).alias("metadata"), F.col("quality").alias("chunks"))
    return sources, ingest.asset_index(assets)


@query("ingest_outcomes", """
WITH src AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS path, sha256(text) AS sha, doc_id FROM documents),
idx AS (SELECT sha, arg_max(processed, asset_dir) AS processed FROM (SELECT s.sha, 'asset-' || lpad(s.doc_id::VARCHAR, 8, '0') AS asset_dir, quality = 1 AS processed FROM labels JOIN src s USING (doc_id)) GROUP BY sha),
st AS (SELECT CASE WHEN processed THEN 'skipped' WHEN path <> min(path) OVER (PARTITION BY sha) THEN 'skipped' WHEN processed IS NOT NULL THEN 'resumed' ELSE 'ingested' END AS status FROM src LEFT JOIN idx USING (sha))
SELECT status, count(*) AS n FROM st GROUP BY status
""")
def ingest_outcomes(spark, sf_dir):
    return ingest.outcome_counts(ingest.plan(*_ingest(spark, sf_dir)))


@query("transcripts", """
WITH p AS (SELECT conv_id, turn, role, text, turn * 60.0 AS start, turn * 60.0 + length(text) / 15 AS stop FROM conversations)
SELECT conv_id, string_agg('[' || lpad((CAST(round(start * 1000) AS BIGINT) % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((CAST(round(start * 1000) AS BIGINT) % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((CAST(round(start * 1000) AS BIGINT) % 1000)::VARCHAR, 3, '0') || ' - '
  || lpad((CAST(round(stop * 1000) AS BIGINT) % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((CAST(round(stop * 1000) AS BIGINT) % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((CAST(round(stop * 1000) AS BIGINT) % 1000)::VARCHAR, 3, '0') || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS text
FROM p GROUP BY conv_id
""")
def transcript_lines(spark, sf_dir):
    """Turns as one-minute windows: merged by offset, then written as lines."""
    said = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    segment = F.struct(F.lit(0.0).alias("start"), (F.length("text") / 15).alias("end"), F.col("role").alias("speaker"), "text")
    parts = said.select(F.col("conv_id").alias("recording"), (F.col("turn") * 60.0).alias("offset"), "text", F.lit(None).cast("string").alias("language"), F.lit(60.0).alias("duration"), F.array(segment).alias("segments"))
    merged = transcripts.merge(parts).select(F.col("recording").alias("conv_id"), F.posexplode("segments").alias("n", "s")).select("conv_id", "n", "s.*")
    return transcripts.diarised(merged, "conv_id", "n")


@query("audio_windows", """
WITH d AS (SELECT conv_id, sum(length(text)) / 2.0 AS seconds FROM conversations GROUP BY conv_id)
SELECT conv_id, i * 600.0 AS start, least(600.0, seconds - i * 600.0) AS length FROM (SELECT conv_id, seconds, unnest(range(CAST(greatest(1, ceil(seconds / 600)) AS BIGINT))) AS i FROM d)
""")
def audio_windows(spark, sf_dir):
    seconds = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) / 2.0).alias("seconds"))
    return seconds.select("conv_id", F.explode(chunking.audio_windows(F.col("seconds"), 600)).alias("w")).select("conv_id", "w.start", "w.length")


@query("strict_json", """
SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 1 AND 50 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, json_type(props, '$.k') = 'VARCHAR' AS is_text FROM events
""")
def strict_json(spark, sf_dir):
    v = jsonx.salvage(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", jsonx.strict_integer(v, "$.k", 1, 50).alias("k"), (jsonx.kind(v, "$.k") == "STRING").alias("is_text"))


@query("prompt_overrides", """
SELECT source, array_to_string(list_sort(list_transform(map_entries(map_concat(MAP {'a': 'v001', 'b': 'v002'}, MAP {'b': 'v' || min(doc_id), 'c': 'v' || max(doc_id)})), lambda e: e.key || '=' || e.value)), ' ') AS versions FROM documents GROUP BY source
""")
def prompt_overrides(spark, sf_dir):
    v = lambda c: F.concat(F.lit("v"), c.cast("string"))
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.create_map(F.lit("b"), v(F.min("doc_id")), F.lit("c"), v(F.max("doc_id"))).alias("own"))
    both = evals.overrides(F.create_map(F.lit("a"), F.lit("v001"), F.lit("b"), F.lit("v002")), F.col("own"))
    return own.select("source", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias("versions"))


@query("set_differences", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
""")
def set_differences(spark, sf_dir):
    return evals.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("streamed_ingest", """
WITH src AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS path, sha256(text) AS sha FROM documents)
SELECT sha AS sha256, min(path) AS first_path, count(*) AS copies FROM src GROUP BY sha
""")
def streamed_ingest(spark, sf_dir):
    """Documents as a stream through the ingest: what is new is processed, copies are skipped. The sink's
    files are in the shared folder, with the stream's checkpoint."""
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    hashed = stream.select(F.format_string("doc-%08d", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    folder = f"{shared_folder(spark)}/streamed-ingest-{uuid.uuid4().hex}"
    run = streamed.run(hashed, f"{folder}/index", f"{folder}/outcome", f"{folder}/checkpoint")
    run.awaitTermination()
    outcome = spark.read.schema("path string, sha256 string, asset_dir string, status string, batch bigint").parquet(f"{folder}/outcome")
    return outcome.groupBy("sha256").agg(F.min(F.when(F.col("status") == "ingested", F.col("path"))).alias("first_path"), F.count(F.lit(1)).alias("copies"))
