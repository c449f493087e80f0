"""Queries of whole graphs, evidence, item scores, chunk files, run histories and small readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.lineage import cut
from folioscope.operators import chunking, evals, evidence, graph, models, structure
from folioscope.plans.catalogue import query
from folioscope.plans.graph_queries import _RUNS, _runs
from folioscope.plans.text_queries import _SLUG, _STOP, table
from folioscope.sources import files, sinks

_TERMS = "len(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{2,}}'), lambda w: w NOT IN (" + _STOP + "))))"
_ASCII = "coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), {n}), '^-+|-+$', '', 'g'), ''), 'item')"
_FLAT = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _share(x: str, most: int) -> str:
    return f"least(1.0, {_TERMS.format(x=x)} / {most})"


def _trimmed(x: str, limit: int) -> str:
    flat = _FLAT.format(x=x)
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(left({flat}, {limit - 1})) || '...' END"


#: Conversations as documents: a turn is a section with a claim, every odd turn has a concept, every
#: third a passage.
_GRAPH = f"""
turns AS (SELECT 'conv-' || conv_id AS doc_id, CAST(turn AS INTEGER) + 1 AS section_index, 'Turn ' || turn AS title, role, text, turn FROM conversations WHERE text IS NOT NULL),
items AS (
  SELECT doc_id, section_index, title, 'claim' AS kind, 1 AS item_index, text AS name, '' AS body, 'Said by ' || role AS evidence, round(0.5 + {_share('text', 18)} + {_share("('Said by ' || role)", 28)}, 4) AS score FROM turns
  UNION ALL SELECT doc_id, section_index, title, 'concept', 1, role, text, 'In turn ' || turn, round(0.0 + {_share('text', 18)} + {_share("('In turn ' || turn)", 28)}, 4) FROM turns WHERE turn % 2 = 1
  UNION ALL SELECT doc_id, section_index, title, 'key_passage', 1, text, '', role, round(0.0 + {_share('role', 18)} + {_share('text', 42)}, 4) FROM turns WHERE turn % 3 = 0),
named AS (SELECT *, {_ASCII.format(x='name', n=72)} AS slug FROM items),
ids AS (SELECT *, CASE WHEN kind = 'key_passage' THEN 'key_passage:' || doc_id || ':' || section_index || ':1' ELSE kind || ':' || doc_id || ':' || slug || ':' || row_number() OVER (PARTITION BY doc_id, kind, slug ORDER BY section_index, item_index) END AS id,
  'evidence:' || doc_id || ':' || section_index || ':1' AS evidence_id, CASE kind WHEN 'claim' THEN 1 WHEN 'concept' THEN 2 ELSE 3 END AS rank FROM named),
placed AS (
  SELECT doc_id, -1 AS a, 0 AS b, 0 AS c, 'document:' || doc_id AS id, 'document' AS type, doc_id AS label, '' AS text, CAST(NULL AS INTEGER) AS section_index, 0.0 AS score FROM (SELECT DISTINCT doc_id FROM turns)
  UNION ALL SELECT t.doc_id, t.section_index, 0, 0, 'section:' || t.doc_id || ':' || t.section_index, 'section', t.title, {_trimmed('t.text', 600)}, t.section_index, s.best FROM turns t JOIN (SELECT doc_id, section_index, max(score) AS best FROM items GROUP BY ALL) s USING (doc_id, section_index)
  UNION ALL SELECT doc_id, section_index, 1, 0, evidence_id, 'evidence', title || ' evidence 1', evidence, section_index, score FROM ids WHERE kind = 'claim'
  UNION ALL SELECT doc_id, section_index, rank, 1, id, kind, CASE WHEN kind = 'key_passage' THEN title || ' key passage 1' ELSE {_trimmed('name', 120)} END, CASE WHEN kind = 'concept' THEN body ELSE name END, section_index, score FROM ids),
nodes AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) - 1 AS pos, id, type, label, text, section_index, score FROM placed),
linked AS (
  SELECT doc_id, section_index AS a, 0 AS b, 0 AS c, 'document:' || doc_id AS source, 'section:' || doc_id || ':' || section_index AS target, 'contains' AS type, '' AS evidence FROM turns
  UNION ALL SELECT doc_id, section_index, 1, 0, 'section:' || doc_id || ':' || section_index, evidence_id, 'contains', '' FROM ids WHERE kind = 'claim'
  UNION ALL SELECT doc_id, section_index, rank, 1, CASE WHEN kind = 'claim' THEN evidence_id ELSE 'section:' || doc_id || ':' || section_index END, id, CASE kind WHEN 'claim' THEN 'supports' WHEN 'concept' THEN 'defines' ELSE 'highlights' END, CASE WHEN kind = 'claim' THEN evidence ELSE '' END FROM ids),
edges AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) - 1 AS pos, source, target, type, evidence FROM linked)
"""


def _conversation_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns and the nodes and edges of their graph."""
    said = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    turn = F.col("turn").cast("string")
    turns = said.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("doc_id"), (F.col("turn") + 1).cast("int").alias("section_index"), F.concat(F.lit("Turn "), turn).alias("title"), "role", "text", "turn")
    docs = turns.select("doc_id").distinct()
    sources = docs.select("doc_id", F.concat(F.lit("document:"), F.col("doc_id")).alias("id"), F.col("doc_id").alias("key"), F.lit("document").alias("type"), F.col("doc_id").alias("label"), F.col("doc_id").alias("source_path"), F.create_map(F.lit("kind"), F.lit("talk")).alias("metadata"))
    item = lambda kind, name, body, proof: F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("item_index"), name.alias("name"), body.alias("body"), proof.alias("evidence"))
    text, none, by = F.col("text"), F.lit(""), F.concat(F.lit("Said by "), F.col("role"))
    every = F.array_compact(F.array(
        item("claim", text, none, by),
        F.when(F.col("turn") % 2 == 1, item("concept", F.col("role"), text, F.concat(F.lit("In turn "), turn))),
        F.when(F.col("turn") % 3 == 0, item("key_passage", text, none, F.col("role"))),
    ))
    items = turns.select("doc_id", "section_index", F.explode(every).alias("i")).select("doc_id", "section_index", "i.*")
    near = turns.select("doc_id", text.alias("left"), by.alias("right"), F.lit(0.5).alias("cosine")).distinct()
    return turns, *graph.build(sources, turns.select("doc_id", "section_index", "title", "text"), items, near)


@query("claim_graph_nodes", f"WITH {_GRAPH} SELECT * FROM nodes")
def claim_graph_nodes(spark, sf_dir):
    """Claims, concepts, passages, evidence and sections with ids, scores and places."""
    nodes = _conversation_graph(spark, sf_dir)[1]
    return nodes.select("doc_id", "pos", "id", "type", "label", "text", "section_index", "score")


@query("claim_graph_edges", f"WITH {_GRAPH} SELECT * FROM edges")
def claim_graph_edges(spark, sf_dir):
    return _conversation_graph(spark, sf_dir)[2].select("doc_id", "pos", "source", "target", "type", "evidence")


@query("graph_counts", f"""
WITH {_GRAPH} SELECT doc_id, n.nodes, n.claims, n.sections, e.edges, CAST(0 AS BIGINT) AS similar
FROM (SELECT doc_id, count(*) AS nodes, count(*) FILTER (WHERE type = 'claim') AS claims, count(*) FILTER (WHERE type = 'section') AS sections FROM nodes GROUP BY doc_id) n JOIN (SELECT doc_id, count(*) AS edges FROM edges GROUP BY doc_id) e USING (doc_id)
""")
def graph_counts(spark, sf_dir):
    _, nodes, edges = _conversation_graph(spark, sf_dir)
    return graph.graph_counts(nodes, edges)


@query("section_counts", f"WITH {_GRAPH} SELECT doc_id, section_index, count(*) FILTER (WHERE type = 'claim') AS claims, count(*) FILTER (WHERE type = 'concept') AS concepts, count(*) FILTER (WHERE type = 'key_passage') AS passages FROM nodes WHERE section_index IS NOT NULL GROUP BY ALL")
def section_counts(spark, sf_dir):
    return graph.section_counts(_conversation_graph(spark, sf_dir)[1])


@query("supported_claims", f"""
WITH {_GRAPH} SELECT c.doc_id, c.id, c.text, string_agg(e.text, '|' ORDER BY s.pos) AS evidence_texts
FROM nodes c JOIN edges s ON s.doc_id = c.doc_id AND s.target = c.id AND s.type = 'supports' JOIN nodes e ON e.doc_id = c.doc_id AND e.id = s.source WHERE c.type = 'claim' GROUP BY ALL
""")
def supported_claims(spark, sf_dir):
    _, nodes, edges = _conversation_graph(spark, sf_dir)
    return graph.supported_claims(nodes, edges).select("doc_id", "id", "text", F.array_join("evidence_texts", "|").alias("evidence_texts"))


@query("graph_json", f"WITH {_GRAPH} SELECT doc_id, pos, id, type, label, text, section_index, score FROM nodes")
def graph_json(spark, sf_dir):
    """Graphs written as JSON and read again."""
    _, nodes, edges = _conversation_graph(spark, sf_dir)
    return graph.from_json(graph.to_json(nodes, edges))[0].select("doc_id", "pos", "id", "type", "label", "text", "section_index", "score")


@query("graph_markdown", f"""
WITH {_GRAPH}, meta AS (SELECT n.*, i.title, i.evidence AS why, i.name, i.body FROM nodes n LEFT JOIN ids i ON i.doc_id = n.doc_id AND (i.id = n.id OR i.evidence_id = n.id AND i.kind = 'claim')),
parts AS (
  SELECT doc_id, string_agg('### ' || id || chr(10) || chr(10) || '- Score: ' || printf('%.4f', score) || chr(10) || '- Section: ' || title || chr(10) || '- Claim: ' || text || chr(10) || '- Supported by: `evidence:' || doc_id || ':' || section_index || ':1`', chr(10) || chr(10) ORDER BY pos) FILTER (WHERE type = 'claim') AS p1,
    string_agg('### ' || id || chr(10) || chr(10) || '- Score: ' || printf('%.4f', score) || chr(10) || '- Section: ' || title || chr(10) || '- Concept: ' || label || chr(10) || '- Definition: ' || text || chr(10) || '- Source evidence: ' || why, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE type = 'concept') AS p2,
    string_agg('### ' || id || chr(10) || chr(10) || '- Score: ' || printf('%.4f', score) || chr(10) || '- Section: ' || title || chr(10) || '- Why it matters: ' || why || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE type = 'key_passage') AS p3,
    string_agg('### ' || m.id || chr(10) || chr(10) || '- Section: ' || title || chr(10) || '- Supports: `' || (SELECT min(target) FROM edges e WHERE e.doc_id = m.doc_id AND e.source = m.id AND e.type = 'supports') || '`' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE type = 'evidence') AS p4,
    string_agg('- `' || id || '` ' || label || ' (score ' || printf('%.4f', score) || '; ' || (SELECT count(*) FROM edges e WHERE e.doc_id = m.doc_id AND e.source = m.id) || ' selected summary nodes)', chr(10) ORDER BY pos) FILTER (WHERE type = 'section') AS p5
  FROM meta m GROUP BY doc_id)
SELECT doc_id, '# Selected Summary Graph' || chr(10) || chr(10) || 'Document: `' || doc_id || '`' || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || coalesce(p1 || chr(10) || chr(10), '') || '## Concepts' || chr(10) || chr(10) || coalesce(p2 || chr(10) || chr(10), '')
  || '## Key Passages' || chr(10) || chr(10) || coalesce(p3 || chr(10) || chr(10), '') || '## Evidence' || chr(10) || chr(10) || coalesce(p4 || chr(10) || chr(10), '') || '## Sections' || chr(10) || chr(10) || p5 || chr(10) AS markdown FROM parts
""")
def graph_markdown(spark, sf_dir):
    _, nodes, edges = _conversation_graph(spark, sf_dir)
    return graph.render_markdown(nodes, edges)


@query("evidence_records", f"""
WITH {_GRAPH}, whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM turns GROUP BY doc_id),
r AS (SELECT n.doc_id, n.pos, n.id AS node_id, n.type AS kind, i.title,
    CASE n.type WHEN 'claim' THEN i.evidence WHEN 'concept' THEN n.label || ': ' || n.text ELSE n.text END AS text, CASE n.type WHEN 'evidence' THEN i.name ELSE n.text END AS claim, n.score
  FROM nodes n JOIN ids i ON i.doc_id = n.doc_id AND (i.id = n.id OR i.evidence_id = n.id AND i.kind = 'claim') WHERE n.type IN ('claim', 'evidence', 'concept', 'key_passage'))
SELECT doc_id, pos, 'ev:' || regexp_replace(node_id, '[^a-zA-Z0-9._:-]+', '-', 'g') AS id, kind, text, claim, title AS section_path, score, contains(whole, text) AS exact, 'doc:full' AS block_id FROM r JOIN whole USING (doc_id)
""")
def evidence_records(spark, sf_dir):
    """Evidence of each conversation, whose text is that of its turns."""
    turns, nodes, edges = _conversation_graph(spark, sf_dir)
    docs = chunking.merge_texts(turns, "doc_id", "turn", "text", "\n").withColumn("name", F.col("doc_id"))
    none = turns.where("1 = 0").select("doc_id", F.lit(1).alias("chunk"), F.lit("").alias("name"), "text")
    found = evidence.evidence_records(nodes, evidence.source_blocks(docs, none), edges)
    return found.select("doc_id", "pos", "id", "kind", "text", "claim", "section_path", "score", "exact", "block_id")


@query("selected_nodes", f"""
WITH {_GRAPH}, ranked AS (SELECT doc_id, id, type, row_number() OVER (PARTITION BY doc_id, type ORDER BY section_index, score DESC, id) AS rank FROM nodes WHERE type IN ('claim', 'concept', 'key_passage')),
chosen AS (SELECT doc_id, id FROM ranked WHERE type = 'claim' AND rank <= 3 OR type <> 'claim' AND rank <= 1),
up AS (SELECT c.doc_id, c.id FROM chosen c UNION SELECT e.doc_id, e.source FROM edges e JOIN chosen c ON c.doc_id = e.doc_id AND c.id = e.target
  UNION SELECT e2.doc_id, e2.source FROM edges e2 JOIN edges e ON e2.doc_id = e.doc_id AND e2.target = e.source JOIN chosen c ON c.doc_id = e.doc_id AND c.id = e.target
  UNION SELECT DISTINCT doc_id, 'document:' || doc_id FROM chosen)
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY type, coalesce(section_index, 0), score DESC, id) - 1 AS pos FROM nodes SEMI JOIN up USING (doc_id, id)
""")
def selected_nodes(spark, sf_dir):
    """Each graph's best claims, concept and passage (one a section here) with all above them; the limits are the feature."""
    _, nodes, edges = _conversation_graph(spark, sf_dir)
    return graph.select_subgraph(nodes, edges, 3)[0].select("doc_id", "id", "pos")


@query("merged_graphs", f"""
WITH {_GRAPH}, halves AS (SELECT *, section_index % 2 AS chunk FROM nodes WHERE type <> 'document')
SELECT doc_id, count(*) + 1 + count(DISTINCT chunk) AS nodes, min(CASE WHEN chunk = 0 THEN 1 ELSE 0 END) = 0 AS two FROM halves GROUP BY doc_id
""")
def merged_graphs(spark, sf_dir):
    """Turns of even and of odd number as two chunks, whose graphs become one."""
    _, nodes, edges = _conversation_graph(spark, sf_dir)
    body = nodes.where("type <> 'document'").withColumn("chunk", F.col("section_index") % 2)
    roots = body.select("doc_id", "chunk").distinct().select("doc_id", "chunk", F.lit(-1).cast("bigint").alias("pos"), F.concat(F.lit("chunk:"), "doc_id", F.lit(":"), F.col("chunk").cast("string")).alias("id"), F.lit("chunk").alias("type"))
    parts = roots.unionByName(body.select("doc_id", "chunk", "pos", "id", "type"))
    inside = edges.join(body.select("doc_id", "chunk", F.col("id").alias("target")), ["doc_id", "target"])
    root = nodes.where("type = 'document'").select("doc_id", "pos", "id", "type")
    merged, links = graph.merge_chunks(root, parts, inside)
    chunks = links.where("target LIKE 'chunk:%'").groupBy("doc_id").agg(F.countDistinct("target").alias("chunks"))
    return merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes")).join(chunks, "doc_id").select("doc_id", "nodes", (F.col("chunks") == 2).alias("two"))


@query("item_texts", """
SELECT conv_id, string_agg(text || '|' || role || CASE WHEN turn % 2 = 1 THEN '|' || role || '|' || text || '|' || turn ELSE '' END || CASE WHEN turn % 3 = 0 THEN '|' || text || '|' || role ELSE '' END, chr(10) ORDER BY turn) AS texts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
""")
def item_texts(spark, sf_dir):
    """Texts of a turn's claim, concept and passage in order."""
    text, role, turn = F.col("text"), F.col("role"), F.col("turn").cast("string")
    claims = F.array(F.struct(text.alias("claim"), role.alias("evidence")))
    concepts = F.filter(F.array(F.struct(role.alias("concept"), text.alias("definition"), turn.alias("evidence"))), lambda x: F.col("turn") % 2 == 1)
    passages = F.filter(F.array(F.struct(text.alias("passage"), role.alias("why_it_matters"))), lambda x: F.col("turn") % 3 == 0)
    items = F.struct(claims.alias("claims"), concepts.alias("concepts"), passages.alias("key_passages"))
    said = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(graph.item_texts(items), "|").alias("texts"))
    return chunking.merge_texts(said, "conv_id", "turn", "texts", "\n").withColumnRenamed("text", "texts")


@query("item_scores", f"""
SELECT doc_id, round(0.25 + {_share('text', 18)} + {_share("(lang || ' ' || source)", 28)}, 4) AS claim, round(0.75 + {_share('text', 18)} + {_share('source', 28)}, 4) AS concept, round(0.5 + {_share('source', 18)} + {_share('text', 42)}, 4) AS passage FROM documents
""")
def item_scores(spark, sf_dir):
    text, source = F.col("text"), F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", S.claim_score(F.lit(0.25), text, F.concat_ws(" ", "lang", "source")).alias("claim"), S.concept_score(F.lit(0.75), F.lit(0.5), text, source).alias("concept"), S.passage_score(F.lit(0.5), text, source).alias("passage"))


#: Documents as Markdown with a title, an introduction and two chapters.
_MD = "'Intro of ' || doc_id || chr(10) || '# **' || source || '**' || chr(10) || '## Text' || chr(10) || text || chr(10) || '## About `' || lang || '`' || chr(10) || '![x](images/a.png) [y](images/b.png)' || chr(10)"


def _markdown(spark, sf_dir) -> DataFrame:
    parts = [F.lit("Intro of "), F.col("doc_id").cast("string"), F.lit("\n# **"), "source", F.lit("**\n## Text\n"), "text", F.lit("\n## About `"), "lang", F.lit("`\n![x](images/a.png) [y](images/b.png)\n")]
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(*parts).alias("text"))


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '\\s+$', '')"


@query("chunk_files", f"""
SELECT doc_id, '001_text.md' AS filename, {_stripped("'[Back to full document](../' || doc_id || '.md)' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) || '## Text' || chr(10) || text")} || chr(10) AS content, CAST(2 AS INTEGER) AS chapter_level FROM documents
UNION ALL SELECT doc_id, '002_' || {_SLUG.format(x="('About ' || lang)", n=120)} || '.md', '[Back to full document](../' || doc_id || '.md)' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) || '## About `' || lang || '`' || chr(10) || '![x](../images/a.png) [y](images/b.png)' || chr(10), 2 FROM documents
""")
def chunk_files(spark, sf_dir):
    """Chunk files at the chapter level; no chapter is split, whatever its length, with this splitter."""
    return structure.chunked_documents(_markdown(spark, sf_dir), lambda rows: rows.select("doc_id", F.lit(1).alias("chunk"), "text"))


@query("fact_sections", """
SELECT doc_id, CAST(1 AS INTEGER) AS section_index, 'Document Preamble' AS title, 'Intro of ' || doc_id || chr(10) || '# **' || source || '**' AS text FROM documents
UNION ALL SELECT doc_id, 2, source || ' > Text', '## Text' || chr(10) || text FROM documents
UNION ALL SELECT doc_id, 3, source || ' > About ' || lang, '## About `' || lang || '`' || chr(10) || '![x](images/a.png) [y](images/b.png)' FROM documents
""")
def fact_sections(spark, sf_dir):
    lines = structure.document_lines(_markdown(spark, sf_dir))
    heads = structure.headings(lines)
    return structure.fact_sections(lines, heads, structure.chapter_levels(heads))


@query("listed_levels", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS chapter_level FROM documents")
def listed_levels(spark, sf_dir):
    """Every other document has a list of headings that names one heading of level 1 and two of level 3."""
    docs = _markdown(spark, sf_dir)
    heads = structure.headings(structure.document_lines(docs))
    listed = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("- A (H1, line 1, 9 lines)\n    - B (H3, line 2, 1 lines)\n    - C (h3, Line 4, 1 lines)")).otherwise(F.lit("none")).alias("toc"))
    return structure.chapter_levels(heads, listed)


@query("heading_paths", """
SELECT doc_id, array_to_string(list_concat(['**' || source || '**', 'Text'], list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '#')), lambda x: trim(ltrim(trim(x), '#'))), lambda x: x <> ''), ['About `' || lang || '`']), ' > ') AS path FROM documents
""")
def heading_paths(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", T.heading_path(F.col("text"), F.lit("none")).alias("path"))


@query("front_matters", """
SELECT doc_id, source AS title, lang || ' and x' AS authors, CAST(2 AS INTEGER) AS keys FROM documents
""")
def front_matters(spark, sf_dir):
    """Keys in any case, blank values, and equal keys."""
    text = F.concat(F.lit("---\nTitle: old\nTITLE: '"), "source", F.lit("'\nempty:  \nAuthors: "), "lang", F.lit(" and x\n---\n# **Other**\nBy nobody\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.document_title(text, F.lit("stem")).alias("title"), T.document_authors(text).alias("authors"), F.size(T.front_matter(text)).alias("keys"))


@query("bylines", "SELECT doc_id, source AS title, lang AS byline FROM documents")
def bylines(spark, sf_dir):
    text = F.concat(F.lit("line\n# *"), "source", F.lit("* \n**By** "), "lang", F.lit("\nby other"))
    return table(spark, sf_dir, "documents").select("doc_id", T.first_heading(text).alias("title"), T.byline(text).alias("byline"))


@query("probe_texts", "SELECT doc_id, left(left(text, 20000), 7500) AS probe FROM documents")
def probe_texts(spark, sf_dir):
    """What an embedding is asked for; the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", T.probe_text(F.col("text")).alias("probe"))


@query("merged_texts", "SELECT source, string_agg(lang || ' ' || n, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY lang) AS text FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def merged_texts(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return chunking.merge_by_size(counts.select("source", "lang", F.concat_ws(" ", "lang", F.col("n").cast("string")).alias("line")), "source", "lang", "line")


@query("completions", "SELECT doc_id, CASE WHEN trim(regexp_replace(left(text, greatest(1, length(text) // 2)), '\\s+', ' ', 'g')) = '' THEN NULL ELSE left(text, greatest(1, length(text) // 2)) END AS result FROM documents")
def completions(spark, sf_dir):
    """A model call for each document, by a stand-in that says the first half again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.complete(docs, F.col("text"), models.HalvingCompleter(), retries=1).select("doc_id", "result")


@query("parallel_completions", "SELECT doc_id, CASE WHEN trim(regexp_replace(left(text, greatest(1, length(text) // 2)), '\\s+', ' ', 'g')) = '' THEN NULL ELSE left(text, greatest(1, length(text) // 2)) END AS result FROM documents")
def parallel_completions(spark, sf_dir):
    """The same calls with four under way in each task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.complete(docs, F.col("text"), models.HalvingCompleter(), retries=1, workers=4, deadline=60.0).select("doc_id", "result")


_LETTERS = "[" + ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "aeiou") + ", length(t)]"


@query("indexed_similarities", f"""
WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS after FROM conversations),
v AS (SELECT text, list_transform({_LETTERS}, lambda x: CAST(x AS DOUBLE)) AS v FROM (SELECT DISTINCT text, left(left(text, 20000), 7500) AS t FROM said WHERE trim(text) <> ''))
SELECT conv_id, turn, round(coalesce(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0.0), 6) AS similarity FROM said LEFT JOIN v a USING (text) LEFT JOIN v b ON b.text = said.after
""")
def indexed_similarities(spark, sf_dir):
    """How much each turn is like the next, by an index of all turns' vectors; the last turn is like nothing."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    after = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    index = cut(models.vector_index(said, "text", models.LetterEmbedder()).select("key", "vector"))
    found = models.indexed_similarity(said.withColumn("after", after), "text", "after", index)
    return found.select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query("latest_runs", f"WITH {_RUNS} SELECT doc_name, arg_max(run_id, pos) AS run_id FROM runs GROUP BY doc_name")
def latest_runs(spark, sf_dir):
    return evals.latest_run(_runs(spark, sf_dir).withColumn("mtime", F.col("pos")), ["doc_name"])


@query("against_best", f"""
WITH {_RUNS}, best AS (SELECT doc_name, max(blended) AS old FROM runs WHERE error IS NULL AND run_id <> 'run-2' GROUP BY doc_name)
SELECT doc_name, old, blended AS new, round(blended - old, 6) AS delta FROM runs JOIN best USING (doc_name) WHERE run_id = 'run-2' AND error IS NULL
""")
def against_best(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evals.against_best(runs.where("run_id = 'run-2'"), runs.where("run_id <> 'run-2'")).select("doc_name", "old", "new", F.round("delta", 6).alias("delta"))


@query("delta_rows", f"""
WITH {_RUNS}, d AS (SELECT b.run_id, doc_name, round(b.blended - a.blended, 6) AS delta FROM runs a JOIN runs b USING (doc_name) WHERE a.run_id = 'run-0' AND b.run_id <> 'run-0')
SELECT run_id, doc_name, delta, delta > 0 AS better FROM d UNION ALL SELECT run_id, NULL, round(avg(delta), 6), avg(delta) > 0 FROM d GROUP BY run_id
""")
def delta_rows(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    old = runs.where("run_id = 'run-0'").select("doc_name", F.col("blended").alias("old"))
    deltas = runs.where("run_id <> 'run-0'").join(old, "doc_name").select("run_id", "doc_name", F.round(F.col("blended") - F.col("old"), 6).alias("delta"))
    return evals.delta_summary(deltas, ["run_id"]).withColumn("delta", F.round("delta", 6))


@query("adjudicated_deltas", f"WITH {_RUNS} SELECT doc_name, round(avg(blended), 6) AS delta, abs(avg(blended) - 0.02) <= 0.9 AS near FROM runs GROUP BY doc_name")
def adjudicated_deltas(spark, sf_dir):
    """Means over repeats, and whether they are near a gate."""
    deltas = _runs(spark, sf_dir).withColumnRenamed("blended", "delta").withColumn("all", F.lit(1))
    return evals.adjudicated(deltas, ["all"]).select("doc_name", F.round("delta", 6).alias("delta"), evals.near_gate(F.col("delta"), margin=0.9).alias("near"))


@query("worst_first", f"WITH {_RUNS} SELECT doc_name, blended, row_number() OVER (ORDER BY blended, pos) AS place, least(8, pos % 11) AS missed FROM runs WHERE run_id = 'run-1'")
def worst_first(spark, sf_dir):
    """A run's documents from the lowest score on, each with at most eight of its missed facts."""
    from pyspark.sql import Window

    run = _runs(spark, sf_dir).where("run_id = 'run-1'")
    listed = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i.cast("string"))
    scored = run.withColumn("missed", F.slice(listed, 1, (F.col("pos") % 11).cast("int"))).withColumn("unsupported", F.array().cast("array<string>"))
    listing = evals.worst_first(scored)
    return listing.select("doc_name", "blended", F.row_number().over(Window.orderBy("blended", "pos")).alias("place"), F.size("missed").cast("bigint").alias("missed"))


@query("recent_runs", f"WITH {_RUNS}, k AS (SELECT DISTINCT run_id, doc_name AS kind FROM runs) SELECT run_id, kind FROM k ORDER BY run_id DESC, kind DESC LIMIT 18")
def recent_runs(spark, sf_dir):
    """The last eighteen; the limit is the feature."""
    return evals.recent(_runs(spark, sf_dir).select("run_id", F.col("doc_name").alias("kind")).distinct())


@query("case_statuses", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def case_statuses(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return cases.select("doc_id", evals.case_status(F.col("quality"), F.lit(1)).alias("status"))


@query("zipped", "SELECT doc_id, list_zip(string_split(source, 'r'), string_split(source, 'r'))[1][1] AS first, len(string_split(source, 'r')) AS n FROM documents")
def zipped(spark, sf_dir):
    parts = F.split("source", "r")
    pairs = evals.zip_strict(parts.alias("a"), parts.alias("b"), "parts")
    return table(spark, sf_dir, "documents").select("doc_id", F.split("source", "r")[0].alias("first"), F.size(pairs).cast("bigint").alias("n"))


@query("template_errors", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang' ELSE '' END AS missing, CASE WHEN doc_id % 3 = 0 THEN 'more' ELSE '' END AS unknown FROM documents")
def template_errors(spark, sf_dir):
    """Templates that want a value that isn't given, and values no template wants."""
    template = F.when(F.col("doc_id") % 2 == 0, F.lit("{{text}} {{lang}}")).otherwise(F.lit("{{text}}"))
    given = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("text"), F.lit("more"))).otherwise(F.array(F.lit("text")))
    wrong = T.placeholder_errors(given, T.placeholders(template))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(wrong["missing"], ",").alias("missing"), F.array_join(wrong["unknown"], ",").alias("unknown"))


@query("source_files", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'markdown' WHEN 2 THEN 'pdf' ELSE 'text' END AS format, doc_id % 4 <> 3 AS asset, 'my_' || source || '-' || doc_id AS stem, 'My ' || upper(left(source, 1)) || substr(source, 2) || ' ' || doc_id AS title, source || '/my_' || source || '-' || doc_id AS below FROM documents
""")
def source_files(spark, sf_dir):
    """Formats, stems, titles and relative paths of files named after documents."""
    ending = F.element_at(F.array(*map(F.lit, (".EPUB", ".md", ".pdf", ".Txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("my_"), "source", F.lit("-"), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), name, ending)
    stem = files.stem(path)
    return table(spark, sf_dir, "documents").select(
        "doc_id", files.source_format(path).alias("format"), files.supported(path).alias("asset"), stem.alias("stem"), T.stem_title(stem).alias("title"), F.regexp_replace(T.relative_path(path, F.lit("/data")), r"\.[^.]+$", "").alias("below")
    )


@query("asset_sources", "SELECT 'd' || doc_id AS asset_dir, 'a.md' AS markdown, CASE WHEN doc_id % 3 = 0 THEN 'a.pdf' ELSE 'a.md' END AS original FROM documents")
def asset_sources(spark, sf_dir):
    names = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, ("a.md", "a.pdf", "summary.md")))).otherwise(F.array(*map(F.lit, ("a.md", "headers.md"))))
    return files.asset_sources(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("asset_dir"), F.explode(names).alias("name")))


@query("trusted_corpus", "SELECT 'd' || doc_id AS id, strlen(text) AS size_bytes FROM documents")
def trusted_corpus(spark, sf_dir):
    """Every text as a file whose size and SHA-256 a manifest has."""
    held = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.encode("text", "UTF-8").alias("content"))
    manifest = held.select("id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes"))
    return files.trusted_corpus(manifest, held).select("id", "size_bytes")


@query("environment", "SELECT lower(c_mktsegment) AS key, CAST(max(c_custkey) AS VARCHAR) AS value FROM customer GROUP BY 1")
def environment(spark, sf_dir):
    """Lines of a settings file: exports, quotes and comments; of equal keys the last counts."""
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.concat(F.lit(" export "), F.lower("c_mktsegment"), F.lit(" = '"), F.col("c_custkey").cast("string"), F.lit("'")).alias("text"))
    return files.dotenv(lines.unionByName(lines.withColumn("text", F.concat(F.lit("# "), "text"))))


@query("prompt_versions", "SELECT p_brand AS name, CAST(p_size AS INTEGER) AS number, p_size = max(p_size) OVER (PARTITION BY p_brand) AS is_active FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def prompt_versions(spark, sf_dir):
    offered = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_size").distinct()
    active = offered.groupBy("name").agg(F.format_string("v%03d", F.max("p_size").cast("int")).alias("active"))
    prompts = offered.select("name", F.format_string("v%03d", F.col("p_size").cast("int")).alias("version"), F.lit("t").alias("text")).join(active, "name")
    return files.prompt_versions(prompts).select("name", "number", "is_active")


@query("next_versions", "SELECT p_brand AS name, 'v' || lpad(CAST(max(p_size) + 1 AS VARCHAR), 3, '0') AS version FROM part GROUP BY p_brand")
def next_versions(spark, sf_dir):
    return sinks.next_version(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.format_string("v%03d", F.col("p_size").cast("int")).alias("version")))


@query("present_artifacts", "SELECT 'a' || doc_id AS path FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'manifest.json'")
def present_artifacts(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    there = listed.where("doc_id % 2 = 0").select("path")
    return sinks.present_artifacts(listed.select("path").unionByName(spark.createDataFrame([("manifest.json",)], "path string")), there, "manifest.json")


@query("section_coverage", "SELECT lang AS doc_id, len(list(DISTINCT source)) AS sections, count(*) AS records FROM documents GROUP BY lang")
def section_coverage(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("source").alias("section_path"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    covered = evidence.section_coverage(evidence.summary_plan(records))
    total = F.aggregate(F.map_values("coverage"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return covered.select("doc_id", F.size("coverage").cast("bigint").alias("sections"), total.alias("records"))
