"""Queries of text functions, structure and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunking, packing, evals, structure
from folioscope.plans.catalogue import query
from folioscope.sources.html import html_to_markdown

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_LINE = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


#: Tables with texts, whose work is in each row.
_TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts from fewer splits than there are cores are dealt to all of them first: a file of one
    row group is one task's work otherwise. Large tables have more splits and stay as they are."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in _TEXTS and found.rdd.getNumPartitions() < cores else found


@query("line_counts", f"""
SELECT doc_id, CAST(line - 1 AS INTEGER) AS line, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) // 4 AS BIGINT) AS tokens,
       CAST(CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS BIGINT) AS words
FROM (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS line FROM (
  SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
""")
def line_counts(spark, sf_dir):
    lines = structure.document_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line", F.length("text").alias("chars"), T.token_estimate(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words"))


_BOOK = """
book AS (
  SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc, level) - 1 AS line, level, title FROM (
    SELECT source, lang, doc_id AS doc, 3 AS level, 'Text ' || doc_id AS title FROM documents
    UNION ALL SELECT source, lang, min(doc_id), 2, 'Part ' || lang FROM documents GROUP BY source, lang
    UNION ALL SELECT source, lang, doc_id, 1, source FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS n FROM documents) WHERE n = 1))
"""


def _book(spark, sf_dir):
    return structure.synthetic_books(table(spark, sf_dir, "documents"))


@query("chapter_level", f"""
WITH {_BOOK}, counts AS (SELECT doc_id, level, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS r FROM book GROUP BY doc_id, level)
SELECT a.doc_id, CASE WHEN a.n = 1 AND b.level IS NOT NULL THEN b.level ELSE a.level END AS chapter_level
FROM counts a LEFT JOIN counts b ON a.doc_id = b.doc_id AND b.r = 2 WHERE a.r = 1
""")
def chapter_level(spark, sf_dir):
    return structure.chapter_levels(_book(spark, sf_dir))


@query("section_lengths", f"""
WITH {_BOOK}, totals AS (SELECT doc_id, max(line) + 1 AS total FROM book GROUP BY doc_id)
SELECT b.doc_id, b.line, b.level, greatest(1, coalesce(CASE b.level WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END, total) - b.line) AS line_count
FROM (SELECT *, min(CASE WHEN level <= 1 THEN line END) OVER after AS n1, min(CASE WHEN level <= 2 THEN line END) OVER after AS n2, min(line) OVER after AS n3 FROM book
      WINDOW after AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) b JOIN totals USING (doc_id)
""")
def section_lengths(spark, sf_dir):
    book = _book(spark, sf_dir)
    totals = book.groupBy("doc_id").agg((F.max("line") + 1).alias("total_lines"))
    return structure.section_lengths(book, totals).select("doc_id", "line", "level", "line_count")


@query("table_of_contents", f"""
WITH {_BOOK}, totals AS (SELECT doc_id, max(line) + 1 AS total FROM book GROUP BY doc_id),
sized AS (SELECT b.*, greatest(1, coalesce(CASE b.level WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END, total) - b.line) AS line_count
  FROM (SELECT *, min(CASE WHEN level <= 1 THEN line END) OVER after AS n1, min(CASE WHEN level <= 2 THEN line END) OVER after AS n2, min(line) OVER after AS n3 FROM book
        WINDOW after AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) b JOIN totals USING (doc_id))
SELECT doc_id, string_agg(repeat('  ', CAST(level - 1 AS INTEGER)) || '- ' || title || ' (H' || level || ', line ' || (line + 1) || ', ' || line_count || ' lines)', chr(10) ORDER BY line) AS toc FROM sized GROUP BY doc_id
""")
def table_of_contents(spark, sf_dir):
    book = _book(spark, sf_dir)
    totals = book.groupBy("doc_id").agg((F.max("line") + 1).alias("total_lines"))
    return structure.table_of_contents(book, totals)


@query("open_parents", f"""
WITH {_BOOK}
SELECT doc_id, line, level, array_to_string(list_filter([CASE WHEN level > 1 THEN p1 END, CASE WHEN level > 2 AND l2 > coalesce(l1, -1) THEN p2 END], lambda x: x IS NOT NULL), ' > ') AS parents FROM (
  SELECT *, arg_max(title, line) FILTER (WHERE level = 1) OVER before AS p1, max(line) FILTER (WHERE level = 1) OVER before AS l1,
         arg_max(title, line) FILTER (WHERE level = 2) OVER before AS p2, max(line) FILTER (WHERE level = 2) OVER before AS l2
  FROM book WINDOW before AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")
def open_parents(spark, sf_dir):
    return structure.open_parents(_book(spark, sf_dir)).select("doc_id", "line", "level", F.array_join(F.transform("parents", lambda p: p["title"]), " > ").alias("parents"))


@query("section_title_paths", f"""
WITH {_BOOK}
SELECT h.doc_id, h.line, array_to_string(list_append(coalesce((SELECT list(p.title ORDER BY p.line) FROM book p WHERE p.doc_id = h.doc_id AND p.line < h.line AND p.level < h.level), []), h.title), ' > ') AS title_path
FROM book h WHERE h.level <= 2
""")
def section_title_paths(spark, sf_dir):
    return structure.earlier_shallower(_book(spark, sf_dir).where("level <= 2")).select("doc_id", "line", "title_path")


@query("chapter_segments", f"""
WITH {_BOOK}
SELECT doc_id, segment, count(*) AS lines, min(line) AS first_line FROM (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS segment FROM book) GROUP BY doc_id, segment
""")
def chapter_segments(spark, sf_dir):
    book = _book(spark, sf_dir)
    lines = book.select("doc_id", "line", F.col("title").alias("text"))
    cut = structure.segments(lines, book, structure.chapter_levels(book))
    return cut.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first_line"))


_SLUG = r"""coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({x}, '\*\*|__|\*|_|`', '', 'g')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}-]', '', 'g'), '[\s\p{{Z}}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), {n}), ''), 'section')"""


@query("slugs", f"""
SELECT doc_id, {_SLUG.format(x='text', n=120)} AS slug,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72), '^-+|-+$', '', 'g'), ''), 'item') AS ascii_slug,
  CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 120 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE rtrim(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 119)) || '...' END AS trimmed
FROM documents
""")
def slugs(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(text).alias("slug"), T.ascii_slug(text, 72).alias("ascii_slug"), T.trim_text(F.col("text"), 120).alias("trimmed"))


@query("canonical_names", r"""
SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(array_to_string(list_filter([trim(p_brand), trim(p_type)], lambda x: x <> ''), '_')), '[^\p{L}\p{N}_\s\p{Z}-]', '', 'g'), '[\s\p{Z}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 150), ''), 'document') AS name FROM part
""")
def canonical_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_name([F.col("p_brand"), F.col("p_type")]).alias("name"))


@query("term_scores", f"""
SELECT doc_id, CAST(len(terms) AS INTEGER) AS n_terms, round(least(1.0, len(terms) / 18), 4) AS specificity, round(least(1.0, len(terms) / 28), 4) AS density
FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda w: w NOT IN ({_STOP}))) AS terms FROM documents)
""")
def term_scores(spark, sf_dir):
    n = F.size(T.terms(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_terms"), F.round(F.least(F.lit(1.0), n / 18), 4).alias("specificity"), F.round(F.least(F.lit(1.0), n / 28), 4).alias("density"))


@query("entities_dates_quantities", r"""
SELECT doc_id,
  CAST(len(list_distinct(list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*\b'), lambda x: length(x) > 1))) AS INTEGER) AS n_entities,
  CAST(len(list_distinct(list_concat(regexp_extract_all(text, '\b(?:1[6-9]\d{2}|20\d{2}|21\d{2})\b'), regexp_extract_all(text, '\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b')))) AS INTEGER) AS n_dates,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d+(?:\.\d+)?%?|\b\d+/\d+\b'))), ' ') AS quantities
FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM documents)
""")
def entities_dates_quantities(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.entities(text)).alias("n_entities"), F.size(T.dates(text)).alias("n_dates"), F.array_join(F.array_sort(T.quantities(text)), " ").alias("quantities"))


@query("redacted_messages")
def redacted_messages(spark, sf_dir):
    """Look-behind has no form in the other engine's patterns."""
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("message"))


@query("pages_markdown")
def pages_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_to_markdown(F.col("html")).alias("markdown"))


@query("page_sections")
def page_sections(spark, sf_dir):
    """Pages to Markdown, headings, chapter level, sections, and each page's section with most terms."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html_to_markdown(F.col("html")).alias("text"))
    lines = structure.document_lines(pages)
    heads = structure.headings(lines)
    sections = structure.fact_sections(lines, heads, structure.chapter_levels(heads))
    sized = sections.withColumn("n_terms", F.size(T.terms(F.col("text"))))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_terms"), "section_index"))
    return sized.withColumn("n", best).where("n = 1").select("doc_id", "section_index", "title", "n_terms")


@query("duplicate_slugs", r"""
SELECT doc_id, slug, row_number() OVER (PARTITION BY source, slug ORDER BY doc_id) AS suffix FROM (
  SELECT doc_id, source, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72), '^-+|-+$', '', 'g'), ''), 'item') AS slug FROM documents)
""")
def duplicate_slugs(spark, sf_dir):
    from folioscope.operators.graph import duplicate_suffix

    docs = table(spark, sf_dir, "documents")
    return duplicate_suffix(docs, ["source"], T.ascii_slug(F.col("text"), 72), ["doc_id"]).select("doc_id", "slug", "suffix")


@query("round_robin_facts", r"""
WITH turns AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents),
taken AS (SELECT *, row_number() OVER (ORDER BY turn, source) AS pos FROM turns QUALIFY pos <= 40),
keyed AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM taken)
SELECT pos, doc_id, source FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1
""")
def round_robin_facts(spark, sf_dir):
    """The limit is the feature: forty facts in turns, then made distinct."""
    top = chunking.round_robin(table(spark, sf_dir, "documents"), "source", ["doc_id"], evals.FACT_LIMIT)
    return evals.distinct_facts(top.withColumn("all", F.lit(1)), ["all"], "text", ["pos"]).select("pos", "doc_id", "source")


@query("fixed_batches", """
SELECT doc_id, CAST(floor(n / 10) AS INTEGER) AS batch, CAST(n % 10 AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
""")
def fixed_batches(spark, sf_dir):
    return chunking.fixed_batches(table(spark, sf_dir, "documents"), ["source"], ["doc_id"]).select("doc_id", "batch", F.col("place").cast("int").alias("place"))


_PACK = """
WITH RECURSIVE items AS (SELECT source, doc_id, {size} AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
fold AS (
  SELECT source, doc_id, n, size AS total, 1 AS items, 0 AS bucket FROM items WHERE n = 1
  UNION ALL
  SELECT i.source, i.doc_id, i.n, CASE WHEN f.items >= {most} OR f.total + i.size > {limit} THEN i.size ELSE f.total + i.size END,
         CASE WHEN f.items >= {most} OR f.total + i.size > {limit} THEN 1 ELSE f.items + 1 END,
         f.bucket + CASE WHEN f.items >= {most} OR f.total + i.size > {limit} THEN 1 ELSE 0 END
  FROM fold f JOIN items i ON i.source = f.source AND i.n = f.n + 1)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket FROM fold
"""


@query("packed_batches", _PACK.format(size="length(text) // 4", most=96, limit=20000))
def packed_batches(spark, sf_dir):
    """Embedding batches of each source: 96 texts or 20,000 tokens. A fold over one source's sizes, of
    which only the numbers are gathered."""
    sized = table(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("size"))
    listed = sized.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size"))).alias("x"))
    packed = listed.select(F.posexplode(F.arrays_zip(F.transform("x", lambda i: i["doc_id"]).alias("doc_id"), chunking.pack(F.transform("x", lambda i: i["size"]), 20_000, 96).alias("bucket"))).alias("p", "z"))
    return packed.select("z.doc_id", "z.bucket")


@query("packed_sequence", """
WITH RECURSIVE items AS (SELECT doc_id, coalesce(length(text) // 4, 0) AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
fold AS (
  SELECT doc_id, n, size AS total, 1 AS items, 0 AS bucket FROM items WHERE n = 1
  UNION ALL
  SELECT i.doc_id, i.n, CASE WHEN f.items >= 96 OR f.total + i.size > 20000 THEN i.size ELSE f.total + i.size END, CASE WHEN f.items >= 96 OR f.total + i.size > 20000 THEN 1 ELSE f.items + 1 END, f.bucket + CASE WHEN f.items >= 96 OR f.total + i.size > 20000 THEN 1 ELSE 0 END
  FROM fold f JOIN items i ON i.n = f.n + 1)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket FROM fold
""")
def packed_sequence(spark, sf_dir):
    """Embedding batches of all documents as one sequence, by pointers and ranges: no task holds it."""
    sized = table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("size"))
    return packing.packed(sized, [], [F.col("doc_id")], F.col("size"), 20_000, 96).select("doc_id", "bucket")


@query("context_parts", """
WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(parts, 1) AS n, length(unnest(parts)) + 1 AS size FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
fold AS (
  SELECT doc_id, n, size AS total, 0 AS part FROM lines WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN f.total + l.size > 1500 THEN l.size ELSE f.total + l.size END, f.part + CASE WHEN f.total + l.size > 1500 THEN 1 ELSE 0 END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(sum(l.size) - 1 AS INTEGER) AS chars FROM fold f JOIN lines l USING (doc_id, n) GROUP BY doc_id, part
""")
def context_parts(spark, sf_dir):
    return chunking.context_parts(table(spark, sf_dir, "documents"), 500).select("doc_id", "part", F.length("text").alias("chars"))


@query("merged_paragraphs", """
WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(parts, 1) AS n, length(unnest(parts)) AS size FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS parts FROM documents)),
ends AS (SELECT doc_id, max(n) AS last FROM lines GROUP BY doc_id),
fold AS (
  SELECT doc_id, n, size AS held, CASE WHEN size >= 200 THEN 1 ELSE 0 END AS closes FROM lines WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN f.closes = 1 THEN l.size ELSE f.held + 2 + l.size END, CASE WHEN CASE WHEN f.closes = 1 THEN l.size ELSE f.held + 2 + l.size END >= 200 THEN 1 ELSE 0 END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT doc_id, CAST(greatest(1, sum(closes)) AS INTEGER) AS blocks, CAST(max(last) AS INTEGER) AS paragraphs FROM fold JOIN ends USING (doc_id) GROUP BY doc_id
""")
def merged_paragraphs(spark, sf_dir):
    items = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    return table(spark, sf_dir, "documents").where(F.size(items) > 0).select("doc_id", F.size(chunking.merge_small(items)).alias("blocks"), F.size(items).alias("paragraphs"))


@query("quantile_sample", """
WITH ranked AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS total FROM documents)
SELECT doc_id, n_chars, rank FROM ranked WHERE rank IN (SELECT (i * (total - 1)) // 11 FROM range(12) t(i))
""")
def quantile_sample(spark, sf_dir):
    return evals.quantile_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 12).select("doc_id", "n_chars", "rank")


@query("template_rendering", """
SELECT doc_id, 'Doc ' || doc_id || ' in ' || lang || ': ' || text || ' / ' || lang || '.' AS prompt FROM documents
""")
def template_rendering(spark, sf_dir):
    template = F.lit("Doc {{doc}} in {{lang}}: {{text}} / {{lang}}.")
    values = F.create_map(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.render(template, values).alias("prompt"))


@query("content_keys", """
SELECT doc_id, sha256(text) AS sha256, left(md5(source || '/' || doc_id), 12) AS work_key FROM documents
""")
def content_keys(spark, sf_dir):
    from folioscope.sources.sinks import work_key

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), work_key(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("work_key"))


@query("numbered_lists", """
SELECT source, string_agg(n || '. ' || doc_id, chr(10) ORDER BY n) AS listing FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY source
""")
def numbered_lists(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return listed.select("source", T.numbered(F.transform("ids", lambda x: x.cast("string"))).alias("listing"))


@query("author_lists", r"""
SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(regexp_replace(c_name || ' and ' || c_mktsegment || ', ', '\s+and\s+', ',', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), ', ') AS authors FROM customer
""")
def author_lists(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.authors_for_display(F.concat("c_name", F.lit(" and "), "c_mktsegment", F.lit(", "))).alias("authors"))
