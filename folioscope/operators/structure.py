"""Heading structure of Markdown documents.

Tables: headings (doc_id, line, level, title) with lines from 0; lines (doc_id, line, text).
Windows are partitioned by document, so one document is one task's work and documents are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, text), lines from 0."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.split(F.col(text_col), T.LINE_BREAK, -1).alias("parts"))
    rows = split.select("doc_id", T.without_last_blank(F.col("parts")).alias("parts"))
    # For a plain posexplode a filter on the array's size would be inferred and pushed to the scan, where
    # it splits every text again.
    return rows.select("doc_id", F.posexplode_outer("parts").alias("line", "text")).where(F.col("line").isNotNull())


def headings(lines: DataFrame) -> DataFrame:
    """Heading lines with titles without markup; fences are not looked at."""
    marked = lines.where(F.col("text").startswith("#") & F.col("text").rlike(T.HEADING))
    title = T.strip(T.strip_markup(F.regexp_extract("text", T.HEADING, 2)))
    return marked.select("doc_id", "line", F.length(F.regexp_extract("text", T.HEADING, 1)).alias("level"), title.alias("title"))


def listed_levels(toc: Column) -> Column:
    """Levels named in a list of headings: the first '(H2, line 7' of each line."""
    found = F.transform(T.lines(toc), lambda x: F.regexp_extract(x, r"(?i)\(H([1-6]),\s*line\s+\d+", 1))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int"))


def chapter_levels(heads: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(doc_id, chapter_level): the shallowest level, or the next one if that occurs once only.

    listed (doc_id, toc) holds lists of headings; where one names levels they count instead of the
    document's own. Documents without any level are not in the result. Partially aggregated: one row
    a document and level is shuffled.
    """
    if listed is not None:
        named = listed.select("doc_id", F.explode(listed_levels(F.col("toc"))).alias("level"))
        heads = heads.select("doc_id", "level").join(named.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(named)
    per_level = heads.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    ranked = per_level.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("levels"))  # six levels at most
    first = F.element_at("levels", 1)
    return ranked.select("doc_id", F.when((first["n"] == 1) & (F.size("levels") > 1), F.try_element_at("levels", F.lit(2))["level"]).otherwise(first["level"]).alias("chapter_level"))


def section_lengths(heads: DataFrame, line_counts: DataFrame) -> DataFrame:
    """headings with line_count: lines up to the next heading that is as shallow, at least one."""
    # From the last line back: a frame that reaches to the end would be added up anew for every row.
    after = Window.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)]
    until = F.coalesce(F.element_at(F.array(*nearest), F.col("level")), F.col("total_lines"))
    return heads.join(line_counts, "doc_id").withColumn("line_count", F.greatest(until - F.col("line"), F.lit(1))).drop("total_lines")


def table_of_contents(heads: DataFrame, line_counts: DataFrame) -> DataFrame:
    """(doc_id, toc): an indented line for each heading with its line and length."""
    entry = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.format_string("- %s (H%d, line %d, %d lines)", T.strip_markup(F.col("title")), F.col("level"), F.col("line") + 1, F.col("line_count")))
    sized = section_lengths(heads, line_counts).select("doc_id", "line", entry.alias("entry"))
    return sized.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "entry"))), lambda x: x["entry"]), "\n").alias("toc"))


def open_parents(heads: DataFrame) -> DataFrame:
    """headings with parents (level, title): for each shallower level the last heading that is still open."""
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 6)
    last = [F.max(F.when(F.col("level") == k, F.struct("line", "title"))).over(before) for k in levels]
    shut = [F.max(F.when(F.col("level") < k, F.col("line"))).over(before) for k in levels]
    still = [F.when((F.lit(k) < F.col("level")) & (F.coalesce(s, F.lit(-1)) < p["line"]), F.struct(F.lit(k).alias("level"), p["title"].alias("title"))) for k, p, s in zip(levels, last, shut, strict=True)]
    return heads.withColumn("parents", F.array_compact(F.array(*still)))


def earlier_shallower(heads: DataFrame) -> DataFrame:
    """headings with title_path: the titles of all earlier headings of lower level, then the own one.

    This is not the chain of open parents: closed headings stay in the path.
    """
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("level", "title")).over(before)
    names = F.transform(F.filter(earlier, lambda h: h["level"] < F.col("level")), lambda h: h["title"])
    return heads.withColumn("title_path", F.array_join(F.concat(names, F.array("title")), " > "))


def segments(lines: DataFrame, heads: DataFrame, levels: DataFrame) -> DataFrame:
    """lines with segment: 0 before the first chapter heading, then the chapter's number."""
    starts = heads.join(levels, "doc_id").where(F.col("level") == F.col("chapter_level")).select("doc_id", "line", F.lit(1).alias("starts"))
    marked = lines.join(starts, ["doc_id", "line"], "left")
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("segment", F.sum(F.coalesce("starts", F.lit(0))).over(upto)).drop("starts")


def _joined(rows: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("doc_id", "segment").agg(F.min("line").alias("line"), text.alias("text"))


def chapters(lines: DataFrame, heads: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, segment, line, text, title, parents); lines before the first chapter are left out."""
    found = _joined(segments(lines, heads, levels).where("segment > 0"))
    return found.join(open_parents(heads).select("doc_id", "line", "title", "parents"), ["doc_id", "line"])


def fact_sections(lines: DataFrame, heads: DataFrame, levels: DataFrame, whole_title: str = "Full document") -> DataFrame:
    """(doc_id, section_index, title, text): chapters with a preamble that isn't blank, stripped;
    documents without headings are one section."""
    found = _joined(segments(lines, heads, levels)).where((F.col("segment") > 0) | (T.strip(F.col("text")) != ""))
    named = found.join(earlier_shallower(heads).select("doc_id", "line", "title_path"), ["doc_id", "line"], "left")
    title = F.when(F.col("segment") == 0, F.when(F.col("has_chapters"), F.lit("Document Preamble")).otherwise(F.lit(whole_title))).otherwise(F.col("title_path"))
    every = Window.partitionBy("doc_id")
    order = Window.partitionBy("doc_id").orderBy("segment")
    return named.withColumn("has_chapters", F.max("segment").over(every) > 0).select("doc_id", F.row_number().over(order).alias("section_index"), title.alias("title"), F.when((F.col("segment") == 0) & F.col("has_chapters"), T.strip(F.col("text"))).otherwise(F.col("text")).alias("text"))


def chapter_files(found: DataFrame, doc_name: Column) -> DataFrame:
    """chapters with filename and content: a back link, the open parents' heading lines, the text.

    found has (doc_id, segment, part, parts, title, parents, text); the number runs over the parts
    of all chapters of a document.
    """
    order = Window.partitionBy("doc_id").orderBy("segment", "part")
    number = F.row_number().over(order)
    part = F.when(F.col("parts") > 1, F.concat(F.lit("_part_"), F.col("part").cast("string"))).otherwise("")
    above = F.array_join(F.transform("parents", lambda p: F.concat(F.repeat(F.lit("#"), p["level"]), F.lit(" "), p["title"])), "\n")
    content = chunk_content(doc_name, above, F.col("text"))
    return found.withColumn("filename", F.format_string("%03d_%s%s.md", number, T.slug(F.col("title")), part)).withColumn("content", content)


def chunk_content(doc_name: Column, above: Column, text: Column) -> Column:
    """The text of a chunk's file: one newline at its end, images found from the folder below."""
    whole = F.concat_ws("\n\n", F.concat(F.lit("[Back to full document](../"), doc_name, F.lit(")")), F.nullif(above, F.lit("")), text)
    return T.chunk_image_paths(F.concat(F.regexp_replace(whole, rf"{T.SPACE}+$", ""), F.lit("\n")))


def plain_files(parts: DataFrame, doc_name: Column) -> DataFrame:
    """Files of documents without chapters: parts (doc_id, part, text) named by their first words."""
    named = F.format_string("%03d_%s.md", "part", T.first_line_slug(F.col("text")))
    return parts.withColumn("filename", named).withColumn("content", chunk_content(doc_name, F.lit(""), F.col("text")))


def chunked_documents(docs: DataFrame, split, listed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, filename, content, chapter_level): every document's chunk files.

    A document is split at the chapter level that its list of headings names; if the text has no
    heading of that level, at the level of its own headings; without any, as a whole, and the level
    is null. split turns rows (doc_id, text) into (doc_id, chunk, text) and divides what is too long.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = document_lines(docs)
    heads = headings(lines)
    own = chapter_levels(heads)
    levels = own
    if listed is not None:
        usable = chapter_levels(heads, listed).join(heads.select("doc_id", F.col("level").alias("chapter_level")).distinct(), ["doc_id", "chapter_level"])
        levels = usable.unionByName(own.join(usable, "doc_id", "left_anti"))
    found = chapters(lines, heads, levels)
    # The parts of a chapter: one key for both columns, so split sees rows of (doc_id, text).
    keyed = found.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("segment").cast("string")))
    parts = split(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("chunk").alias("part"), F.col("text").alias("piece"))
    counted = parts.groupBy("key").agg(F.max("part").alias("parts"))
    placed = keyed.drop("text").join(parts, "key").join(counted, "key").withColumnRenamed("piece", "text")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    structured = chapter_files(placed, name).join(levels, "doc_id").select("doc_id", "filename", "content", "chapter_level")
    bare = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    kind = docs.schema["doc_id"].dataType
    whole = plain_files(split(bare).withColumnRenamed("chunk", "part"), name).select(F.col("doc_id").cast(kind).alias("doc_id"), "filename", "content", F.lit(None).cast("int").alias("chapter_level"))
    return structured.unionByName(whole)


def synthetic_books(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title): one book a source, its languages as parts and documents as chapters.

    doc_id is the source; it stands in for documents with headings, which the plain table has none of.
    """
    # lag over the book's own order finds where a language starts; the first row also opens the book.
    order = Window.partitionBy("source").orderBy("lang", "doc_id")
    new = F.lag("lang").over(order)
    row = docs.where(F.col("source").isNotNull()).select("source", "lang", "doc_id", new.isNull().alias("first"), (new.isNull() | (new != F.col("lang"))).alias("opens"))
    entry = F.filter(
        F.array(
            F.when(F.col("first"), F.struct(F.lit(1).alias("level"), F.col("source").alias("title"))),
            F.when(F.col("opens"), F.struct(F.lit(2).alias("level"), F.concat(F.lit("Part "), F.col("lang")).alias("title"))),
            F.struct(F.lit(3).alias("level"), F.concat(F.lit("Text "), F.col("doc_id").cast("string")).alias("title")),
        ),
        lambda x: x.isNotNull(),
    )
    exploded = row.select("source", "lang", "doc_id", F.explode(entry).alias("h"))
    line = Window.partitionBy("source").orderBy("lang", "doc_id", F.col("h.level"))
    return exploded.select(F.col("source").alias("doc_id"), (F.row_number().over(line) - 1).cast("bigint").alias("line"), F.col("h.level").alias("level"), F.col("h.title").alias("title"))
