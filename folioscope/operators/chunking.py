"""Splitting and packing in order: folds over one document's array, never across documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.functions.text import token_estimate

#: Tokens of a chunk, characters of a paragraph, slack of the last chunk, window.
MIN_TOKENS, MAX_TOKENS, MIN_CHARS, TAIL_SLACK, WINDOW = 1000, 12_000, 200, 1.2, 2
#: Characters and tokens of a text that an embedding is asked for; without a tokenizer a
#: character counts as a token.
PROBE_CHARS, PROBE_TOKENS = 20_000, 7_500
#: Items and tokens of an embedding batch, characters for a token, items judged at once.
BATCH_ITEMS, BATCH_TOKENS, TOKEN_CHARS, JUDGED = 96, 250_000, 3, 10
_FENCE = re.compile(r"`{3,}|~{3,}")


def paragraphs_of(text: str) -> list[str]:
    """Blocks between blank lines; a fenced block is never cut, however far it is indented.

    A fence closes with a line of its own character, at least as long, with nothing behind it.
    """
    blocks: list[str] = []
    held: list[str] = []
    fence = ""
    for line in text.splitlines():
        bare = line.strip()
        if fence:
            if len(bare) >= len(fence) and set(bare) == {fence[0]}:
                fence = ""
        elif mark := _FENCE.match(bare):
            fence = mark[0]
        elif not bare:
            if held:
                blocks.append("\n".join(held))
                held = []
            continue
        held.append(line)
    if held:
        blocks.append("\n".join(held))
    return blocks


def paragraphs(texts: Column) -> Column:
    """paragraphs_of as a column, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def split(t: pd.Series) -> pd.Series:
        return t.map(lambda x: paragraphs_of(x or ""))

    return split(texts)


def merge_small(items: Column, least: int = MIN_CHARS) -> Column:
    """Paragraphs joined until each has so many characters; a short rest goes to the last one."""
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))
    glue = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))
    step = lambda s, x: F.when(
        F.length(glue(s["held"], x)) >= least,
        F.struct(F.lit("").alias("held"), F.array_append(s["done"], glue(s["held"], x)).alias("done")),
    ).otherwise(F.struct(glue(s["held"], x).alias("held"), s["done"].alias("done")))
    end = lambda s: F.when(s["held"] == "", s["done"]).when(F.size(s["done"]) == 0, F.array(s["held"])).otherwise(
        F.array_append(F.slice(s["done"], 1, F.size(s["done"]) - 1), glue(F.element_at(s["done"], -1), s["held"]))
    )
    return F.aggregate(items, start, step, end)


def boundary_similarities(rows: DataFrame, group: str, position: str, vector: str, size: int, window: int = WINDOW) -> DataFrame:
    """(group, position, similarity): cosine of the means of up to window vectors on either side of
    the boundary after a position; the last position has none."""
    order = Window.partitionBy(group).orderBy(position)
    back = F.collect_list(vector).over(order.rowsBetween(1 - window, 0))
    ahead = F.collect_list(vector).over(order.rowsBetween(1, window))
    both = rows.select(group, position, back.alias("back"), ahead.alias("ahead")).where(F.size("ahead") > 0)
    return both.select(group, position, F.round(V.cosine(V.mean(F.col("back")), V.mean(F.col("ahead"))), 6).alias("similarity"))


def cuts_of(tokens: list[int], similarities: list[float], least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[int]:
    """Boundaries (number of items before each): the weakest one within budget, first if equal.

    From a start, items are taken while they fit; the cut is where similarity is lowest among the
    boundaries at which the chunk is long enough, else just before what doesn't fit.
    """
    cuts: list[int] = []
    start = 0
    while start < len(tokens):
        total, end, choices = 0, start, []
        while end < len(tokens) and (end == start or total + tokens[end] <= most):
            total += tokens[end]
            end += 1
            if total >= least and end < len(tokens):
                choices.append(end)
        if end == len(tokens):
            break
        start = min(choices, key=lambda e: similarities[e - 1]) if choices else end
        cuts.append(start)
    return cuts


def chunk_runs(items: list[str], cuts: list[int], least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[str]:
    """Items joined between cuts; a last chunk that is too short joins the one before if both fit."""
    edges = [0, *cuts, len(items)]
    chunks = ["\n\n".join(items[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    if len(chunks) > 1 and len(chunks[-1]) // 4 < least and (len(chunks[-2]) + 2 + len(chunks[-1])) // 4 <= most * TAIL_SLACK:
        chunks[-2:] = ["\n\n".join(chunks[-2:])]
    return chunks


def semantic_chunks(docs: DataFrame, embed, least: int = MIN_TOKENS, most: int = MAX_TOKENS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, text). embed maps a document's paragraphs to vectors in one call.

    A text within budget, or of one paragraph, stays as it is.
    """
    import numpy as np

    def split(text: str) -> list[str]:
        items = paragraphs_of(text)
        if len(text) // 4 <= most or len(items) < 2:
            return [text]
        merged: list[str] = []
        held = ""
        for p in items:
            held = f"{held}\n\n{p}" if held else p
            if len(held) >= MIN_CHARS:
                merged.append(held)
                held = ""
        if held:
            merged[-1:] = [f"{merged[-1]}\n\n{held}"] if merged else [held]
        v = np.array(embed([m[:PROBE_CHARS][:PROBE_TOKENS] for m in merged]), float)
        near = []
        for i in range(1, len(merged)):
            a, b = v[max(0, i - window) : i].mean(axis=0), v[i : i + window].mean(axis=0)
            size = float(np.linalg.norm(a) * np.linalg.norm(b))
            near.append(float(a @ b) / size if size else 0.0)
        return chunk_runs(merged, cuts_of([len(m) // 4 for m in merged], near, least, most), least, most)

    def run(batches):
        for b in batches:
            out = [(i, n, c) for i, t in zip(b["doc_id"], b["text"], strict=True) for n, c in enumerate(split(t or ""), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, chunk int, text string")


def valley_cuts(rows: DataFrame, group: str, tokens: str, similarities: str, least: int, most: int) -> DataFrame:
    """(group, cuts) from arrays of tokens and boundary similarities."""

    @F.pandas_udf("array<int>")
    def cut(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([cuts_of(list(a), list(b), least, most) for a, b in zip(t, s, strict=True)])

    return rows.select(group, cut(F.col(tokens), F.col(similarities)).alias("cuts"))


def pack(sizes: Column, most: int, items: int = 1 << 30) -> Column:
    """A bucket number for each size: a new bucket where the sum or the count would pass its limit;
    a size beyond the limit has a bucket of its own."""

    @F.pandas_udf("array<int>")
    def run(every: pd.Series) -> pd.Series:
        return every.map(lambda x: buckets_of([] if x is None else x, most, items))

    return run(sizes)


def buckets_of(sizes, most: int, items: int = 1 << 30) -> list[int]:
    """pack for one list, in one pass."""
    out: list[int] = []
    n = total = bucket = 0
    for size in map(int, sizes):
        if n and (n >= items or total + size > most):
            bucket, n, total = bucket + 1, 0, 0
        n, total = n + 1, total + size
        out.append(bucket)
    return out


def batches_of(texts: list[str], items: int = BATCH_ITEMS, tokens: int = BATCH_TOKENS) -> list[list[str]]:
    """Texts in batches by count and estimated tokens."""
    out: list[list[str]] = []
    for text, bucket in zip(texts, buckets_of([len(t) // 4 for t in texts], tokens, items), strict=True):
        if bucket == len(out):
            out.append([])
        out[bucket].append(text)
    return out


def context_parts(docs: DataFrame, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, text): lines packed into parts of max_tokens times three characters."""
    lines = F.split(F.col(text_col), "\n", -1)
    sized = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    packed = sized.select("doc_id", F.posexplode(F.arrays_zip("lines", pack(F.transform("lines", lambda x: F.length(x) + 1), max_tokens * TOKEN_CHARS).alias("part"))).alias("line", "x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("x.lines").alias("text")))), lambda x: x["text"]), "\n")
    return packed.groupBy("doc_id", F.col("x.part").alias("part")).agg(text.alias("text"))


def embedding_batches(texts: Column, items: int = BATCH_ITEMS, tokens: int = BATCH_TOKENS) -> Column:
    """Batch numbers for texts to embed, by count and estimated tokens."""
    return pack(F.transform(texts, token_estimate), tokens, items)


def fixed_batches(rows: DataFrame, group: list[str], order: list[str], size: int = JUDGED) -> DataFrame:
    """rows with batch and place, both from 0."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("at", at).withColumn("batch", F.floor(F.col("at") / size).cast("int")).withColumn("place", F.col("at") % size).drop("at")


def round_robin(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first item of every group, then the second, and so on, up to limit; with turn and pos.

    A group cannot give more than limit items, which the rank pushes into each partition, and the
    final sort is a top-k.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    top = rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("turn", group)))


def audio_windows(duration: Column, width: int = 4800) -> Column:
    """(start, length) of the fixed windows of a recording; the last is shorter."""
    n = F.ceil(duration / width).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * width).cast("double").alias("start"), F.least(F.lit(float(width)), duration - i * width).alias("length")))


def merge_by_size(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, text): texts in order with a rule between them."""
    return merge_texts(rows, group, order, text, "\n\n---\n\n")


def merge_texts(rows: DataFrame, group: str, order: str, text: str, between: str) -> DataFrame:
    """(group, text): a group's texts in order, joined."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("x")))), lambda i: i["x"]), between)
    return rows.groupBy(group).agg(joined.alias("text"))
