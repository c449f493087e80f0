"""Model calls behind small interfaces, with deterministic stand-ins, and what is built on them.

A call is one row of a mapped batch: it returns a result or an error, never fails the job, and its
position travels with it. Real clients are objects with the same methods that can be pickled.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.operators import chunking, evals, parallel
from folioscope.operators.grouped import in_groups

#: Tries of a call, rounds of compression.
RETRIES, ROUNDS = 6, 8


class Completer(Protocol):
    def complete(self, prompt: str, model: str, max_tokens: int) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]: ...


class Transcriber(Protocol):
    def transcribe(self, audio: bytes, model: str) -> dict: ...


@dataclass(frozen=True)
class RoutedCompleter:
    """Answers by the first marker found in the prompt; else the prompt's last line."""

    answers: tuple[tuple[str, str], ...] = ()

    def complete(self, prompt: str, model: str, max_tokens: int) -> str:
        for marker, answer in self.answers:
            if marker in prompt:
                return answer
        return prompt.strip().rsplit("\n", 1)[-1]


@dataclass(frozen=True)
class HalvingCompleter:
    """The first half of what it is given: a summary that always gets shorter."""

    def complete(self, prompt: str, model: str, max_tokens: int) -> str:
        return prompt[: max(1, len(prompt) // 2)]


@dataclass(frozen=True)
class TermEmbedder:
    """Counts of the batch's terms: vectors of one batch can be compared with each other only."""

    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]:
        found = [re.findall("[a-z]+", t.lower()) for t in texts]
        place = {w: i for i, w in enumerate(sorted({w for f in found for w in f}))}
        out = np.zeros((len(texts), len(place)))
        for row, f in zip(out, found, strict=True):
            np.add.at(row, [place[w] for w in f], 1)
        return out.tolist()


@dataclass(frozen=True)
class LetterEmbedder:
    """How often a text has each of some letters, and its length: the same in any batch."""

    letters: str = "aeiou"

    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]:
        return [[*(float(t.count(c)) for c in self.letters), float(len(t))] for t in texts]


@dataclass(frozen=True)
class FixedTranscriber:
    """One segment for any audio."""

    text: str = "speech"

    def transcribe(self, audio: bytes, model: str) -> dict:
        return {"text": self.text, "segments": [{"text": self.text, "start": 1.0, "end": 2.0}], "duration": 5.0}


def retried(call: Callable[[], object], retries: int = RETRIES, wait: float = 0.0) -> tuple:
    """What a call returns, or None and the last error."""
    error = "no answer"
    for n in range(retries):
        try:
            return call(), None
        except Exception as e:  # whatever a client raises becomes a row's error
            error = f"{type(e).__name__}: {e}"
        time.sleep(wait * n)
    return None, error


def attempt(call: Callable[[], str], retries: int = RETRIES, wait: float = 0.0) -> tuple[str | None, str | None]:
    """A result that isn't blank, or the last error."""

    def told() -> str:
        found = call()
        if not found or not found.strip():
            raise _BlankAnswer
        return found

    found, error = retried(told, retries, wait)
    return found, "blank answer" if error and error.startswith(_BlankAnswer.__name__) else error


class _BlankAnswer(Exception):
    """A model said nothing."""


def complete(rows: DataFrame, prompt: Column, completer: Completer, model: str = "default", max_tokens: int = 8192, retries: int = RETRIES, workers: int = 1, deadline: float | None = None, per_second: float | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """rows with result and error, in the order of each partition's rows; of the columns only those of ``keep``, if given,
    as what only the prompt is made of need not go to Python and back.

    A task has ``workers`` calls under way at most; each, with its retries, may take ``deadline`` seconds,
    and no more than ``per_second`` begin in a second of a task.
    """

    def run(batches):
        pace = parallel.Pace(per_second)
        for b in batches:
            ask = lambda p: attempt(lambda: completer.complete(p, model, max_tokens), retries)
            found = list(parallel.answers(b["_prompt"], ask, workers, deadline, pace))
            yield b.drop(columns="_prompt").assign(result=[r for r, _ in found], error=[e for _, e in found])

    kept = rows.columns if keep is None else list(keep)
    asked = rows.select(*kept, prompt.alias("_prompt"))
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in kept)
    return asked.mapInPandas(run, f"{schema}, result string, error string")


def first_failure(rows: DataFrame, order: list[str]) -> DataFrame:
    """(order, error): the first row in order that has an error, if any; one row at most."""
    return rows.where("error IS NOT NULL").select(*order, "error").orderBy(*order).limit(1)


def vector_index(texts: DataFrame, text: str, embedder: Embedder, model: str = "default", known: DataFrame | None = None, items: int = chunking.BATCH_ITEMS, tokens: int = chunking.BATCH_TOKENS) -> DataFrame:
    """(key, vector, error): an index of all texts that aren't blank, each asked for once.

    Batches are packed by count and tokens as texts stream by, across documents, so none is gathered;
    what a batch answers goes back to its texts by their place. A batch that fails, or has another number of
    vectors than texts, is an error of its texts. Texts of ``known`` (key, vector) are not asked for again.
    It is for models whose vectors don't depend on the batch.
    """
    asked = texts.where(T.strip(F.col(text)) != "").select(F.sha2(text, 256).alias("key"), T.probe_text(F.col(text)).alias("text")).dropDuplicates(["key"])
    if known is not None:
        asked = asked.join(known.select("key"), "key", "left_anti")

    def run(batches):
        keys, held, size = [], [], 0

        def told() -> pd.DataFrame:
            vectors, error = retried(lambda: embedder.embed(held, model))
            if error is None and len(vectors) != len(held):
                error = "embedding count differs"
            out = [None] * len(held) if error else [list(map(float, v)) for v in vectors]
            return pd.DataFrame({"key": keys, "vector": pd.Series(out, dtype=object), "error": pd.Series([error] * len(held), dtype=object)})

        for b in batches:
            for key, t in zip(b["key"], b["text"], strict=True):
                if held and (len(held) >= items or size + len(t) // 4 > tokens):
                    yield told()
                    keys, held, size = [], [], 0
                keys.append(key)
                held.append(t)
                size += len(t) // 4
        if held:
            yield told()

    made = asked.mapInPandas(run, "key string, vector array<double>, error string")
    return made if known is None else made.unionByName(known.select("key", "vector", F.lit(None).cast("string").alias("error")))


def indexed_similarity(pairs: DataFrame, left: str, right: str, index: DataFrame, name: str = "similarity") -> DataFrame:
    """pairs with the cosine of two texts' vectors; 0.0 where a text is not in the index."""
    side = lambda c, v: index.select(F.col("key").alias(f"_{c}"), F.col("vector").alias(v))
    keyed = pairs.withColumns({"_l": F.sha2(left, 256), "_r": F.sha2(right, 256)})
    met = keyed.join(side("l", "_u"), "_l", "left").join(side("r", "_v"), "_r", "left")
    near = F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), V.cosine(F.col("_u"), F.col("_v")))
    return met.withColumn(name, F.coalesce(near, F.lit(0.0))).select(*pairs.columns, name)


def embed(rows: DataFrame, group: str, position: str, text: str, embedder: Embedder, model: str = "default") -> DataFrame:
    """(group, position, text, vector): a document's texts are embedded together, equal texts once, in
    batches by count and tokens, each cut to what a model takes and tried again on errors; a wrong
    number of vectors is an error."""
    vectors = embedded_texts(rows, group, position, text, embedder, model)
    return rows.select(group, position, text).join(vectors, [group, text], "left")


def embedded_texts(rows: DataFrame, group: str, position: str, text: str, embedder: Embedder, model: str = "default") -> DataFrame:
    """(group, text, vector): what embed gives, once for each text of a group."""
    distinct = evals.first_seen(rows.select(group, position, text), [group], F.col(text), [position])
    kind = rows.schema[group].dataType.simpleString()

    def run(d: pd.DataFrame) -> dict[str, list]:
        texts = d[text].tolist()
        found: list[list[float]] = []
        for part in chunking.batches_of([t[: chunking.PROBE_CHARS][: chunking.PROBE_TOKENS] for t in texts]):
            vectors, error = retried(lambda part=part: embedder.embed(part, model))
            if vectors is None:
                raise ValueError(f"no embedding: {error}")
            if len(vectors) != len(part):
                raise ValueError("embedding count differs")
            found += vectors
        return {group: d[group].tolist(), text: texts, "vector": [list(map(float, v)) for v in found]}

    return in_groups(distinct.select(group, position, text), [group], [position], run, f"`{group}` {kind}, `{text}` string, vector array<double>")


def transcribe(rows: DataFrame, audio: str, transcriber: Transcriber, model: str = "default") -> DataFrame:
    """rows without audio, with response (JSON) and error."""

    def run(batches):
        for b in batches:
            found = [attempt(lambda a=a: json.dumps(transcriber.transcribe(bytes(a), model))) for a in b[audio]]
            yield b.drop(columns=audio).assign(response=[r for r, _ in found], error=[e for _, e in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != audio)
    return rows.mapInPandas(run, f"{schema}, response string, error string")


def section_answers(sections: DataFrame, prompt: Column, completer: Completer, version: str, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, section_index, key, value, error): what a model says of sections; texts whose key is in
    cache (key, value) are not asked again. Written once, as later steps read it more than once."""
    from folioscope.lineage import cut

    keyed = sections.withColumn("key", T.key_of(F.col("text"), F.lit(version)))
    fresh = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")
    asked = complete(fresh, prompt, completer).select("doc_id", "section_index", "key", F.col("result").alias("value"), "error")
    if cache is not None:
        known = keyed.join(cache.groupBy("key").agg(F.min("value").alias("value")), "key")
        asked = asked.unionByName(known.select("doc_id", "section_index", "key", "value", F.lit(None).cast("string").alias("error")))
    return cut(asked)


def section_facts(sections: DataFrame, template: str, completer: Completer, cache: DataFrame | None = None, limit: int = evals.FACT_LIMIT, version: str = "v001") -> DataFrame:
    """(doc_id, pos, fact): facts of sections (doc_id, section_index, title, text), taken in turns,
    cut at the limit first and made distinct then; texts in cache (key, value) are not asked again."""
    prompt = T.render(F.lit(template), F.create_map(F.lit("title"), F.col("title"), F.lit("text"), F.col("text")))
    return facts_of(section_answers(sections, prompt, completer, version, cache), limit)


def facts_of(answers: DataFrame, limit: int = evals.FACT_LIMIT) -> DataFrame:
    """(doc_id, pos, fact) of section_answers; an answer whose facts don't fit has none."""
    from folioscope.functions import jsonx

    facts = jsonx.string_list(jsonx.salvage(F.col("value")), "$.facts")
    rows = answers.select("doc_id", "section_index", F.posexplode(facts).alias("turn", "fact"))
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "section_index"))).where(F.col("pos") <= limit)
    return evals.distinct_facts(ranked, ["doc_id"], "fact", ["pos"]).select("doc_id", "pos", "fact")


def judge(items: DataFrame, against: DataFrame, template: str, key: str, completer: Completer) -> DataFrame:
    """items (doc_id, pos, item) with good, evidence, status and issues: judged in batches of ten against
    a text (doc_id, text); a batch whose verdicts don't fit has an error instead."""
    from folioscope.functions import jsonx

    placed = chunking.fixed_batches(items, ["doc_id"], ["pos"])
    asked = placed.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "pos", "item"))).alias("items")).join(against, "doc_id")
    prompt = T.render(F.lit(template), F.create_map(F.lit("items"), T.numbered(F.transform("items", lambda x: x["item"])), F.lit("text"), F.col("text")))
    answered = complete(asked, prompt, completer, keep=["doc_id", "batch", "items"])
    read = answered.withColumn("verdicts", jsonx.verdicts(jsonx.salvage(F.col("result")), key, F.size("items")))
    rows = read.select("doc_id", "error", F.explode("items").alias("i"), "verdicts")
    verdict = F.get("verdicts", F.col("i.place"))
    return rows.select("doc_id", F.col("i.pos").alias("pos"), F.col("i.item").alias("item"), verdict["good"].alias("good"), verdict["evidence"].alias("evidence"), verdict["status"].alias("status"), verdict["issues"].alias("issues"), F.when(verdict.isNull(), F.coalesce("error", F.lit("verdicts don't fit"))).alias("error"))


def map_reduce_summaries(chunks: DataFrame, chunk_template: str, merge_template: str, completer: Completer, max_tokens: int) -> DataFrame:
    """(doc_id, summary, error): chunks (doc_id, chunk, text) are summarised apart, joined in order,
    compressed until they fit, and merged by one more call."""
    one = complete(chunks, T.render(F.lit(chunk_template), F.create_map(F.lit("text"), F.col("text"))), completer)
    failed = one.groupBy("doc_id").agg(F.max("error").alias("chunk_error"))
    joined = chunking.merge_by_size(one.where("result IS NOT NULL").select("doc_id", "chunk", F.col("result").alias("t")), "doc_id", "chunk", "t")
    short = compress(joined, completer, max_tokens)
    merged = complete(short, T.render(F.lit(merge_template), F.create_map(F.lit("text"), F.col("text"))), completer)
    return merged.join(failed, "doc_id", "right").select("doc_id", F.col("result").alias("summary"), F.coalesce("error", "chunk_error").alias("error"))


def compress(docs: DataFrame, completer: Completer, max_tokens: int, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) with every text within budget: what is too long is packed into parts, each part
    shortened, and put together again. A text that doesn't shrink is an error."""
    from folioscope.lineage import cut

    now = docs.select("doc_id", "text")
    for _ in range(rounds):
        now = cut(now)
        long = now.where(T.token_estimate(F.col("text")) > max_tokens)
        if long.isEmpty():
            return now
        parts = complete(chunking.context_parts(long, max_tokens), F.col("text"), completer)
        shorter = chunking.merge_by_size(parts.select("doc_id", "part", F.col("result").alias("t")), "doc_id", "part", "t").withColumnRenamed("text", "new")
        shrunk = long.join(shorter, "doc_id").select("doc_id", F.when(F.length("new") < F.length("text"), F.col("new")).otherwise(F.raise_error(F.lit("a summary doesn't get shorter")).cast("string")).alias("text"))
        now = now.where(T.token_estimate(F.col("text")) <= max_tokens).unionByName(shrunk)
    if not now.where(T.token_estimate(F.col("text")) > max_tokens).isEmpty():
        raise ValueError("a summary doesn't fit its budget")
    return now


def rewrite(docs: DataFrame, template: str, completer: Completer, **columns: Column) -> DataFrame:
    """docs with result and error of a rewriting prompt (merge, repair, faithfulness filter)."""
    return complete(docs, T.render(F.lit(template), F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])), completer)


def name_assets(docs: DataFrame, template: str, completer: Completer) -> DataFrame:
    """(doc_id, title, authors, name, error): title and authors that a model reads from a text."""
    from folioscope.functions import jsonx

    asked = rewrite(docs.select("doc_id", "text"), template, completer, text=T.probe_text(F.col("text"), 4000))
    v = jsonx.salvage(F.col("result"))
    title, authors = jsonx.strict_string(v, "$.title"), F.coalesce(jsonx.string_list(v, "$.authors"), T.authors(jsonx.strict_string(v, "$.authors")))
    read = asked.select("doc_id", title.alias("title"), authors.alias("authors"), "error")
    return read.select("doc_id", "title", "authors", T.canonical_name([F.col("title"), F.array_join("authors", "_")]).alias("name"), F.when(F.col("title").isNull(), F.coalesce("error", F.lit("no title"))).alias("error"))


@dataclass(frozen=True)
class Iteration:
    version: str
    mean_delta: float | None
    promoted: bool
    reason: str | None


def improve(start: DataFrame, evaluate: Callable[[str], DataFrame], propose: Callable[[str, DataFrame], str], first: str, iterations: int = evals.ITERATIONS, failures: int = evals.FAILURES, least: float = evals.MIN_DELTA) -> list[Iteration]:
    """Evaluate, propose, evaluate again, keep what passes the gate; ends after some failures in a row.

    Scores (doc_name, pos, blended, error) stay tables; the driver sees one row a round.
    """
    best, scores, lost, out = first, start, 0, []
    for _ in range(iterations):
        candidate = propose(best, scores)
        new = evaluate(candidate)
        row = evals.gate(evals.paired_deltas(scores, new).withColumn("all", F.lit(1)), ["all"], least).first()
        promoted = bool(row and row["promoted"])
        out.append(Iteration(candidate, row["mean_delta"] if row else None, promoted, row["reason"] if row else "no document in both runs"))
        best, scores, lost = (candidate, new, 0) if promoted else (best, scores, lost + 1)
        if lost >= failures:
            break
    return out


@dataclass(frozen=True)
class Settings:
    """What can be set by spark.conf under folioscope.<name>; fixed default values."""

    similarity: float = 0.8
    max_claims: int = 48
    chunk_claims: int = 12
    section_claims: int = 8
    workers: int = 4
    min_tokens: int = 1000
    max_tokens: int = 12_000

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        own = {n: type(d)(spark.conf.get(f"folioscope.{n}", str(d))) for n, d in cls().__dict__.items()}
        if own["workers"] <= 0:
            raise ValueError("workers must be positive")
        return cls(**own)
