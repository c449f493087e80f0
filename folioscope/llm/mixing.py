"""Mixing sources to target weights over a domain-language-source tree.

A node's target is its parent's target times its weight among its siblings. A leaf can give at most
``max_epochs`` times its tokens. What a leaf cannot give goes to its siblings by weight as long as
they have room; only what all of them together cannot take is passed on to the parent's siblings,
and so on up to the root. A leaf with a budget reads whole epochs and then a prefix of one more:
its documents in an order seeded for that epoch, up to the first document that reaches the budget.

Budgets are worked out level by level in a table with one row a node, however many sources there
are: siblings in order of room by weight, with running sums, show who is full and what is left for
the others. Prefixes come from sums as well: the tokens of a leaf are summed by ranges of the seeded
order, running sums over these ranges find the one in which the budget ends, and only the rows of
that range are sorted. A leaf that holds a third of all rows is thus never in one task.

Defined cases: a null domain, language or source is a value of its own; a null text has no tokens;
documents without tokens are never selected; repeated ids are ordered by text and count apart, and
of fully repeated rows that tie at the end of a prefix any come first; an empty table, or one without
tokens, selects nothing; a text of any length counts with all its tokens; other columns are passed
on only where they are carried, under their own names.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents, durable, small

#: Share of the corpus' tokens that the mixture has.
SHARE = 0.6
MAX_EPOCHS = 2
SEED = 20_000
RANGES = 1 << 12
#: Target weights by language; one that is not named has weight 1.
LANGUAGES = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}

Path = tuple[str | None, ...]


def _key(names: Sequence[str]) -> Column:
    """A node's path as one text that tells null from any value."""
    return F.to_json(F.array(*[F.col(n).cast("string") for n in names])) if names else F.lit("[]")


def budgets(leaves: DataFrame, names: Sequence[str], total: float, weights: Mapping[Path, float], max_epochs: int) -> DataFrame:
    """leaves (names, leaf_tokens) with budget. A weight is for the path from the root to a node; 1 if
    not named.

    The room of a node is that of its whole subtree, so a shortage inside it is first made good by its
    own leaves and reaches its siblings only when they are exhausted.
    """
    named = [(json.dumps(list(path), ensure_ascii=False, separators=(",", ":")), float(w)) for path, w in weights.items()]
    weight = F.broadcast(leaves.sparkSession.createDataFrame(named, "node string, weight double"))  # what the caller names
    room = (F.sum("leaf_tokens") * max_epochs).cast("double").alias("room")
    targets = leaves.agg(F.least(F.lit(float(total)), F.coalesce(room, F.lit(0.0))).alias("target")).select(F.lit("[]").alias("parent"), "target")
    for depth in range(1, len(names) + 1):
        nodes = leaves.groupBy(*names[:depth]).agg(room).select(_key(names[: depth - 1]).alias("parent"), _key(names[:depth]).alias("node"), "room")
        nodes = nodes.join(weight, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).join(small(targets), "parent")
        order = Window.partitionBy("parent").orderBy(F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(float("inf")), "node")
        rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        # What a unit of weight gets if all before are full. Who has no more room than that is full.
        unit = F.when(rest > 0, F.greatest(F.col("target") - before, F.lit(0.0)) / rest).otherwise(0.0)
        tried = nodes.withColumn("unit", unit).withColumn("full", (F.col("weight") > 0) & (F.col("room") <= F.col("weight") * F.col("unit")))
        left = F.max(F.when(~F.col("full"), F.col("unit"))).over(Window.partitionBy("parent"))
        got = F.when(F.col("full"), F.col("room")).otherwise(F.col("weight") * F.coalesce(left, F.lit(0.0)))
        targets = durable(tried.select(F.col("node").alias("parent"), got.alias("target")), "mixing-targets")
    return leaves.withColumn("parent", _key(names)).join(small(targets), "parent").drop("parent").withColumnRenamed("target", "budget")


def mix_sources(
    docs: DataFrame,
    levels: Sequence[tuple[str, Column]],
    share: float = SHARE,
    weights: Mapping[Path, float] | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = RANGES,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """One row per document: id, the levels, n_tokens, budget of its leaf, copies.

    ``levels`` are (name, expression) from the root down; ``ranges`` is a power of two, two at least; tokens are runs of non-white space;
    copies is how often the mixture has the document (whole epochs and the last, partial one).
    Columns in ``carry`` are passed through.
    """
    names = [n for n, _ in levels]
    body = F.coalesce(F.col(text_col), F.lit(""))
    squeezed = F.regexp_replace(body, r"[^\x20\x09-\x0D]+", "w")
    rows = docs.select(
        F.col(id_col).alias("id"),
        *[e.alias(n) for n, e in levels],
        F.length(F.regexp_replace(squeezed, "[^w]", "")).cast("bigint").alias("n_tokens"),
        F.xxhash64(body).alias("text_key"),
        *carry,
    )
    if not carry:
        rows = durable(rows, "mixing-rows")  # without texts: the texts are read once
    sums = durable(rows.groupBy(*names).agg(F.sum("n_tokens").alias("leaf_tokens")).where("leaf_tokens > 0"), "mixing-leaves")
    total = share * (sums.agg(F.sum("leaf_tokens")).first()[0] or 0)
    # Whole epochs, and what is left for a prefix of the epoch after them.
    whole = F.floor(F.col("budget") / F.col("leaf_tokens")).cast("int")
    given = budgets(sums, names, total, weights or {}, max_epochs).withColumn("whole", whole)
    plan = given.select(_key(names).alias("leaf"), "budget", "whole", (F.col("budget") - F.col("whole") * F.col("leaf_tokens")).alias("prefix"))
    leaves = durable(plan, "mixing-plan")
    rows = rows.withColumn("leaf", _key(names))
    order = F.xxhash64(F.lit(seed), F.coalesce("whole", F.lit(0)), *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names], "id", "text_key")
    placed = rows.join(small(leaves), "leaf", "left").withColumn("place", order).withColumn("piece", F.shiftrightunsigned("place", 64 - ranges.bit_length() + 1))
    run = Window.partitionBy(*names).orderBy("piece")
    before = F.coalesce(F.sum("piece_tokens").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = placed.where(F.col("prefix") > 0).groupBy(*names, "piece").agg(F.sum("n_tokens").alias("piece_tokens"), F.first("prefix").alias("prefix")).withColumn("before", before)
    # Each leaf's ranges up to where its budget ends: as one row, the last range and the sum before it.
    ends = pieces.where(F.col("before") < F.col("prefix")).groupBy(*names).agg(F.max_by("piece", "before").alias("end_piece"), F.max("before").alias("end_before"))
    ends = durable(ends.select(_key(names).alias("leaf"), "end_piece", "end_before"), "mixing-ends")
    cut = placed.join(small(ends), "leaf", "left")
    inside = F.col("piece") == F.col("end_piece")
    within = Window.partitionBy(*names, "piece").orderBy("place", "id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col("id").alias(id_col), *names, "n_tokens", F.coalesce("budget", F.lit(0.0)).alias("budget")]
    carried = [c for c in rows.columns if c not in {"id", *names, "n_tokens", "text_key", "leaf"}]
    has = F.col("n_tokens") > 0
    whole = F.coalesce("whole", F.lit(0))
    outside = cut.where(F.coalesce(~inside, F.lit(True))).withColumn("copies", F.when(has, whole + F.coalesce((F.col("piece") < F.col("end_piece")).cast("int"), F.lit(0))).otherwise(0))
    ending = cut.where(inside).withColumn("so_far", F.col("end_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).withColumn("copies", F.when(has, whole + (F.col("so_far") < F.col("prefix")).cast("int")).otherwise(0))
    return outside.select(*kept, "copies", *carried).unionByName(ending.select(*kept, "copies", *carried))


def tree() -> list[tuple[str, Column]]:
    """Domain, language and source of documents. The table has no domain: sources are dealt to
    four domains by a hash of their name."""
    return [("domain", F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(4)).cast("string"))), ("lang", F.col("lang")), ("source", F.col("source"))]


def language_weights(domains: int = 4) -> dict[Path, float]:
    return {(f"domain{d}", lang): w for d in range(domains) for lang, w in LANGUAGES.items()}


def keep_mixture(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that a mixture selects, with all their columns. It has one epoch at most: a second
    one would bring back copies, which the stages before have taken out."""
    carry = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row")
    mixed = mix_sources(docs, tree(), share, language_weights(), 1, carry=[carry])
    return mixed.where("copies > 0").select("whole_row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), tree(), weights=language_weights())
