"""The trie of conversations' prefixes, built from owned chains.

A conversation's turns are numbered, and every prefix of them gets a 128-bit digest: turns are hashed
with their place, and digests are running sums (XOR) of these hashes, so a conversation of any length
is worked on by many tasks. The least conversation that has a prefix owns its node. Whoever owns a
depth owns all deeper ones of its own, so a conversation's first owned depth is found by binary search:
in each round all conversations ask at once, in one batched join against the digests' minima. A
conversation's owned depths are a chain, which hangs on the chain that owns the depth above it.

Sums over subtrees go bottom-up over chains: what a chain has is passed to the chains above it, twice as
far in each round, so the rounds are the logarithm of how deep chains are nested. Inside a chain they
are running sums from its end.

Lists of members that end at a node are hashed as a stream: ranges of (node, conversation) are written as
pieces of text, and one task hashes a node's pieces in order, so memory stays small for any list.

Defined cases: rows of a null conversation name none and are left out; a null role or text is empty;
turns are ordered with null first, equal turns by a digest of role and text; repeated rows are turns of
their own; an empty table has no nodes; a remainder of a negative id is negative, as in SQL; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import discard, durable, small, spread_join
from folioscope.scans import numbered, running

#: Conversations of one number divided by SHARED begin alike, by up to SPAN - 1 turns.
SHARED, SPAN = 5, 9
#: Conversations of a piece of text that is hashed.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv, turn, d1, d2, bytes): a turn's role and text as 128 bits of their SHA-256, and the text's size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    return rows.select("conv", "turn", F.xxhash64(F.lit(1), "digest").alias("d1"), F.xxhash64(F.lit(2), "digest").alias("d2"), "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of every conversation and (conv, at, d1, d2, bytes) of the rebuilt turns, at from 1:
    the first turns of the conversation that its number is shared with, then its own after as many."""
    ranked = durable(numbered(turns, ["conv"], [F.asc_nulls_first("turn"), F.col("d1"), F.col("d2")], "n"), "trie-turns")
    own = durable(ranked.groupBy("conv").agg(F.max("n").alias("own")), "trie-lengths")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % SPAN
    asked = own.select("conv", "own", head.alias("head"), (F.col("conv") - F.col("conv") % SHARED).alias("base"))
    lent = own.select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    info = asked.join(lent, "base", "left").withColumn("taken", F.least("head", F.coalesce("lent", F.lit(0))))
    info = durable(info.select("conv", "base", "head", "taken", "own", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")), "trie-conversations")
    rest = spread_join(ranked.where(F.col("n") > head), info.select("conv", "head", "taken", "own"), ["conv"], "own")
    rest = rest.select("conv", (F.col("taken") + F.col("n") - F.col("head")).alias("at"), "d1", "d2", "bytes")
    first = ranked.where(F.col("n") < SPAN).withColumnRenamed("conv", "base").join(info.select("conv", "base", "head"), "base").where(F.col("n") <= F.col("head"))
    rows = first.select("conv", F.col("n").alias("at"), "d1", "d2", "bytes").unionByName(rest)
    rows = durable(rows, "trie-rebuilt")
    discard(ranked, own)
    return info.select("conv", "length"), rows


def prefix_digests(rows: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, bytes): the digest of each prefix, and the size of its last text."""
    tag = {x: ("xor", F.xxhash64(F.lit(seed), "d1", "d2", "at")) for seed, x in ((3, "x1"), (4, "x2"))}
    return durable(running(rows, ["conv"], [F.col("at")], tag).select("conv", F.col("at").alias("depth"), "x1", "x2", "bytes"), "trie-prefixes")


class Owners:
    """Who owns the prefix of a conversation at a depth, by joins against the digests' minima."""

    def __init__(self, prefixes: DataFrame) -> None:
        self.prefixes = prefixes
        self.minima = durable(prefixes.groupBy("depth", "x1", "x2").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")), "trie-minima")
        # Prefixes that very many have: their rows stay where they are.
        self.heavy = durable(self.minima.where("n_convs > 64").orderBy(F.desc("n_convs"), "depth", "x1", "x2").limit(4096).select("depth", "x1", "x2", "owner"), "trie-heavy")

    def of(self, asked: DataFrame) -> DataFrame:
        """asked (with conv and depth) with owner."""
        key = ["depth", "x1", "x2"]
        digests = asked.join(self.prefixes.select("conv", *key).hint("merge"), ["conv", "depth"])
        few = F.broadcast(self.heavy)
        others = digests.join(F.broadcast(self.heavy.select(*key)), key, "left_anti").join(self.minima.select(*key, "owner").hint("merge"), key)
        return digests.join(few, key).unionByName(others).drop("x1", "x2")


def chain_table(info: DataFrame, owners: Owners) -> tuple[DataFrame, DataFrame]:
    """(conv, first, length, up) of the conversations that own a depth below the root: their first owned
    depth and the owner of the one above it (null: the root's). And (owner, depth, conv): where each
    conversation ends; the owner is null at the root."""
    ends = durable(owners.of(info.where("length > 0").withColumnRenamed("length", "depth")), "trie-ends")
    state = durable(ends.where("owner = conv").select("conv", F.lit(0).cast("bigint").alias("low"), F.col("depth").alias("high"), F.col("depth").alias("length"), F.lit(None).cast("bigint").alias("up")), "trie-search")
    done = []
    while True:
        done.append(state.where("high - low = 1"))
        open_ = state.where("high - low > 1").withColumn("depth", F.shiftright(F.col("low") + F.col("high"), 1))
        if open_.isEmpty():
            break
        mine = F.col("owner") == F.col("conv")
        found = owners.of(open_)
        state = durable(found.select("conv", F.when(mine, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"), "length", F.when(mine, F.col("up")).otherwise(F.col("owner")).alias("up")), "trie-search")
    chains = done[0]
    for d in done[1:]:
        chains = chains.unionByName(d)
    chains = durable(chains.select("conv", F.col("high").alias("first"), "length", "up"), "trie-chains")
    turnless = info.where("length = 0").select(F.lit(None).cast("bigint").alias("owner"), F.lit(0).cast("bigint").alias("depth"), "conv")
    return chains, ends.select("owner", "depth", "conv").unionByName(turnless)


def subtree_sums(chains: DataFrame) -> DataFrame:
    """chains (conv, up, saved, leaves) with the sums of all chains at or below each.

    In round k a chain holds the sums of those less than 2**k above it that end in it, and the one that
    is 2**k above; it passes on what it holds and jumps twice as far.
    """
    now = durable(chains.select("conv", "saved", "leaves", F.col("up").alias("jump")), "trie-sums")
    while not (open_ := now.where("jump IS NOT NULL")).isEmpty():
        given = durable(open_.groupBy("jump").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count(F.lit(1)).alias("n")), "trie-given")
        further = given.select("jump", "n").join(now.select(F.col("conv").alias("jump"), F.col("jump").alias("next")), "jump")
        moved = spread_join(open_, further.where("next IS NOT NULL"), ["jump"], "n", "left").select("conv", "saved", "leaves", F.col("next").alias("jump"))
        every = moved.unionByName(now.where("jump IS NULL")).join(given.select(F.col("jump").alias("conv"), "s", "l"), "conv", "left")
        after = durable(every.select("conv", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), "jump"), "trie-sums")
        discard(now, given)
        now = after
    return now.drop("jump")


def end_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of every node at which conversations end."""

    def written(batches):
        for b in batches:
            fresh = (b["owner"].ne(b["owner"].shift()) | b["depth"].ne(b["depth"].shift())).cumsum()
            place = b.groupby(fresh).cumcount() // PIECE
            out = b.assign(ids=b["conv"].astype(str)).groupby([fresh.rename("node"), place.rename("piece")], sort=False)
            yield out.agg(owner=("owner", "first"), depth=("depth", "first"), conv=("conv", "first"), ids=("ids", ",".join)).reset_index(drop=True)

    def hashed(batches):
        node, digest = None, None
        for b in batches:
            out = []
            for owner, depth, ids in zip(b["owner"].tolist(), b["depth"].tolist(), b["ids"].tolist(), strict=True):
                if (owner, depth) != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["owner", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["owner", "depth", "ends_sha256"])

    key = ["owner", "depth", "conv"]
    pieces = ends.repartitionByRange(*key).sortWithinPartitions(*key).mapInPandas(written, "owner bigint, depth bigint, conv bigint, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions(*key).mapInPandas(hashed, "owner bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    turns = durable(turn_table(conversations), "trie-input")
    info, rows = rebuilt(turns)
    discard(turns)
    owners = Owners(prefix_digests(rows))
    discard(rows)
    chains, ends = chain_table(info, owners)
    top = durable(info.agg(F.min("conv").alias("top"), F.count(F.lit(1)).alias("members")).where("members > 0"), "trie-root")
    root = F.broadcast(top)  # one row
    known = small(chains.select(F.col("conv").alias("top"), "length"))
    own_root = top.join(known, "top", "left").select(F.col("top").alias("conv"), F.lit(0).cast("bigint").alias("first"), F.coalesce("length", F.lit(0).cast("bigint")).alias("length"), F.lit(None).cast("bigint").alias("up"))
    below = chains.join(root).where("conv <> top").select("conv", "first", "length", F.coalesce("up", "top").alias("up"))
    chains = durable(own_root.unionByName(below), "trie-all-chains")
    weight = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = owners.minima.select("owner", "depth", "n_convs", weight.alias("saved"))
    nodes = durable(nodes.unionByName(top.select(F.col("top").alias("owner"), F.lit(0).cast("bigint").alias("depth"), F.col("members").alias("n_convs"), F.lit(0).cast("bigint").alias("saved"))), "trie-nodes")
    hung = chains.where("up IS NOT NULL").select(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth"), "conv")
    ended = chains.select(F.col("conv").alias("owner"), F.col("length").alias("depth"))
    # A chain has a leaf of its own if nothing hangs on its last node.
    leafless = ended.join(hung.select("owner", "depth").distinct(), ["owner", "depth"], "left_semi").select(F.col("owner").alias("conv"), F.lit(0).cast("bigint").alias("leaf"))
    held = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved"))
    sums = chains.select("conv", "up").join(held, "conv").join(leafless, "conv", "left").select("conv", "up", "saved", F.coalesce("leaf", F.lit(1).cast("bigint")).alias("leaves"))
    totals = subtree_sums(sums)

    def mark(of: DataFrame, **values: Column) -> DataFrame:
        return of.select("owner", "depth", *[values.get(n, F.lit(None).cast("bigint")).alias(n) for n in ("hung", "more_saved", "more_leaves", "starts", "up", "stops")])

    marks = mark(hung.join(totals, "conv"), hung=F.lit(1).cast("bigint"), more_saved=F.col("saved"), more_leaves=F.col("leaves"))
    marks = marks.unionByName(mark(chains.select(F.col("conv").alias("owner"), F.col("first").alias("depth"), "up"), starts=F.lit(1).cast("bigint"), up=F.col("up")))
    marks = marks.unionByName(mark(ended, stops=F.lit(1).cast("bigint")))
    marks = marks.groupBy("owner", "depth").agg(*[F.sum(c).alias(c) for c in ("hung", "more_saved", "more_leaves")], *[F.max(c).alias(c) for c in ("starts", "up", "stops")])
    zero = F.lit(0).cast("bigint")
    hangs, stops = F.coalesce("hung", zero), F.coalesce("stops", zero)
    valued = nodes.join(marks, ["owner", "depth"], "left").select(
        "owner", "depth", "n_convs",
        F.when(F.col("starts") == 1, F.col("up")).otherwise(F.col("owner")).alias("parent"),
        (hangs + 1 - stops).alias("n_children"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"),
        (F.coalesce("more_leaves", zero) + F.when((stops == 1) & (hangs == 0), 1).otherwise(0)).alias("leaves"),
    )
    summed = running(durable(valued, "trie-valued"), ["owner"], [F.desc("depth")], {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))})
    ends = ends.join(root).select(F.coalesce("owner", "top").alias("owner"), "depth", "conv")
    digests = durable(end_digests(durable(ends, "trie-end-rows")), "trie-end-digests")
    found = summed.join(digests, ["owner", "depth"], "left")
    return found.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = """
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
    FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT c, max(n) AS own FROM own GROUP BY c), hashed AS (
    SELECT c, own, c - c % 5 AS base,
           xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)),
               lambda a, b: list_reduce([xor(a, b)] || [CAST(z AS BIGINT) FOR z IN range(8)], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
    FROM sizes
), ids AS (SELECT i.c, i.base, i.h, least(i.h, coalesce(b.own, 0)) AS taken, least(i.h, coalesce(b.own, 0)) + greatest(i.own - i.h, 0) AS len FROM hashed i LEFT JOIN sizes b ON b.c = i.base
), rebuilt AS (
    SELECT i.c, o.n AS d, r, t FROM ids i JOIN own o ON o.c = i.base AND o.n <= i.h
    UNION ALL SELECT i.c, i.taken + o.n - i.h, r, t FROM ids i JOIN own o ON o.c = i.c AND o.n > i.h
), pref AS (
    SELECT c, d, strlen(t) AS bytes, sha256(string_agg(length(r) || ':' || r || length(t) || ':' || t, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM ids
), step AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS above FROM pref
), nodes AS (SELECT key, d, min(c) AS owner, count(*) AS n_convs, max(bytes) AS bytes, max(above) AS above FROM step GROUP BY key, d
), kids AS (SELECT above AS key, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), below AS (
    SELECT a.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
    FROM nodes n JOIN pref a ON a.c = n.owner AND a.d <= n.d LEFT JOIN kids k ON k.key = n.key GROUP BY a.key
), ends AS (SELECT p.key, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS who FROM pref p JOIN ids i ON i.c = p.c AND i.len = p.d GROUP BY p.key)
SELECT n.owner AS conv_id, CAST(n.d AS BIGINT) AS depth, u.owner AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.who, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN nodes u ON u.key = n.above LEFT JOIN ends e ON e.key = n.key
"""
