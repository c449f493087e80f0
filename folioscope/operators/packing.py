"""Greedy packing and valley cuts of sequences of any length, spread over tasks.

Where a bucket that begins at an item ends is a question about prefix sums: the last sum that still
fits. It is answered for all items at once, by one running maximum over sums and limits in a common
order, so each item gets a pointer to where the next bucket would begin. The buckets are what is
reached from the first item along these pointers. Sequences are dealt to ranges; inside a range every
item's way out is found by doubling pointers, ways between ranges are doubled by joins of the few items
at which ranges are entered, and each range then walks from the one entry that is reached. So rounds are
the logarithm of the number of ranges, and no group is gathered.

Valley cuts point to the least similarity within the budget. A range's own task answers what lies in
one range; else the answer is the least of the first range's end, the last one's beginning and the
ranges between, of which only one value each is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators.chunking import MAX_TOKENS, MIN_TOKENS
from folioscope.scans import dealt, numbered, running

_BIG = 1 << 62


def _placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """rows with _g (the group as text), _at (place from 0), values, and _s: the sum of _size up to here; written."""
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    given = rows.withColumns({"_g": key, **values})
    out = running(given, ["_g"], order, {"_at": ("sum", F.lit(1).cast("bigint")), "_s": ("sum", F.col("_size"))})
    return cut(out.withColumn("_at", F.col("_at") - 1))


def last_within(sums: DataFrame, limits: DataFrame, strict: bool = False) -> DataFrame:
    """limits (_g, _at, limit) with last: the last place whose sum (sums: _g, _at, _s, ascending) is at
    most the limit, or below it; null if there is none."""
    points = sums.select("_g", F.col("_s").alias("v"), F.lit(1 if strict else 0).alias("kind"), "_at")
    asked = limits.select("_g", F.col("limit").alias("v"), F.lit(0 if strict else 1).alias("kind"), "_at")
    is_point = F.col("kind") == (1 if strict else 0)
    found = running(points.unionByName(asked), ["_g"], [F.col("v"), F.col("kind"), F.col("_at")], {"last": ("max", F.when(is_point, F.col("_at")))})
    return found.where(~is_point).select("_g", "_at", "last")


def _ways_out(at: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Where each item of a stretch of places leaves it, along pointers that go ahead."""
    first, end = at[0], at[-1]
    out = pointer.copy()
    while (inside := out <= end).any():
        out[inside] = out[out[inside] - first]
    return out


def _stretches(part: pd.DataFrame):
    part = part.sort_values(["_g", "_at"], kind="stable")
    cuts = np.flatnonzero(np.append(True, part["_g"].to_numpy()[1:] != part["_g"].to_numpy()[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
        yield part.iloc[lo:hi]


def orbit(pointers: DataFrame) -> DataFrame:
    """(_g, _at, hit) of pointers (_g, _at, next): whether a place is reached from its group's place 0. Places
    are whole numbers from 0, and pointers go ahead."""
    ranged = dealt(pointers, ["_g"], [F.col("_at")])

    def leave(part: pd.DataFrame) -> pd.DataFrame:
        found = [(s["_g"].to_numpy(), at, _ways_out(at, s["next"].to_numpy(np.int64))) for s in _stretches(part) for at in [s["_at"].to_numpy(np.int64)]]
        return pd.DataFrame({n: np.concatenate([f[k] for f in found]) for k, n in enumerate(("_g", "_at", "out"))})

    ways = cut(ranged.groupBy("_part").applyInPandas(leave, "_g string, _at bigint, out bigint"))
    # Only where a range is entered matters between ranges.
    entered = ways.select("_g", F.col("out").alias("_at")).distinct().join(ways, ["_g", "_at"])
    starts = ways.where("_at = 0")
    jumps = cut(entered.where("_at > 0").unionByName(starts))
    places = jumps.select("_g", "_at")
    reached = cut(starts.select("_g", "_at"))
    while True:
        new = reached.join(jumps, ["_g", "_at"]).select("_g", F.col("out").alias("_at")).join(places, ["_g", "_at"], "left_semi")
        after = cut(reached.unionByName(new).distinct())
        further = jumps.select("_g", F.col("_at").alias("out"), F.col("out").alias("beyond"))
        jumps = cut(jumps.join(further, ["_g", "out"]).select("_g", "_at", F.col("beyond").alias("out")))
        reached = after
        if jumps.isEmpty():
            break

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for s in _stretches(part):
            at, pointer = s["_at"].to_numpy(np.int64), s["next"].to_numpy(np.int64)
            hit = np.zeros(len(at), bool)
            entry = np.flatnonzero(s["entry"].to_numpy(bool))
            now = int(entry[0]) if len(entry) else len(at)
            while now < len(at):
                hit[now] = True
                now = int(pointer[now] - at[0])
            found.append((s["_g"].to_numpy(), at, hit))
        return pd.DataFrame({n: np.concatenate([f[k] for f in found]) for k, n in enumerate(("_g", "_at", "hit"))})

    marked = ranged.join(reached.withColumn("entry", F.lit(True)), ["_g", "_at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("_part").applyInPandas(walk, "_g string, _at bigint, hit boolean")


def _bucketed(placed: DataFrame, pointers: DataFrame, columns: list[str], name: str) -> DataFrame:
    """placed with the number (from 0) of the bucket that each row is in."""
    hits = orbit(cut(pointers))
    marked = placed.join(hits, ["_g", "_at"])
    out = running(marked, ["_g"], [F.col("_at")], {name: ("sum", F.col("hit").cast("int"))})
    return out.select(*columns, (F.col(name) - 1).cast("int").alias(name))


def packed(rows: DataFrame, group: Sequence[str], order: Sequence[Column], size: Column, most: int, items: int = 1 << 30, name: str = "bucket") -> DataFrame:
    """rows with a bucket number from 0 in their group's order: a new bucket where the sum of sizes or the count
    would pass its limit; an item beyond the limit has one of its own. order is total; a null size is 0."""
    placed = _placed(rows, group, order, {"_size": F.coalesce(size.cast("bigint"), F.lit(0))})
    limits = placed.select("_g", "_at", (F.col("_s") - F.col("_size") + most).alias("limit"))
    end = F.least(F.coalesce(F.col("last"), F.lit(-1)) + 1, F.col("_at") + items)
    pointers = last_within(placed, limits).select("_g", "_at", F.greatest(end, F.col("_at") + 1).alias("next"))
    return _bucketed(placed, pointers, rows.columns, name)


def least_between(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (_g, _at, low, high) with place: the first place of the least value (values: _g, _at, v)
    among places low to high, both included."""
    ranged = dealt(values.select("_g", "_at", "v"), ["_g"], [F.col("_at")])

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        """Of each place the first least one before it and after it in its range."""
        found = []
        for s in _stretches(part):
            at, v = s["_at"].to_numpy(np.int64), s["v"].to_numpy(float)
            before, after = np.minimum.accumulate(v), np.minimum.accumulate(v[::-1])[::-1]
            first = np.append(True, v[1:] < before[:-1])  # a new least value
            pre = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
            suf = np.where(v <= np.append(after[1:], np.inf), np.arange(len(v)), len(v))
            suf = np.minimum.accumulate(suf[::-1])[::-1]
            found.append((s["_g"].to_numpy(), at, np.full(len(at), s["_part"].iloc[0]), before, at[pre], after, at[suf]))
        names = ("_g", "_at", "part", "pre_v", "pre_at", "suf_v", "suf_at")
        return pd.DataFrame({n: np.concatenate([f[k] for f in found]) for k, n in enumerate(names)})

    sides = cut(ranged.groupBy("_part").applyInPandas(edges, "_g string, _at bigint, part int, pre_v double, pre_at bigint, suf_v double, suf_at bigint"))
    left = sides.select("_g", F.col("_at").alias("low"), F.col("part").alias("from"), "suf_v", "suf_at")
    right = sides.select("_g", F.col("_at").alias("high"), F.col("part").alias("to"), "pre_v", "pre_at")
    both = cut(asked.select("_g", "_at", "low", "high").join(left, ["_g", "low"]).join(right, ["_g", "high"]))

    # Ranges that lie whole inside a group: one row a range at most.
    whole = sides.groupBy("_g", "part").agg(F.min_by(F.struct("suf_v", "suf_at"), "_at").alias("m")).select("_g", "part", "m.*")
    inner = whole.join(whole.groupBy("_g").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("b > a + 1"), "_g").where("part > a AND part < b")
    listed = {(r["_g"], r["part"]): (r["suf_v"], r["suf_at"]) for r in inner.collect()}

    @F.pandas_udf("struct<v:double,place:bigint>")
    def between(g: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for key, x, y in zip(g, a, b, strict=True):
            out.append(min((listed[(key, p)] for p in range(x + 1, y)), default=(np.inf, _BIG)))
        return pd.DataFrame(out, columns=["v", "place"])

    far = both.where(F.col("to") > F.col("from"))
    middle = F.when(F.col("to") > F.col("from") + 1, between("_g", "from", "to")).otherwise(F.struct(F.lit(float("inf")).alias("v"), F.lit(_BIG).alias("place")))
    best = F.least(F.struct(F.col("suf_v").alias("v"), F.col("suf_at").alias("place")), middle, F.struct(F.col("pre_v").alias("v"), F.col("pre_at").alias("place")))
    spread = far.select("_g", "_at", best["place"].alias("place"))

    def inside(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Questions within one range, by a table of least places of stretches of 1, 2, 4, ... values."""
        out = []
        by = dict(tuple(asked.groupby("_g", sort=False)))
        for s in _stretches(held):
            mine = by.get(s["_g"].iloc[0])
            if mine is None:
                continue
            first, v = int(s["_at"].iloc[0]), s["v"].to_numpy(float)
            levels = [np.arange(len(v))]
            while 2 ** len(levels) <= len(v):
                half = 2 ** (len(levels) - 1)
                x, y = levels[-1][:-half], levels[-1][half:]
                levels.append(np.where(v[x] <= v[y], x, y))
            low, high = (mine[c].to_numpy(np.int64) - first for c in ("low", "high"))
            level = np.floor(np.log2(high - low + 1)).astype(int)
            place = np.empty(len(mine), np.int64)
            for n in np.unique(level).tolist():
                here = level == n
                x, y = levels[n][low[here]], levels[n][high[here] - 2**n + 1]
                place[here] = np.where(v[x] <= v[y], x, y)
            out.append(pd.DataFrame({"_g": mine["_g"], "_at": mine["_at"], "place": place + first}))
        return pd.concat(out) if out else pd.DataFrame({"_g": np.array([], object), "_at": np.array([], np.int64), "place": np.array([], np.int64)})

    near = both.where(F.col("to") == F.col("from")).select("_g", "_at", "low", "high", F.col("from").alias("_part"))
    own = ranged.groupBy("_part").cogroup(near.groupBy("_part")).applyInPandas(inside, "_g string, _at bigint, place bigint")
    return spread.unionByName(own)


def valleys(rows: DataFrame, group: Sequence[str], order: Sequence[Column], tokens: Column, similarity: Column, least: int = MIN_TOKENS, most: int = MAX_TOKENS, name: str = "chunk") -> DataFrame:
    """rows with a chunk number from 0 in their group's order, cut as cuts_of cuts: where the similarity of an
    item with the next one is lowest among boundaries at which the chunk is long enough, else before what
    doesn't fit. A similarity that is null is the highest."""
    placed = _placed(rows, group, order, {"_size": F.coalesce(tokens.cast("bigint"), F.lit(0)), "_sim": F.coalesce(similarity.cast("double"), F.lit(float("inf")))})
    n = placed.groupBy("_g").agg(F.max("_at").alias("n_last"))
    start = placed.select("_g", "_at", (F.col("_s") - F.col("_size")).alias("before"))
    fits = last_within(placed, start.select("_g", "_at", (F.col("before") + most).alias("limit"))).withColumnRenamed("last", "last_fit")
    short = last_within(placed, start.select("_g", "_at", (F.col("before") + least).alias("limit")), strict=True).withColumnRenamed("last", "last_short")
    end = F.greatest(F.coalesce("last_fit", F.lit(-1)) + 1, F.col("_at") + 1)
    low = F.greatest(F.coalesce("last_short", F.lit(-1)) + 2, F.col("_at") + 1)
    bounds = cut(fits.join(short, ["_g", "_at"]).join(n, "_g").select("_g", "_at", end.alias("end"), low.alias("low"), "n_last"))
    open_ = F.col("end") <= F.col("n_last")
    choice = open_ & (F.col("low") <= F.col("end"))
    best = least_between(placed.select("_g", "_at", F.col("_sim").alias("v")), bounds.where(choice).select("_g", "_at", (F.col("low") - 1).alias("low"), (F.col("end") - 1).alias("high")))
    plain = bounds.where(~choice).select("_g", "_at", F.when(open_, F.col("end")).otherwise(F.col("n_last") + 1).alias("next"))
    pointers = plain.unionByName(best.select("_g", "_at", (F.col("place") + 1).alias("next")))
    return _bucketed(placed, pointers, rows.columns, name)
