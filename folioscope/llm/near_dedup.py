"""N-gram Jaccard join with vertical partitioning.

A document is the set of its distinct word shingles. All shingles have one global order: by hash,
but those that many documents have among their first shingles come last, by how many. Any order
gives the same result; this one keeps common passages out of the candidates. Documents of equal
sets are one class. Two classes can be similar enough only if they share a shingle within their
first few (their prefix), which gives the candidate pairs. The global order is cut into fragments;
for each candidate pair the overlap is counted in each fragment apart, from the fragments' own
rows, and the parts are summed per pair. Before that a pair must pass the first fragment: the
prefixes' overlap bounds that of the sets.

A shingle that more than ``SMALL`` classes have in their prefixes doesn't give all pairs (if the list
of frequent shingles is full, one that more have than the last one listed): its
classes are dealt to bands of size, and each is compared with the first class of its own band and
of the one below (the hubs); similar sets are in the same or neighbouring bands. Members that this
did not connect to their hub are then compared with those of other components in blocks of about
``BLOCK`` times ``ROOM`` shingles, whose tasks count overlaps by fragment and return a spanning forest. Every pair
that shares a prefix shingle is thus either compared or known to be connected, so components are
exact; nothing is capped.

Rows are numbered in a written table first, and texts are fetched by that number, so equal or null
ids cost nothing. Of a component the row with the smallest id is kept, of equal ids the first row.

Defined cases: a text with fewer words than a shingle is one shingle; a null text or one without
words is the empty set, linked with nothing and kept; rows of a null id take part but are never a
component's name unless there is no other; repeated rows are copies of each other, and one of them
is kept; a text of any length is hashed piece by piece; an empty table gives an empty result; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.runtime import discard, documents, durable, small, spread_join, tidy, unused, utf8
from folioscope.llm.words import mix, shingles, word_hashes

#: Shingles that either count puts last in the order at most; a driver and each task hold them (16 bytes each).
MOST_FREQUENT = 1 << 18
SMALL = 16
#: Classes that a shingle may have and still give all its pairs, where the list of frequent ones is full.
LONGEST = 1024
#: Classes of a block if they have ROOM shingles each; of shorter ones a block holds more.
BLOCK, ROOM = 128, 1024
#: Three ranges of hashes and the frequent shingles. More would only add rows: a fragment of the
#: longest texts is some ten thousand numbers already.
FRAGMENTS = 4
#: Share of hashes that may be in a prefix, beyond what the threshold asks for.
SLACK = 0.4
#: Hashes that a task counts at once.
_GATHER = 2_000_000


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles must hold one that any similar set has in its own first ones."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sets_of(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield np.unique(shingles(words, k))


def often(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many documents have each token among their first ones, 0 if few."""
    known, count = frequent
    if not len(known):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, count[at], 0)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set (its tokens in ascending order)."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
        parts = [mix(tokens * np.uint64(c) + place * np.uint64(d)).sum(dtype=np.uint64) + np.uint64(len(tokens)) for c, d in ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))]
    return tuple(int(p.view(np.int64)) for p in parts)


def low_cut(percent: int) -> int:
    """Hashes below this are counted: a prefix lies below it unless much of it is frequent."""
    return int(min(1.0, (1 - percent / 100) * (1 + SLACK) + 0.01) * (1 << 64)) - 1


def document_sets(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(row, id, n, k1, k2, low) of rows (row, id, body), written; low holds the smallest hashes: at
    least a prefix and all that are counted."""
    cut = np.uint64(low_cut(percent))

    def run(batches):
        for b in batches:
            out = []
            for tokens in sets_of(utf8(b["body"].tolist()), k):
                size = max(prefix_length(len(tokens), percent), int(np.searchsorted(tokens, cut)))
                out.append((len(tokens), *digest(tokens), tokens[:size].copy().view(np.int64)))
            yield pd.DataFrame(out, columns=["n", "k1", "k2", "low"]).assign(row=b["row"].values, id=b["id"].values)

    kind = rows.schema["id"].dataType.simpleString()
    return durable(rows.mapInPandas(tidy(run), f"row bigint, id {kind}, n bigint, k1 bigint, k2 bigint, low array<bigint>"), "jaccard-sets")


def frequent_shingles(sets: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Low hashes that more than SMALL documents have, and how many have each; counted over all."""
    cut = np.uint64(low_cut(percent))

    def run(batches):
        held, size = [], 0
        for b in batches:
            every = np.concatenate([np.asarray(x, np.int64) for x in b["low"]] or [np.zeros(0, np.int64)])
            held.append(every[every.view(np.uint64) < cut])
            size += len(held[-1])
            if size >= _GATHER:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    def counts(held: list[np.ndarray]) -> pd.DataFrame:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"token": token, "n": n})

    counted = sets.select("low").mapInPandas(tidy(run), "token bigint, n bigint")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > SMALL).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


_PREFIX = "cid bigint, n bigint, prefix array<bigint>, own int, spare int, last_often bigint, last bigint"
_COLUMNS = ["cid", "n", "prefix", "own", "spare", "last_often", "last"]


def _prefix(n: int, ordered: np.ndarray, freq: np.ndarray, percent: int) -> tuple:
    """Columns n to last of _PREFIX, given a prefix of tokens in the global order."""
    last = (int(freq[-1]), int((ordered[-1:] ^ np.uint64(1 << 63)).view(np.int64)[0]))
    spare = (freq > 0) | (ordered >= np.uint64(low_cut(percent)))
    return n, ordered.view(np.int64), int((freq == 0).sum()), int(spare.sum()), *last


def _rare_prefix(n: int, low: np.ndarray, percent: int, frequent) -> np.ndarray | None:
    """The prefix if low hashes that are not frequent suffice for it."""
    tokens = np.asarray(low, np.int64).view(np.uint64)
    rare = tokens[often(tokens, frequent) == 0]
    size = prefix_length(n, percent)
    return rare[:size] if len(rare) >= size else None


def merged_counts(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several tables of frequent shingles as one, the larger count of each."""
    token, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((-count, token))
    token, count = token[order], count[order]
    first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    return token[first], count[first]


def with_higher(rows: DataFrame, sets: DataFrame, reps: DataFrame, k: int, percent: int, frequent) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """frequent with the shingles that are frequent among the classes whose low hashes mostly are:
    the next ones of a text with many near copies are as common as the first. Also the texts of
    these classes (cid, body)."""
    shipped = rows.sparkSession.sparkContext.broadcast(frequent)

    def wanting(batches):
        for b in batches:
            lacks = [_rare_prefix(n, low, percent, shipped.value) is None for n, low in zip(b["n"], b["low"], strict=True)]
            yield b.loc[lacks, ["row"]]

    lacking = sets.where("n > 0").select("row", "n", "low").mapInPandas(tidy(wanting), "row bigint").withColumnRenamed("row", "cid")
    lacking = durable(reps.select("cid").join(lacking, "cid", "left_semi"), "jaccard-lacking")

    def count(batches):
        for b in batches:
            token, n = np.unique(np.concatenate(list(sets_of(utf8(b["body"].tolist()), k))), return_counts=True)
            yield pd.DataFrame({"token": token.view(np.int64), "n": n})

    texts = durable(texts_of(rows, lacking), "jaccard-texts")
    discard(lacking)
    counted = texts.select("body").mapInPandas(tidy(count), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") > SMALL).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    return merged_counts(frequent, (top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))), texts


def prefixes(rows: DataFrame, sets: DataFrame, reps: DataFrame, k: int, percent: int, frequent, texts: DataFrame) -> DataFrame:
    """(cid, n, prefix, own, spare, last_often, last) of classes; own is how many shingles of
    the prefix are not frequent, spare how many are frequent or were not counted, (last_often, last)
    the place of its last one in the global order. Where too many low hashes are frequent, the text is
    needed: it is among texts (cid, body), or read again."""
    shipped = rows.sparkSession.sparkContext.broadcast(frequent)

    def from_low(batches):
        for b in batches:
            out = []
            for cid, n, low in zip(b["row"], b["n"], b["low"], strict=True):
                rare = _rare_prefix(n, low, percent, shipped.value)
                out.append((cid, n, None, 0, 0, 0, 0) if rare is None else (cid, *_prefix(n, rare, np.zeros(len(rare), np.int64), percent)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    first = durable(sets.where("n > 0").select("row", "n", "low").mapInPandas(tidy(from_low), _PREFIX), "jaccard-prefixes")
    missing = first.where("prefix IS NULL").select("cid").join(texts.select("cid"), "cid", "left_anti")
    wanted = reps.select("cid").join(missing, "cid", "left_semi")

    def from_text(batches):
        for b in batches:
            out = []
            for cid, tokens in zip(b["cid"], sets_of(utf8(b["body"].tolist()), k), strict=True):
                freq = often(tokens, shipped.value)
                order = np.lexsort((tokens, freq))[: prefix_length(len(tokens), percent)]
                out.append((cid, *_prefix(len(tokens), tokens[order], freq[order], percent)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    more = durable(wanted, "jaccard-again")
    again = durable(texts.unionByName(texts_of(rows, more)).mapInPandas(tidy(from_text), _PREFIX), "jaccard-ordered")
    discard(more)
    return first.where("prefix IS NOT NULL").join(reps.select("cid"), "cid", "left_semi").unionByName(again)


_PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64()), ("spare", pa.int64()), ("star", pa.bool_())])


def band_width(percent: int) -> float:
    """Sets that are similar enough differ by this at most in the logarithm of their size."""
    return float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1e-6


def bucket_pairs(percent: int, small: int = SMALL):
    """A function over batches of (token, cid, n, spare) sorted by (token, n, cid): all pairs of a small
    run, stars of a large one."""
    width = band_width(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [np.zeros(0, np.int64)] * 4, False  # the last run so far; of a large one, its last two hubs
        for batch in batches:
            token, cid, n, spare = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            if not len(token):
                continue
            yield from emit(token, cid, n, spare, large, False)
            first = int(np.searchsorted(token, token[-1]))
            large = len(token) - first > small or large and first == 0
            at = np.arange(first, len(token))
            if large:
                band = np.floor(np.log(n[first:]) / width)
                at = first + np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))[-2:]
            held = [a[at] for a in (token, cid, n, spare)]
        if len(held[0]):
            yield from emit(*held, large, True)

    def emit(token, cid, n, spare, goes_on, last):
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        run_of = np.repeat(np.arange(len(start)), size)
        large = size > small
        large[0] |= goes_on
        usable = ~large
        if not last:
            usable[-1] = False  # it may go on in the next batch
        usable = usable[run_of]
        found = []

        def pair(i, j, star):
            if len(i):
                x, y = (i, j) if star else (np.where(cid[i] < cid[j], i, j), np.where(cid[i] < cid[j], j, i))
                found.append((cid[x], cid[y], n[x], n[y], np.minimum(spare[x], spare[y]), np.full(len(i), star)))

        for gap in range(1, min(small, len(token))):
            i = np.flatnonzero(usable[:-gap] & (run_of[gap:] == run_of[:-gap]))
            if not len(i):
                break
            pair(*(a[100 * n[i] >= percent * n[i + gap]] for a in (i, i + gap)), False)
        i = np.flatnonzero(large[run_of])
        if len(i):
            band = np.floor(np.log(n[i]) / width).astype(np.int64)
            new = np.concatenate([[True], (run_of[i][1:] != run_of[i][:-1]) | (band[1:] != band[:-1])])
            part = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            hub = i[head[part]]
            below = np.maximum(part - 1, 0)
            near = (part > 0) & (run_of[i] == run_of[i[head[below]]]) & (band == band[head[below]] + 1)
            under = i[head[below]]
            other = i != hub
            pair(hub[other], i[other], True)
            pair(under[near], i[near], True)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_PAIRS)

    return run


def longest_run(counted: tuple[np.ndarray, np.ndarray]) -> int:
    """How many documents may have a low hash that is not in the list of frequent_shingles: no more than
    have the last one of a full list."""
    return int(counted[1].min()) if len(counted[0]) >= MOST_FREQUENT else SMALL


def is_cut(longest: int) -> bool:
    """Shingles that are not in the list may be in runs too long for all their pairs."""
    return longest > LONGEST


def candidate_pairs(ready: DataFrame, percent: int, frequent, longest: int) -> DataFrame:
    """(x, y, nx, ny, star), distinct, of classes (cid, n, prefix, own, spare); a star's x is its hub.

    Pairs that are in no star have all their common shingles counted here, but for spare ones, so
    those whose prefixes overlap too little are left out at once. That holds for a full list of
    frequent shingles too, as runs of ``longest`` classes give all their pairs.
    """
    small = SMALL if is_cut(longest) else longest
    schema = "x bigint, y bigint, nx bigint, ny bigint, spare bigint, star boolean"
    entries = ready.select(F.explode("prefix").alias("token"), "cid", "n", F.col("spare").cast("bigint").alias("spare"), "own")
    known = ready.sparkSession.createDataFrame(pd.DataFrame({"token": frequent[0].view(np.int64)}), "token bigint")  # twice MOST_FREQUENT rows at most
    # Hubs of frequent shingles come from a partially aggregated minimum, and the join with this one
    # row a shingle and band can be broadcast or split, so no task gets all that share a passage. The
    # class with fewest shingles of its own is the hub: of copies that differ, it is nearest to all.
    common = entries.where("spare > 0").join(F.broadcast(known), "token").withColumn("band", F.floor(F.log("n") / band_width(percent)).cast("int"))
    hubs = common.groupBy("token", F.col("band").alias("hub_band")).agg(F.min(F.struct("own", "cid", "n", "spare")).alias("hub"))
    both = common.select("*", F.explode(F.array("band", F.col("band") - 1)).alias("hub_band"))
    from_common = both.join(hubs, ["token", "hub_band"]).where(F.col("cid") != F.col("hub.cid")).select(
        F.col("hub.cid").alias("x"), F.col("cid").alias("y"), F.col("hub.n").alias("nx"), F.col("n").alias("ny"), F.least("spare", "hub.spare").alias("spare"), F.lit(True).alias("star")
    )
    rare = entries.join(F.broadcast(known), "token", "left_anti").select("token", "cid", "n", "spare")
    from_rare = rare.repartition("token").sortWithinPartitions("token", "n", "cid").mapInArrow(bucket_pairs(percent, small), schema)
    summed = from_rare.unionByName(from_common).groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.max("star").alias("star"), F.min("spare").alias("spare"), F.count(F.lit(1)).alias("same"))
    # What follows a prefix of n shingles: ceil(percent * n / 100) - 1.
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    most = F.greatest(rest("nx"), rest("ny")) + F.col("same") + F.col("spare")
    near = F.lit(is_cut(longest)) | F.col("star") | (most * (100 + percent) >= least_overlap(F.col("nx"), F.col("ny"), percent))
    return summed.where(near).select("x", "y", "nx", "ny", "star")


def least_overlap(nx, ny, percent: int):
    """The overlap that similar sets of these sizes have at least, times 100 + percent."""
    return (nx + ny) * percent


def possible(pairs: DataFrame, ready: DataFrame, percent: int, longest: int) -> DataFrame:
    """Pairs of stars whose first fragment, the overlap of their prefixes, leaves them possible. The
    members of stars have spare shingles, unless the list of frequent ones leaves out long runs: then any
    class may be in a star."""
    fit = pairs.where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    place = (ready if is_cut(longest) else ready.where("spare > 0")).select("cid", F.col("prefix").alias("own"), "last_often", "last")
    for side in ("x", "y"):
        fit = fit.join(place.select(F.col("cid").alias(side), F.col("own").alias(f"own_{side}"), F.struct("last_often", "last").alias(f"last_{side}")), side)
    same = F.size(F.array_intersect("own_x", "own_y"))
    # All of the smaller-ending prefix lies within the other prefix's range: what it doesn't share is lost.
    most = F.when(F.col("last_x") <= F.col("last_y"), F.col("nx") - F.size("own_x")).otherwise(F.col("ny") - F.size("own_y")) + same
    return fit.where(most * (100 + percent) >= least_overlap(F.col("nx"), F.col("ny"), percent)).select("x", "y", "nx", "ny", "star")


def seen_classes(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    seen = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).distinct()
    return durable(reps.join(seen, "cid", "left_semi").select("cid"), "jaccard-wanted")


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, body) of wanted classes, whose cid is the number of their first row. The wanted numbers
    are broadcast while a count says that they are few, else texts and numbers are shuffled."""
    return rows.select(F.col("row").alias("cid"), "body").join(small(wanted.select("cid")), "cid")


def fragments(rows: DataFrame, wanted: DataFrame, k: int, frequent) -> DataFrame:
    """(cid, f, tokens) of wanted classes: the texts are read again and cut by the global order."""
    shipped = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for b in batches:
            out = []
            for cid, tokens in zip(b["cid"], sets_of(utf8(b["body"].tolist()), k), strict=True):
                part = ((tokens >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int64)
                part[often(tokens, shipped.value) > 0] = FRAGMENTS - 1
                out += [(cid, f, tokens[part == f].view(np.int64)) for f in range(FRAGMENTS)]
            yield pd.DataFrame(out, columns=["cid", "f", "tokens"])

    # A row for each fragment, also if it is empty.
    return durable(texts_of(rows, wanted).mapInPandas(tidy(run), "cid bigint, f int, tokens array<bigint>"), "jaccard-fragments")


def overlaps(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """Pairs with linked: partial overlaps of each fragment, summed per pair."""
    left = pairs.hint("merge").join(cut.select(F.col("cid").alias("x"), "f", F.col("tokens").alias("left")), "x")
    both = left.hint("merge").join(cut.select(F.col("cid").alias("y"), "f", F.col("tokens").alias("right")), ["y", "f"])
    part = both.select("x", "y", "f", "nx", "ny", F.size(F.array_intersect("left", "right")).alias("part"))
    summed = part.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("part").alias("same"))
    return summed.withColumn("linked", F.col("same") * 100 >= (F.col("nx") + F.col("ny") - F.col("same")) * percent)


def forest(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (cid, root, tokens) that connect different roots, a forest of them;
    tokens has one array a fragment, whose overlaps are counted apart and summed per pair."""
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while (b := parent.setdefault(a, a)) != a:
            parent[a] = a = parent.setdefault(b, b)
        return a

    names, roots = right["cid"].tolist(), right["root"].tolist()
    index = []
    for f in range(FRAGMENTS):
        own = [np.asarray(t[f]) for t in right["tokens"]]
        tokens, holder = np.concatenate(own), np.repeat(np.arange(len(own)), [len(t) for t in own])
        order = np.argsort(tokens, kind="stable")
        index.append((tokens[order], holder[order]))
    sizes = np.array([sum(map(len, t)) for t in right["tokens"]])
    out = []
    for cid, root, mine in left[["cid", "root", "tokens"]].itertuples(index=False):
        size = sum(map(len, mine))
        if not ((100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (np.array(roots) != root)).any():
            continue
        same = np.zeros(len(names), np.int64)
        for (tokens, holder), part in zip(index, mine, strict=True):
            low, high = np.searchsorted(tokens, part, "left"), np.searchsorted(tokens, part, "right")
            times = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(part) else low
            same += np.bincount(holder[at], minlength=len(names))
        for j in np.flatnonzero(same * 100 >= (size + sizes - same) * percent).tolist():
            a, b = find(root), find(roots[j])
            if a != b:
                parent[a] = b
                out.append((cid, names[j]))
    return out


def between_blocks(rows: DataFrame, star: DataFrame, roots: DataFrame, reps: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """Links (a, b) inside stars (x, y) between what their hub hasn't connected."""
    # Stars whose hubs are connected are one group, named by their root: they share most members.
    by_root = star.join(roots.select(F.col("node").alias("x"), F.col("root").alias("hub")), "x", "left").select(F.coalesce("hub", "x").alias("hub"), "x", "y")
    members = by_root.select("hub", F.col("y").alias("cid")).unionByName(by_root.select("hub", F.col("x").alias("cid"))).distinct()
    named = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    loose = named.withColumn("loose", F.col("root") != F.col("hub"))
    sized = loose.join(reps.select("cid", F.col("n").alias("mass")), "cid")
    own = F.when(F.col("loose"), F.col("mass"))
    sizes = sized.groupBy("hub").agg(F.count(F.lit(1)).alias("all_n"), F.sum("mass").alias("all_mass"), F.sum(own).alias("loose_mass")).where("loose_mass > 0 AND all_n > 2")
    placed = durable(
        loose.join(sizes, "hub").select(
            "hub", "cid", "root", "loose",
            F.ceil(F.col("all_mass") / (BLOCK * ROOM)).cast("int").alias("right_n"), F.ceil(F.col("loose_mass") / (BLOCK * ROOM)).cast("int").alias("left_n"),
        ), "jaccard-placed",
    )
    if placed.isEmpty():
        return placed.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    spot = F.xxhash64("cid")
    right = placed.select("hub", "cid", "root", F.lit(False).alias("is_left"), F.explode(F.sequence(F.lit(0), F.col("left_n") - 1)).alias("left_at"), F.pmod(spot, "right_n").cast("int").alias("right_at"))
    left = placed.where("loose").select("hub", "cid", "root", F.lit(True).alias("is_left"), F.pmod(spot, "left_n").cast("int").alias("left_at"), F.explode(F.sequence(F.lit(0), F.col("right_n") - 1)).alias("right_at"))
    wanted = durable(placed.select("cid").distinct(), "jaccard-members")
    cut = fragments(rows, wanted, k, frequent)
    discard(wanted)
    whole = cut.groupBy("cid").agg(F.array(*[F.max(F.when(F.col("f") == f, F.col("tokens"))) for f in range(FRAGMENTS)]).alias("tokens"))
    filled = left.unionByName(right).join(whole, "cid")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        usable = group["is_left"].any() and not group["is_left"].all()
        return pd.DataFrame(forest(group[group["is_left"]], group[~group["is_left"]], percent) if usable else [], columns=["a", "b"])

    return filled.groupBy("hub", "left_at", "right_at").applyInPandas(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, class_id (equal sets share one), row and
    kept. ``row_col`` is a number of the rows that a written table has; without it one is written."""
    if row_col:
        rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    else:
        rows = durable(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body")), "jaccard-rows")
    full = document_sets(rows, k, percent)
    sets = durable(full.drop("low"), "jaccard-documents")
    # The first of a class or component: the least id that isn't null, then the least row.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    classes = durable(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("cid"), first, F.count(F.lit(1)).alias("rows")), "jaccard-classes")
    reps = durable(sets.where("n > 0").withColumnRenamed("row", "cid").join(classes.select("cid"), "cid", "left_semi").select("cid", "n"), "jaccard-reps")
    counted = frequent_shingles(full, percent)
    longest = longest_run(counted)
    frequent, texts = with_higher(rows, full, reps, k, percent, counted)
    ready = durable(prefixes(rows, full, reps, k, percent, frequent, texts), "jaccard-ready")
    discard(full, texts)
    found = durable(candidate_pairs(ready, percent, frequent, longest), "jaccard-pairs")
    pairs = durable(found.where("NOT star").unionByName(possible(found.where("star"), ready, percent, longest)), "jaccard-possible")
    discard(ready)
    wanted = seen_classes(pairs, reps)
    cut = fragments(rows, wanted, k, frequent)
    links = durable(overlaps(pairs, cut, percent).where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")), "jaccard-links")
    discard(pairs, wanted, cut)
    roots = components(links, "jaccard-first")
    star = found.where("star")
    if not star.isEmpty():
        more = durable(between_blocks(rows, star, roots, reps, k, percent, frequent), "jaccard-more")
        if not more.isEmpty():
            before, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "jaccard-all")
            discard(before)
        discard(more)
    discard(found, links)
    named = durable(classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "jaccard-named")
    discard(classes, reps, roots)
    least = durable(named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("classes")), "jaccard-least")
    by_class = durable(spread_join(named.drop("first"), least, ["root"], "classes").select("k1", "k2", "least", F.col("cid").alias("class_id"), "rows"), "jaccard-by-class")
    discard(named, least)
    linked = spread_join(sets.where("n > 0"), by_class, ["k1", "k2"], "rows")
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    alone = sets.where("n = 0").select(*columns, F.col("id").alias("component_id"), F.lit(None).cast("bigint").alias("class_id"), "row", F.lit(True).alias("kept"))
    return linked.select(*columns, F.col("least.id").alias("component_id"), "class_id", "row", (F.col("row") == F.col("least.row")).alias("kept")).unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the first of the id it is named after, with all columns."""
    row = unused(docs, "row_number")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-numbered")
    gone = durable(jaccard_components(numbered, k, percent, id_col, text_col, row).where("NOT kept").select(F.col("row").alias(row)), "jaccard-gone")
    return numbered.join(small(gone), row, "left_anti").drop(row)


def op3(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 3, 90).select("doc_id", "n_shingles", "component_id")
