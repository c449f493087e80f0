"""Hashed maximum-entropy language model with a class-factored softmax, and an add-one base.

P(word | history) = P(group | history) * P(class | group, history) * P(word | class, history). The
``TOP`` most frequent tokens of the training documents are dealt to classes in order of frequency;
every other word, seen or not, belongs to one of ``RARE`` classes by its first two bytes; ``SIDE``
classes that follow each other are a group. The factors are softmaxes over weights looked up by
hashed features: the word before (n-gram), the word before that (skip) and the pair. A class of rare words is a tree over the bits of their hashes, ``WAYS`` ways at a node, whose
decisions have n-gram and skip features too; within its leaf a word has its add-one share (unseen words of a leaf
share one more count, so the whole sums to one). Biases start from the corpus' counts. Trees and
tables of weights grow with the number of training types, up to ``DEEPEST`` levels and 2^``BITS`` rows.

Training is one epoch in ``ROUNDS`` parts: each task takes gradient steps over the small batches
of its own documents, from the model of the round before, and the changes of each row of weights
are averaged over the tasks that touched it, by fan-in of ``FAN`` so no task sums more.

Counts cover all training documents and stay distributed: tokens with at least N / ``HEAVY`` of
the N occurrences (so at most ``HEAVY`` of them) are sent to the tasks, the rest are joined.
Scoring runs over sparse features in numpy batches.

Defined cases: a null text has the end token only; a null id counts as the empty text in the split;
repeated rows count and are scored apart; of equally frequent tokens the one with the lesser hash is
first; without training documents every token is unknown, N and V are 0 and both scores are those of
one unseen type; a text of any length is hashed and scored piece by piece, holding its tokens; an
empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import discard, documents, durable, give_back, utf8
from folioscope.llm.words import mix, word_hashes

TOP, WORD_CLASSES, RARE = 1024, 32, 32
PER_CLASS = TOP // WORD_CLASSES
CLASSES = WORD_CLASSES + RARE
SIDE = 8
GROUPS = CLASSES // SIDE
#: Least and largest binary logarithms of the rows of weights: of groups, classes, words and trees.
BITS = ((15, 16), (16, 18), (14, 16), (15, 19))
#: What the rows have of the logarithm of the number of types: more or less so many.
_MORE = (-4, -2, -5, 0)
DEEPEST = 15
#: Ways at a node of a tree, and how many bits that is.
WAYS, STEP = 8, 3
ROUNDS = 2
HEAVY = 2_000_000
FAN = 64
#: Training tokens of a task: more make it learn longer before changes are averaged, fewer spread the work.
TASK_TOKENS, LEAST_TASKS = 1_000_000, 8
BATCH = 4096
#: Steps of groups, classes, words and trees.
RATES, DAMP = (0.15, 0.25, 0.5, 0.2), 2.0
#: Rows of a table that are summed at once.
_BLOCKS = (1 << 13, 1 << 13, 2048, 1 << 13)
_GATHER = 4_000_000
#: Weights that are changed at once.
_NEAR = 1 << 14
#: The least logarithm of a factor.
_LEAST = np.float32(np.log(1e-30))
_END = np.uint64(0x7E57ED0C00000000)
_START = np.uint64(0x57A2700000000000)
_LOW = np.uint64(RARE - 1)
#: Classes of rare words by their first two bytes.
_KINDS = mix(np.arange(1 << 16, dtype=np.uint64)) & _LOW
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tokens(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's tokens and one end: 64-bit hashes whose low bits are the class a rare word has."""
    for words, heads in word_hashes(texts, heads=True):
        found = np.empty(len(words) + 1, np.uint64)
        np.bitwise_and(words, ~_LOW, out=found[:-1])
        found[:-1] |= _KINDS.take(heads)
        found[-1] = _END
        yield found


def histories(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of several documents end to end, with the two tokens before each."""
    every = np.concatenate(docs)
    one, two = np.roll(every, 1), np.roll(every, 2)
    at = np.cumsum([0, *(len(d) for d in docs[:-1])])
    one[at] = _START
    two[at] = _START
    later = at[np.array([len(d) > 1 for d in docs])] + 1
    two[later] = _START
    return every, one, two


def aligned(shape: tuple[int, int]) -> np.ndarray:
    """Room for a table whose rows of 32 and 64 bytes lie in one line of the CPU's caches each."""
    size = shape[0] * shape[1] * 4
    held = np.empty(size + 64, np.uint8)
    at = -held.ctypes.data % 64
    return held[at : at + size].view(np.float32).reshape(shape)


def picked(rows: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where in the flat rows the column right of each row is."""
    return np.arange(0, rows.size, rows.shape[1]) + right


def feature_hash(x: np.ndarray) -> np.ndarray:
    """The first 31 bits of mix(x), whose last step leaves them as they are; x is overwritten."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
    return x


def cell_of(every: np.ndarray, depth: int) -> np.ndarray:
    kind = (every & _LOW).astype(np.int64) << depth
    return kind | (every >> np.uint64(64 - depth)).astype(np.int64) if depth else kind


class Model:
    """Weights and the numbers of the corpus that scoring needs."""

    def __init__(self, top: np.ndarray, top_counts: np.ndarray, rare_mass: np.ndarray, total: int, cells: np.ndarray | None = None, types: int = 0) -> None:
        """cells has the mass of each leaf, RARE rows of 2^depth; without them a class is one leaf."""
        order = np.argsort(top, kind="stable")
        self.top, self.place = top[order], order.astype(np.int64)  # by hash; the place is the rank by frequency
        #: Frequent tokens before those that begin with each 16 bits, and the most that begin alike.
        self.before = np.searchsorted(self.top, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.uint16)
        self.alike = int(np.bincount((self.top >> np.uint64(48)).astype(np.int64), minlength=1).max())
        self.rare_mass = rare_mass
        mass = np.concatenate([np.bincount(np.arange(len(top)) // PER_CLASS, top_counts + 1.0, WORD_CLASSES), rare_mass])
        grouped = mass.reshape(GROUPS, SIDE)
        log_share = lambda part, whole: np.where(part > 0, np.log(np.maximum(part, 1e-30) / np.maximum(whole, 1e-30)), -1e4).astype(np.float32)
        self.group_bias = log_share(grouped.sum(axis=1), mass.sum())
        self.class_bias = log_share(grouped, grouped.sum(axis=1, keepdims=True))
        inner = np.zeros(TOP)
        inner[: len(top)] = top_counts + 1.0
        inner = inner.reshape(WORD_CLASSES, PER_CLASS)
        self.word_bias = log_share(inner, inner.sum(axis=1, keepdims=True))
        cells = rare_mass[:, None] if cells is None else cells
        self.depth, self.log_cells = cells.shape[1].bit_length() - 1, np.log10(cells).ravel()
        self.levels = self.depth // STEP
        #: Nodes of a class by levels from the top, and the logarithms of their ways' shares.
        self.firsts = np.array([(WAYS**j - 1) // (WAYS - 1) for j in range(self.levels + 1)], np.int64)
        ways, below = [], cells
        for _ in range(self.levels):
            ways.append(below.reshape(len(below), -1, WAYS))
            below = ways[-1].sum(axis=2)
        shares = [log_share(w, w.sum(axis=2, keepdims=True)) for w in reversed(ways)]
        self.tree_bias = np.concatenate(shares, axis=1).reshape(-1, WAYS) if shares else np.zeros((0, WAYS), np.float32)
        wide = max(types - 1, 0).bit_length()
        self.bits = tuple(min(max(wide + more, least), most) for more, (least, most) in zip(_MORE, BITS, strict=True))
        widths = (GROUPS, SIDE, PER_CLASS, WAYS)
        #: Weights of groups, classes, words and trees.
        self.tables = [np.zeros((1 << bits, width), np.float32) for bits, width in zip(self.bits, widths, strict=True)]
        self.total = total

    def __setstate__(self, state: dict) -> None:
        """A task's copy has aligned tables."""
        self.__dict__ = dict(state)
        self.tables = []
        while state["tables"]:
            table = state["tables"].pop(0)
            self.tables.append(aligned(table.shape))
            self.tables[-1][:] = table

    def ranks(self, every: np.ndarray) -> np.ndarray:
        """The rank of frequent tokens, -1 for others."""
        found = np.full(len(every), -1)
        at = self.before.take((every >> np.uint64(48)).astype(np.int64)).astype(np.int64)
        for _ in range(self.alike):
            hit = np.flatnonzero(self.top.take(at, mode="clip") == every)
            found[hit] = self.place.take(at[hit], mode="clip")
            at += 1
        return found

    def classes(self, every: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.where(rank >= 0, rank // PER_CLASS, WORD_CLASSES + (every & _LOW).astype(np.int64))

    def cells(self, every: np.ndarray) -> np.ndarray:
        """The leaf of rare tokens: class and first bits."""
        return cell_of(every, self.depth)

    def tree_path(self, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes above each token's leaf (a row a level) and the way that is taken at each."""
        cell = self.cells(every)
        kind, leaf = cell >> self.depth, cell & ((1 << self.depth) - 1)
        down = np.arange(self.depth, 0, -STEP)[:, None]
        node = (leaf >> down) + kind * self.firsts[-1] + self.firsts[:-1, None]
        return node, (leaf >> (down - STEP)) & (WAYS - 1)

    def tree_features(self, one: np.ndarray, two: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            own = node.astype(np.uint64) * _B
            return self._rows(3, ((one * _A + own).ravel(), (two * _C + own).ravel()))

    def group_features(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return self._rows(0, (one * _A, two * _B, one * _A + two * _C))

    def class_features(self, one: np.ndarray, two: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            own = (side + 1).astype(np.uint64) * _C
            return self._rows(1, (one * _B + own, two * _A + own, one * _C + two * _B + own))

    def word_features(self, one: np.ndarray, two: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            own = group.astype(np.uint64) * _B
            return self._rows(2, (one * _A + own, one * _C + two * _A + own))

    def _rows(self, table: int, features: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        kind = np.uint16 if self.bits[table] <= 16 else np.uint32
        return [(feature_hash(h) >> np.uint64(64 - self.bits[table])).astype(kind) for h in features]

    def group_biases(self, n: int) -> np.ndarray:
        return self.group_bias[None].take(np.zeros(n, np.int64), axis=0)

    @staticmethod
    def logits(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        found = weights.take(rows[0], axis=0)
        for r in rows[1:]:
            found += weights.take(r, axis=0)
        found += bias
        return found

    def _log_chance(self, table: int, bias: np.ndarray, rows: list[np.ndarray], right: np.ndarray) -> np.ndarray:
        """Natural logarithms of what the softmaxes give to the right columns. Weights stay far below what
        overflows an exponential, so no maximum is taken off; a row's sum is the same wherever it stands."""
        found = self.logits(bias, self.tables[table], rows)
        out = found.ravel().take(picked(found, right))
        out -= np.log(np.einsum("ij->i", np.exp(found, out=found)))
        return out

    def log_chances(self, every: np.ndarray, one: np.ndarray, two: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log10 of P(class | history) and, for frequent tokens, of P(word | class); for others of P(leaf | class)."""
        group = self.classes(every, rank)
        side, place = group // SIDE, group & (SIDE - 1)
        p = self._log_chance(0, self.group_biases(len(group)), self.group_features(one, two), side)
        p += self._log_chance(1, self.class_bias.take(side, axis=0), self.class_features(one, two, side), place)
        out = np.maximum(p, _LEAST).astype(np.float64)
        known = np.flatnonzero(rank >= 0)
        if len(known):
            own = group[known]
            q = self._log_chance(2, self.word_bias.take(own, axis=0), self.word_features(one[known], two[known], own), rank[known] & (PER_CLASS - 1))
            out[known] += np.maximum(q, _LEAST)
        loose = np.flatnonzero(rank < 0)
        if len(loose) and self.depth:
            node, way = self.tree_path(every[loose])
            p = self._log_chance(3, self.tree_bias.take(node.ravel(), axis=0), self.tree_features(one[loose], two[loose], node), way.ravel())
            out[loose] += np.maximum(p, _LEAST).reshape(node.shape).sum(axis=0, dtype=np.float64)
        out /= np.log(10)
        return out


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of row numbers, and the numbers in it. Numbers of two bytes are sorted by counting; others
    are sorted together with their places, which is much faster than finding an order."""
    if rows.dtype == np.uint16:
        order = np.argsort(rows, kind="stable")
        return order, rows[order]
    packed = rows.astype(np.int64)
    packed <<= 32
    packed |= np.arange(len(rows))
    packed.sort()
    return packed & 0xFFFFFFFF, packed >> 32


def row_sums(slope: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over the square root of their number n of slope's rows that begin at first in order. Most
    rows of weights are met once in a step, so only the others are added up."""
    g = slope.take(order.take(first), axis=0)
    many = np.flatnonzero(n > 1)
    if len(many):
        times = n[many]
        starts = np.cumsum(times) - times
        held = order[np.repeat(first[many] - starts, times) + np.arange(starts[-1] + times[-1])]
        sums = np.add.reduceat(slope.take(held, axis=0), starts, axis=0)
        sums *= (1 / np.sqrt(times.astype(np.float32)))[:, None]
        g[many] = sums
    return g


def put_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row as one item, which numpy copies faster."""
    row = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(row).ravel()[at] = np.ascontiguousarray(rows).view(row).ravel()


class Learner:
    """Gradient steps (AdaGrad by weight) on a copy of the model's weights. Each row of weights is followed
    by that of its sums of squares, so that both come into the CPU's caches at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.start = model.tables
        self.pairs = [aligned((2 * len(w), w.shape[1])) for w in self.start]
        self.touched = [np.zeros(len(w), bool) for w in self.start]
        for pairs, w in zip(self.pairs, self.start, strict=True):
            pairs[::2], pairs[1::2] = w, DAMP
        model.tables = [pairs[::2] for pairs in self.pairs]
        #: What sums up a narrow row into all its columns.
        self.ones = [np.ones((w.shape[1], w.shape[1] if w.shape[1] <= 8 else 1), np.float32) for w in self.start]

    def step(self, every: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.model
        rank = m.ranks(every)
        group = m.classes(every, rank)
        side, place = group // SIDE, group & (SIDE - 1)
        self._softmax(0, m.group_biases(len(group)), m.group_features(one, two), side)
        self._softmax(1, m.class_bias.take(side, axis=0), m.class_features(one, two, side), place)
        known = np.flatnonzero(rank >= 0)
        if len(known):
            own = group[known]
            self._softmax(2, m.word_bias.take(own, axis=0), m.word_features(one[known], two[known], own), rank[known] & (PER_CLASS - 1))
        loose = np.flatnonzero(rank < 0)
        if len(loose) and m.depth:
            node, way = m.tree_path(every[loose])
            self._softmax(3, m.tree_bias.take(node.ravel(), axis=0), m.tree_features(one[loose], two[loose], node), way.ravel())

    def _softmax(self, table: int, bias: np.ndarray, features: list[np.ndarray], right: np.ndarray) -> None:
        pairs, n, rows = self.pairs[table], len(right), np.concatenate(features)
        held = pairs.take(rows.astype(np.int64) << 1, axis=0)
        slope = held[:n] + bias
        for at in range(n, len(rows), n):
            slope += held[at : at + n]
        np.exp(slope, out=slope)
        slope /= slope @ self.ones[table]
        slope.ravel()[picked(slope, right)] -= 1
        order, ordered = in_order(rows)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        at = ordered.take(first).astype(np.int64)
        self.touched[table][at] = True
        g = row_sums(slope, np.tile(np.arange(n), len(features)).take(order), first, np.diff(np.append(first, len(rows))))
        size = _NEAR // slope.shape[1]
        for i in range(0, len(at), size):
            self._move(table, at[i : i + size], g[i : i + size])

    def _move(self, table: int, at: np.ndarray, g: np.ndarray) -> None:
        """A step of rows that are few enough to stay in a CPU's own cache from the first access to the last."""
        pairs, at = self.pairs[table], at << 1
        square = pairs.take(at + 1, axis=0)
        square += g * g
        put_rows(pairs, at + 1, square)
        np.sqrt(square, out=square)
        g *= RATES[table]
        g /= square
        weights = pairs.take(at, axis=0)
        weights -= g
        put_rows(pairs, at, weights)

    def changes(self) -> pd.DataFrame:
        """The changes of each block's touched rows as 16-bit floats, and a bit for each row of the block."""
        out = []
        for table, (pairs, old) in enumerate(zip(self.pairs, self.start, strict=True)):
            size = _BLOCKS[table]
            for at in range(0, len(old), size):
                touched = self.touched[table][at : at + size]
                rows = np.flatnonzero(touched) + at
                if len(rows):
                    delta = pairs.take(2 * rows, axis=0)
                    delta -= old.take(rows, axis=0)
                    out.append((table, at, delta.astype(np.float16).tobytes(), np.packbits(touched).tobytes()))
        return pd.DataFrame(out, columns=["part", "at", "delta", "tasks"])


def batches_of(docs: Iterator[np.ndarray], size: int = BATCH) -> Iterator[list[np.ndarray]]:
    held: list[np.ndarray] = []
    n = 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def cut(docs: list[np.ndarray], size: int = 2 * BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens and histories in pieces, so that a long document needs no more memory than others."""
    every, one, two = histories(docs)
    for at in range(0, len(every), size):
        yield every[at : at + size], one[at : at + size], two[at : at + size]


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n) over the column body; each task adds up before the shuffle."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for t in tokens(utf8(b["body"].tolist())):
                held.append(t)
                n += len(t)
                if n >= _GATHER:
                    yield _counted(held)
                    held, n = [], 0
        if held:
            yield _counted(held)

    return rows.select("body").mapInPandas(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    token, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"token": token.view(np.int64), "n": n})


def _summed(df: DataFrame, tasks: int) -> DataFrame:
    """Sum deltas by block, FAN tasks' at a time."""

    widths = (GROUPS, SIDE, PER_CLASS, WAYS)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part, width = group["part"].iloc[0], widths[group["part"].iloc[0]]
        delta, count = np.zeros((_BLOCKS[part], width), np.float32), np.zeros(_BLOCKS[part], np.int32)
        for single, d, c in zip(group["single"], group["delta"], group["tasks"], strict=True):
            if single:
                touched = np.flatnonzero(np.unpackbits(np.frombuffer(c, np.uint8))[: len(count)])
                more = delta.take(touched, axis=0)
                more += np.frombuffer(d, np.float16).reshape(-1, width)
                put_rows(delta, touched, more)
                count[touched] += 1
            else:
                delta += np.frombuffer(d, np.float32).reshape(-1, width)
                count += np.frombuffer(c, np.int32)
        return pd.DataFrame({"part": [part], "at": [group["at"].iloc[0]], "task": [group["task"].iloc[0] // FAN], "single": [False], "delta": [delta.tobytes()], "tasks": [count.tobytes()]})

    schema = "part int, at int, task bigint, single boolean, delta binary, tasks binary"
    while True:
        df = df.groupBy("part", "at", F.floor(F.col("task") / FAN)).applyInPandas(run, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return df


def train(rows: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """One epoch over (id, body) in rounds; each document is in one of them."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds))
    for r in range(rounds):
        shipped = spark.sparkContext.broadcast(model)
        drawn = rows.where(part == r).select("body")
        drawn = drawn.coalesce(max(LEAST_TASKS, model.total // rounds // TASK_TOKENS)).withColumn("task", F.spark_partition_id().cast("bigint"))

        def run(batches, shipped=shipped):
            learner, task = Learner(shipped.value), []

            def docs():
                for b in batches:
                    task[:] = [b["task"].iloc[0]] if len(b) else task
                    yield from tokens(utf8(b["body"].tolist()))

            for held in batches_of(docs()):
                for piece in cut(held):
                    learner.step(*piece)
            found = learner.changes()
            learner.model.tables = learner.start
            if task:
                yield found.assign(task=task[0], single=True)

        changes = drawn.mapInPandas(run, "part int, at int, delta binary, tasks binary, task bigint, single boolean")
        table = durable(_summed(changes, drawn.rdd.getNumPartitions()), "lm-changes")
        new = Model.__new__(Model)
        new.__dict__ = dict(model.__dict__, tables=[w.copy() for w in model.tables])
        for row in table.toLocalIterator():  # the size of the model, a part at a time
            weights = new.tables[row["part"]]
            block = weights[row["at"] : row["at"] + _BLOCKS[row["part"]]]
            delta = np.frombuffer(row["delta"], np.float32).reshape(-1, block.shape[1]) / np.maximum(1, np.frombuffer(row["tasks"], np.int32))[:, None]
            block += delta[: len(block)]
        discard(table)
        shipped.destroy()
        model = new
        give_back()
    return model


def fit(counts: DataFrame, training: DataFrame) -> tuple[Model, dict]:
    """The model, and N, V and the tokens with at least N / HEAVY occurrences (hashes and counts)."""
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, types = sums["n"] or 0, sums["v"]
    top = counts.orderBy(F.desc("n"), "token").limit(TOP).collect()
    hashes = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    number = np.array([r["n"] for r in top], float)
    depth = min(-(-max((types // RARE).bit_length() - 2, 0) // STEP) * STEP, DEEPEST)
    cell = F.shiftleft(F.col("token").bitwiseAND(RARE - 1), depth)
    cell = cell.bitwiseOR(F.shiftrightunsigned("token", 64 - depth)) if depth else cell
    mass = counts.groupBy(cell.alias("cell")).agg(F.sum(F.col("n") + 1).alias("mass")).toPandas()  # 2^DEEPEST rows a class at most
    cells = np.ones(RARE << depth)
    cells[mass["cell"].to_numpy(np.int64)] += mass["mass"].to_numpy(float)
    np.subtract.at(cells, cell_of(hashes, depth), number + 1)
    cells = np.maximum(cells, 1.0).reshape(RARE, -1)
    model = Model(hashes, number, cells.sum(axis=1), total or 0, cells, types)
    model = train(training, model) if total else model
    heavy = counts.where(F.col("n") >= F.lit(max(1, total / HEAVY))).toPandas().sort_values("token") if total > HEAVY else counts.orderBy("token").toPandas()
    token = heavy["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token, kind="stable")
    del top, mass
    give_back()
    return model, {"n": total, "v": types, "token": token[order], "count": heavy["n"].to_numpy(np.int64)[order], "all": total <= HEAVY}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), fold.alias("held_out"))
    training = rows.where(~F.col("held_out")).select("id", "body")
    counts = durable(token_counts(training), "lm-counts")
    model, known = fit(counts, training)
    shipped = rows.sparkSession.sparkContext.broadcast((model, known))

    def run(batches):
        own, heavy = shipped.value
        for b in batches:
            out = []
            for group in batches_of(tokens(utf8(b["body"].tolist()))):
                logs, bases, seen = [], [], []
                for every, one, two in cut(group):
                    # Distinct tokens in order are looked up much faster than all as they come.
                    types, place = np.unique(every, return_inverse=True)
                    rank = own.ranks(types).take(place)
                    at = np.minimum(np.searchsorted(heavy["token"], types), len(heavy["token"]) - 1)
                    n = np.where(heavy["token"][at] == types, heavy["count"][at], 0) if len(heavy["token"]) else np.zeros(len(types), np.int64)
                    base = np.log10(n + 1.0).take(place)
                    chance = own.log_chances(every, one, two, rank)
                    loose = rank < 0
                    chance[loose] += base[loose] - own.log_cells[own.cells(every[loose])]
                    logs.append(chance)
                    bases.append(base)
                    seen.append((n > 0).take(place))
                chance, base, has = (np.concatenate(x) for x in (logs, bases, seen))
                at = 0
                for d in group:
                    s = slice(at, at + len(d))
                    unknown, times = np.unique(d[~has[s]], return_counts=True) if not heavy["all"] else (d[:0], np.zeros(0, int))
                    out.append((len(d), int(np.count_nonzero(has[s])), float(base[s].sum()), float(chance[s].sum()), unknown.view(np.int64), times))
                    at += len(d)
            yield pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "chance", "unknown", "times"]).assign(id=b["id"].values, held_out=b["held_out"].values)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInPandas(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, chance double, unknown array<bigint>, times array<int>")
    whole = known["n"] + known["v"] + 1
    final = [F.lit(known["n"]).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"), F.col("chance").alias("score")]
    if known["all"]:
        return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", *final)
    # Tokens that are not heavy meet their counts in a join; a row number of the written table brings
    # the sums back to their document.
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    loose = scored.select("row", F.explode(F.arrays_zip("unknown", "times")).alias("x")).select("row", F.col("x.unknown").alias("token"), F.col("x.times").alias("times"))
    found = loose.join(counts.hint("shuffle_hash"), "token").select("row", (F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.col("times").cast("bigint").alias("more_known"))
    nothing = {name: F.lit(None).cast(t) for name, t in (("id", kind), ("held_out", "boolean"), ("n_tokens", "bigint"))}
    parts = scored.select("row", "id", "held_out", "n_tokens", "n_known", "base", "chance").unionByName(
        found.select("row", *[c.alias(n) for n, c in nothing.items()], F.col("more_known").alias("n_known"), F.col("more").alias("base"), F.col("more").alias("chance"))
    )
    summed = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("chance").alias("chance"))
    return summed.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", *final)


def op1(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
