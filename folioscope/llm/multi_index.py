"""Near-duplicate embeddings through an inverted multi-index.

Vectors are normalised and cut into halves; each half has a codebook of its own, and the two make a
product grid. A vector lies in the cell of its nearest centroids. How far it is from another cell is
bounded half by half: to be nearer to centroid i than to its own centroid c, a half must move at least
(|x - i|^2 - |x - c|^2) / (2 |i - c|). The two lists of bounds are traversed together, nearest cells
first, until the sum of squares passes a radius. A pair at the threshold can be no farther apart than
the distance that belongs to it, so with that as radius (``recall=1``) no pair is missed. For a lower
target the radius is the quantile of what pairs at the threshold itself need: vectors of the sample are
moved by just that much, evenly in all directions and in few coordinates, and the larger quantile counts.
Of two cells only the one of lower number visits the other, so no pair is met twice.

What lies in a cell and what visits it are compared in blocks: double-precision cosines by matrix
products, from which a task returns only counts and a spanning forest. Cells of any size are thus
compared whole with bounded memory, and pairs are never written out. Equal vectors of a label are one
class with a number of copies before all that.

The codebooks are fitted on a sample of at most ``SAMPLE`` classes (``SAMPLE_BYTES`` bytes) a dimension;
every row is indexed. The grid grows with the largest label up to ``CENTROIDS`` a half; beyond it
cells hold more. Of vectors whose length isn't among the ``LENGTHS`` most frequent ones a label is one cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows of a
null label, link with nothing and are their own component; vectors of different length never link;
repeated rows are vectors of their own that link; a null id takes part but names a component only if
there is no other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.runtime import discard, durable, spread_join, tidy

THRESHOLD = 0.98
RECALL = 0.999
SAMPLE, SAMPLE_BYTES, LENGTHS = 1 << 15, 1 << 26, 8
CENTROIDS, IN_CELL = 1024, 256
BLOCK = 1024
SEED = 11


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors as rows of length 1 in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k centroids of the rows, by Lloyd's rounds; a centroid without rows starts anew at a row far off."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = squared(x, centres)
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = sums / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            far = np.argsort(-d[np.arange(len(x)), near], kind="stable")[: int((n == 0).sum())]
            centres[n == 0] = x[far]
    return centres


@dataclass
class Index:
    """Codebooks of both halves and the squared radius of a traversal."""

    first: np.ndarray
    second: np.ndarray
    radius2: float

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each half: the nearest centroid, and squared bounds of the way to each other one."""
        at = (x.shape[1] + 1) // 2
        out = []
        for half, centres in ((x[:, :at], self.first), (x[:, at:], self.second)):
            d = squared(half, centres)
            near = d.argmin(axis=1)
            apart = np.sqrt(squared(centres, centres))[near]
            gap = d - d[np.arange(len(d)), near][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                way = np.where(apart > 0, gap / (2 * apart), 0.0)
            out += [near, np.square(np.maximum(way, 0.0))]
        return out[0], out[1], out[2], out[3]

    def cells(self, x: np.ndarray) -> np.ndarray:
        near1, _, near2, _ = self.bounds(x)
        return near1 * len(self.second) + near2

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows' own cells, and (row, cell) of all visits, nearest first; the own cell is among them."""
        near1, way1, near2, way2 = self.bounds(x)
        o1, o2 = np.argsort(way1, axis=1, kind="stable"), np.argsort(way2, axis=1, kind="stable")
        v1, v2 = np.take_along_axis(way1, o1, 1), np.take_along_axis(way2, o2, 1)
        w1, w2 = (int((v <= self.radius2).sum(axis=1).max(initial=1)) for v in (v1, v2))
        rows, cells, sums = [], [], []
        for a in range(w1):  # both lists ascend, so what a row visits is a staircase
            total = v1[:, a, None] + v2[:, :w2]
            row, b = np.nonzero(total <= self.radius2)
            rows.append(row)
            cells.append(o1[row, a] * len(self.second) + o2[row, b])
            sums.append(total[row, b])
        row, cell, way = (np.concatenate(z) for z in (rows, cells, sums))
        order = np.lexsort((way, row))
        return near1 * len(self.second) + near2, row[order], cell[order]


def moved(x: np.ndarray, threshold: float, rng: np.random.Generator, few: bool) -> np.ndarray:
    """Rows at just the threshold from x, in random directions or in few coordinates."""
    step = rng.standard_normal(x.shape)
    if few:
        keep = np.argsort(rng.random(x.shape), axis=1)[:, : max(2, x.shape[1] // 8)]
        mask = np.zeros(x.shape, bool)
        np.put_along_axis(mask, keep, True, 1)
        step *= mask
    step -= (step * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((step * step).sum(axis=1, keepdims=True))
    return threshold * x + math.sqrt(1 - threshold**2) * step / np.where(size > 0, size, 1.0)


def fit(x: np.ndarray, k: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> Index:
    """The index of a sample of unit vectors, with k centroids a half at most."""
    rng = np.random.default_rng(seed)
    at = (x.shape[1] + 1) // 2
    k = max(1, min(k, len(x) // 8))
    whole = 2 - 2 * threshold + 1e-9
    index = Index(codebook(x[:, :at], k, rng), codebook(x[:, at:], k if x.shape[1] > 1 else 1, rng), whole)
    if recall >= 1 or k == 1:
        return index
    some = x[rng.choice(len(x), min(len(x), 4096), replace=False)]
    _, way1, _, way2 = index.bounds(some)
    needs = []
    for few in (False, True):
        met = [index.cells(moved(some, threshold, rng, few)) for _ in range(4)]
        ways = [way1[np.arange(len(some)), m // len(index.second)] + way2[np.arange(len(some)), m % len(index.second)] for m in met]
        needs.append(float(np.quantile(np.concatenate(ways), recall)))
    index.radius2 = min(whole, max(needs) + 1e-9)
    return index


def vector_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(id, key, label, dim, raw), written; key tells classes apart, null for what links with nothing.
    And the numbers' type in raw."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    column = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), column.alias("vector"))

    def run(batches):
        for b in batches:
            out = []
            for label, x in zip(b.column("label").to_pylist(), b.column("vector"), strict=True):
                v = x.values
                ok = label is not None and v is not None and len(v) and not v.null_count
                if ok:
                    a = v.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # no negative zeros
                    ok = np.isfinite(a).all() and a.any()
                if not ok:
                    out.append((None, 0, None))
                    continue
                raw = a.tobytes()
                out.append((hashlib.sha256(f"{len(label)}:{label}".encode() + raw).digest(), len(a), raw))
            keys, dims, raws = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), b.column("label"), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["id", "key", "label", "dim", "raw"])

    id_kind = vectors.schema[id_col].dataType.simpleString()
    return durable(rows.mapInArrow(tidy(run), f"id {id_kind}, key binary, label string, dim int, raw binary"), "multi-index-rows"), kind


def fit_all(classes: DataFrame, kind: str, threshold: float, recall: float, in_cell: int) -> dict[int, Index]:
    """An index for each of the most frequent lengths of vectors."""
    per = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    found = {}
    for r in per.orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        k = min(CENTROIDS, max(1, math.ceil(math.sqrt(r["most"] / in_cell))))
        size = max(8, min(SAMPLE, 64 * k, SAMPLE_BYTES // (8 * r["dim"])))
        drawn = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("key"), "key").limit(size).select("raw").toPandas()["raw"]
        found[r["dim"]] = fit(unit([bytes(x) for x in drawn], kind), k, threshold, recall)
    return found


def placed(classes: DataFrame, indexes: dict[int, Index], kind: str) -> DataFrame:
    """(label, dim, cell, cls, own, copies, raw): each class in its cell, and in those of higher number
    that it visits."""

    def run(batches):
        for b in batches:
            for dim, part in b.groupby("dim", sort=True):
                raw = [bytes(x) for x in part["raw"]]
                if dim in indexes:
                    own, row, cell = indexes[dim].traverse(unit(raw, kind))
                    more = cell > own[row]
                    row, cell = np.concatenate([np.arange(len(part)), row[more]]), np.concatenate([own, cell[more]])
                else:
                    row, cell = np.arange(len(part)), np.zeros(len(part), np.int64)
                yield pd.DataFrame({"label": part["label"].values[row], "dim": dim, "cell": cell, "cls": part["cls"].values[row], "own": np.arange(len(row)) < len(part), "copies": part["copies"].values[row], "raw": [raw[i] for i in row]})

    return durable(classes.select("cls", "label", "dim", "copies", "raw").mapInPandas(tidy(run), "label string, dim int, cell bigint, cls bigint, own boolean, copies bigint, raw binary"), "multi-index-placed")


def forest(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[front] = start
    return root


def compared(units: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(cls, n, root) of the classes that have a link in a unit: how many vectors they link with there,
    and a class that they are connected with."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["left", "cls"], ascending=[False, True])
        n_left = int(part["left"].sum())
        x = unit([bytes(r) for r in part["raw"]], kind)
        near = np.zeros((len(x), len(x)), bool)
        near[:n_left, n_left:] = x[:n_left] @ x[n_left:].T >= threshold
        if part["a"].iloc[0] == 0:  # what lies in the block is compared with itself here
            near[n_left:, n_left:] = np.triu(x[n_left:] @ x[n_left:].T >= threshold, 1)
        near |= near.T
        some = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(some, some)]
        cls, copies = part["cls"].to_numpy()[some], part["copies"].to_numpy()[some]
        return pd.DataFrame({"cls": cls, "n": near.astype(np.int64) @ copies, "root": cls[forest(near)]})

    return units.groupBy("label", "dim", "cell", "b", "a").applyInPandas(run, "cls bigint, n bigint, root bigint")


def unit_rows(table: DataFrame, block: int) -> DataFrame:
    """Rows of all units of comparison: block b of a cell with what visits it in chunk a >= 0, or with
    its own earlier block -1 - a."""
    key = ["label", "dim", "cell"]
    sizes = table.groupBy(*key).agg(F.count_if("own").alias("inside"), F.count_if(~F.col("own")).alias("visiting")).where("inside > 0 AND inside + visiting > 1")
    sizes = sizes.select(*key, F.ceil(F.col("inside") / block).alias("blocks"), F.greatest(F.ceil(F.col("visiting") / block), F.lit(1)).alias("chunks"), (F.col("inside") + F.col("visiting")).alias("weight"))
    rows = spread_join(table, durable(sizes, "multi-index-sizes"), key, "weight")
    drawn = F.xxhash64(F.lit(SEED), "cls")
    x = F.pmod(drawn, F.when(F.col("own"), F.col("blocks")).otherwise(F.col("chunks")))
    rows = rows.withColumn("x", x)
    among = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda y: F.struct(F.greatest("x", y).alias("b"), F.when(y == F.col("x"), F.lit(0).cast("bigint")).otherwise(-1 - F.least("x", y)).alias("a"), (y > F.col("x")).alias("left")))
    chunks = F.when(F.col("chunks") > 1, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("chunks") - 1, F.lit(1))), lambda a: F.struct(F.col("x").alias("b"), a.alias("a"), F.lit(False).alias("left")))).otherwise(F.array().cast("array<struct<b:bigint,a:bigint,left:boolean>>"))
    visits = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda y: F.struct(y.alias("b"), F.col("x").alias("a"), F.lit(True).alias("left")))
    units = rows.withColumn("u", F.explode(F.when(F.col("own"), F.concat(among, chunks)).otherwise(visits)))
    return units.select(*key, "cls", "copies", "raw", "u.b", "u.a", "u.left")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", in_cell: int = IN_CELL, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows, kind = vector_rows(vectors, id_col, vector_col, label_col)
    grouped = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = durable(grouped.withColumn("cls", F.monotonically_increasing_id()), "multi-index-classes")
    table = placed(classes, fit_all(classes, kind, threshold, recall, in_cell), kind)
    links = durable(compared(unit_rows(table, block), kind, threshold), "multi-index-links")
    discard(table)
    joined = components(links.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "multi-index-components")
    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    own = classes.select("cls", "key", "copies", "least").join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    own = durable(own.select("key", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "multi-index-own")
    names = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    named = spread_join(own, durable(names, "multi-index-names"), ["root"], "weight").select("key", "n_links", "component_id", F.col("copies").alias("weight"))
    found = spread_join(rows.where("key IS NOT NULL").select("id", "key"), durable(named, "multi-index-named"), ["key"], "weight").select("id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    every = found.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE good AS (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
      AND list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0
), pairs AS (
    SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (SELECT r AS x, r AS y FROM good UNION SELECT t.x, p.y FROM reached t JOIN pairs p ON p.x = t.y
), named AS (SELECT t.x, min(g.vec_id) AS component_id FROM reached t JOIN good g ON g.r = t.y GROUP BY t.x
), counted AS (SELECT x, count(*) AS n FROM pairs GROUP BY x
), found AS (SELECT g.vec_id, coalesce(c.n, 0) AS n_links, n.component_id FROM good g JOIN named n ON n.x = g.r LEFT JOIN counted c ON c.x = g.r
), every AS (
    SELECT * FROM found UNION ALL
    SELECT vec_id, 0, vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.vec_id IS NOT DISTINCT FROM e.vec_id)
)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM every
"""
