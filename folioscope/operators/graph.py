"""Claim graphs as two tables.

nodes: doc_id, pos, id, type, label, source, text, section_index, score, metadata (map).
edges: doc_id, pos, source, target, type, weight, evidence.
pos is the order of construction within a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.lineage import cut, cuts
from folioscope.operators.grouped import in_groups

#: Least cosine of similar claims; claims of a graph, of a chunk's graph, of a section.
SIMILAR, MAX_CLAIMS, CHUNK_CLAIMS, SECTION_CLAIMS = 0.8, 48, 12, 8
#: Vectors that are compared with each other at once.
BLOCK = 1024
#: Groups up to this size are compared many at a time.
FEW = 256
#: Pivots of a group at most, rows of a group that meet them at once, and rows that come of that at most.
PIVOTS, CHUNK, MET = 1024, 1 << 16, 1 << 18
#: Edges of a graph at most whose ancestors are followed in one task, many such graphs at a time.
LINKS = 4096
NODES = "doc_id string, pos bigint, id string, type string, label string, source string, text string, section_index int, score double, metadata map<string,string>"
EDGES = "doc_id string, pos bigint, source string, target string, type string, weight double, evidence string"

#: What the JSON of a graph holds, and the types that a rendered graph shows, in order.
GRAPH = "struct<nodes:array<struct<pos:bigint,id:string,type:string,label:string,source:string,text:string,section_index:int,score:double,metadata:string>>,edges:array<struct<pos:bigint,source:string,target:string,type:string,weight:double,evidence:string>>>"
TYPES = ("claim", "concept", "key_passage", "evidence", "section")


def similar_pairs(rows: DataFrame, group: list[str], position: str, vector: str, threshold: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(group, left, right, weight) for positions left < right of a group with cosine of at least threshold.

    Every vector is in the cell of the nearest of its group's pivots, and only meets those cells that can
    hold a vector as near as the threshold (see cells_of), so clustered vectors are compared with few others
    and no pair is missed. Cells are compared in blocks of about ``block`` vectors as matrix products; none
    holds more than two blocks. Small groups are compared whole, many in a task. Vectors without length are
    like nothing.
    """
    keys = [f"g{i}" for i in range(len(group))]
    ready = rows.where(F.col(vector).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(position).alias("p"), F.col(vector).cast("array<double>").alias("v"))
    sizes = cut(ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    few = F.col("n") <= min(block, FEW)

    def whole(found: pd.DataFrame) -> dict[str, list]:
        v, p = _unit_rows(found["v"]), found["p"].to_numpy()
        cosine = v @ v.T
        x, y = np.nonzero(np.triu(cosine >= threshold, 1))
        one, two, near = p[x], p[y], cosine[x, y]
        keep = one != two
        return {**{k: [found[k].iloc[0]] * int(keep.sum()) for k in keys}, "left": np.minimum(one, two)[keep].tolist(), "right": np.maximum(one, two)[keep].tolist(), "cosine": near[keep].tolist()}

    def run(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("visits", ascending=False, kind="stable")
        visiting = int(found["visits"].sum())
        v = _unit_rows(found["v"])
        p = found["p"].to_numpy()
        cosine = v[:visiting] @ v[visiting:].T
        x, y = np.nonzero(cosine >= threshold)
        pairs = [(p[:visiting][x], p[visiting:][y], cosine[x, y])]
        if found["a"].iloc[0] == 0:  # what lies in the block is compared with itself here
            own = v[visiting:] @ v[visiting:].T
            x, y = np.nonzero(np.triu(own >= threshold, 1))
            pairs.append((p[visiting:][x], p[visiting:][y], own[x, y]))
        one, two, near = (np.concatenate(c) for c in zip(*pairs, strict=True))
        keep = one != two
        one, two, near = one[keep], two[keep], near[keep]
        ahead = one < two
        # Columns of objects, as an empty list would be one of numbers.
        out = {k: np.repeat(np.array([found[k].iloc[0]], object), len(one)) for k in keys}
        return pd.DataFrame({**out, "left": np.where(ahead, one, two), "right": np.where(ahead, two, one), "cosine": near})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"left {kinds['p']}, right {kinds['p']}, cosine double"])
    pairs = in_groups(ready.join(sizes.where(few).select(*keys), keys), keys, ["p"], whole, schema)
    large = sizes.where(~few).select(*keys)
    if not large.isEmpty():
        units = cell_units(cells_of(ready.join(large, keys), keys, threshold, block), keys, block)
        pairs = pairs.unionByName(units.groupBy(*keys, "cell", "b", "a").applyInPandas(run, schema))
    return pairs.select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], "left", "right", F.round("cosine", 3).alias("weight"))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy())
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def cells_of(ready: DataFrame, keys: list[str], threshold: float, block: int = BLOCK) -> DataFrame:
    """(keys, p, v, cell, visits): each vector in its own cell, and as a visitor in those of higher number that
    may hold a similar one.

    Pivots are vectors drawn by a hash, two for each block that a group fills, PIVOTS at most; groups that fill
    one block have one cell. A vector at distance e from another can only be nearer to pivot q than to its
    own pivot o if (|x - q|^2 - |x - o|^2) / (2 |q - o|) is at most e. Rows meet the pivots of their group in
    parts of CHUNK rows, or fewer where each may visit many cells, so neither is gathered whole and no part
    gives more than about MET visits. A task gives each vector once, with the list of its cells, and so they are
    written; the rows of visitors come of the list when it is read.
    """
    sizes = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sized = ready.join(sizes, keys)
    few = sized.where("blocks = 1").select(*keys, "p", "v", F.array(F.lit(0)).alias("cells"))
    many = sized.where("blocks > 1")
    wanted = F.least(F.col("blocks") * 2, F.lit(PIVOTS))
    drawn = F.pmod(F.xxhash64("p", F.lit("pivot")), F.lit(1 << 30)) < (wanted / F.col("n") * (1 << 30))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("n") * wanted / MET)).cast("int")
    # Of the same rows, so all columns get names of their own.
    pivots = many.where(drawn).select(*[F.col(k).alias(f"o_{k}") for k in keys], F.explode(F.sequence(F.lit(0), parts - 1)).alias("o_part"), F.col("p").alias("o"), F.col("v").alias("c"))
    dealt = many.select(*keys, F.pmod(F.xxhash64("p"), parts).cast("int").alias("part"), "p", "v")
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    reach = max(0.0, 2 - 2 * threshold) ** 0.5 + 1e-9

    def run(found: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        x = _unit_rows(found["v"]) if len(found) else np.zeros((0, 1))
        cells = np.zeros((len(x), 1), np.int32)
        if len(centres) and len(x):
            c = _unit_rows(centres.sort_values("o")["c"])
            apart = np.sqrt(np.maximum(_squares(c)[:, None] - 2 * c @ c.T + _squares(c), 0))
            out = []
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                d = _squares(part)[:, None] - 2 * part @ c.T + _squares(c)
                own = d.argmin(axis=1)
                # Vectors without length are in their cell, but are similar to nothing.
                least = d[np.arange(len(part)), own][:, None]
                near = (d - least <= 2 * apart[own] * reach) & (np.arange(len(c)) > own[:, None]) & (_squares(part) > 0)[:, None]
                i, j = np.nonzero(near)
                met = np.split(j.astype(np.int32), np.searchsorted(i, np.arange(1, len(part))))
                out += [np.append(np.int32(o), m) for o, m in zip(own, met, strict=True)]
            cells = out
        got = {k: found[k].to_numpy(object) if len(found) else np.array([], object) for k in [*keys, "p", "v"]}
        return pd.DataFrame({**got, "cells": pd.Series(list(cells), dtype=object)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"p {kinds['p']}, v array<double>, cells array<int>"])
    by = [*keys, "part"]
    whole = cut(few.unionByName(dealt.groupBy(*by).cogroup(pivots.groupBy(*[f"o_{k}" for k in by])).applyInPandas(run, schema)))
    return whole.select(*keys, "p", "v", F.posexplode("cells").alias("at", "cell")).select(*keys, "p", "v", "cell", (F.col("at") > 0).alias("visits"))


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def cell_units(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Rows of all units of comparison of cells_of: block b of a cell with those of its visitors that are in
    chunk a >= 0, or with its own earlier block -1 - a; what is compared with the block has visits."""
    by = [*keys, "cell"]
    sizes = cells.groupBy(*by).agg(F.ceil(F.count_if(~F.col("visits")) / block).alias("blocks"), F.greatest(F.ceil(F.count_if("visits") / block), F.lit(1)).alias("chunks")).where("blocks > 0")
    sized = cells.join(sizes, by).withColumn("x", F.pmod(F.xxhash64("p", F.lit("block")), F.when(F.col("visits"), F.col("chunks")).otherwise(F.col("blocks"))))
    first, every = F.lit(0).cast("bigint"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    among = F.transform(every, lambda y: F.struct(F.greatest("x", y).alias("b"), F.when(y == F.col("x"), first).otherwise(-1 - F.least("x", y)).alias("a"), (y > F.col("x")).alias("visits")))
    hosts = F.transform(F.sequence(first, F.col("chunks") - 1), lambda a: F.struct(F.col("x").alias("b"), a.alias("a"), F.lit(False).alias("visits")))
    met = F.concat(among, F.filter(hosts, lambda u: u["a"] > 0))
    guests = F.transform(every, lambda y: F.struct(y.alias("b"), F.col("x").alias("a"), F.lit(True).alias("visits")))
    return sized.withColumn("u", F.explode(F.when(F.col("visits"), guests).otherwise(met))).select(*by, "p", "v", "u.b", "u.a", "u.visits")


def compared(units: DataFrame, keys: list[str]) -> int:
    """How many dot products the units of cell_units ask for."""
    n = units.groupBy(*keys, "cell", "b", "a").agg(F.count_if("visits").alias("x"), F.count_if(~F.col("visits")).alias("y"))
    each = F.col("x") * F.col("y") + F.when(F.col("a") == 0, F.col("y") * (F.col("y") - 1) / 2).otherwise(0)
    return int(n.agg(F.sum(each)).first()[0] or 0)


def item_texts(items: Column) -> Column:
    """Texts of a section's items in order: claims give two, concepts three, passages two."""
    return F.concat(
        F.flatten(F.transform(items["claims"], lambda c: F.array(c["claim"], c["evidence"]))),
        F.flatten(F.transform(items["concepts"], lambda c: F.array(c["concept"], c["definition"], c["evidence"]))),
        F.flatten(F.transform(items["key_passages"], lambda c: F.array(c["passage"], c["why_it_matters"]))),
    )


def duplicate_suffix(rows: DataFrame, group: list[str], slug: Column, order: list[str]) -> DataFrame:
    """rows with slug and suffix: how many equal slugs the group has up to here."""
    named = rows.withColumn("slug", slug)
    return named.withColumn("suffix", F.row_number().over(Window.partitionBy(*group, "slug").orderBy(*order)))


def build(sources: DataFrame, sections: DataFrame, items: DataFrame, similarity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (without similar_to) of documents.

    sources: doc_id, id, key, type, label, source_path, metadata. sections: doc_id, section_index,
    title, text. items: doc_id, section_index, kind (claim, concept, key_passage), item_index, name,
    body, evidence: a claim's name is the claim; a concept's name and body are concept and
    definition; a passage's name and evidence are the passage and why it matters.
    similarity: doc_id, left, right, cosine of item texts (missing: 0).
    """
    keyed = items.join(sources.select("doc_id", "key", "source_path", F.col("metadata").alias("base")), "doc_id").join(sections.select("doc_id", "section_index", "title"), ["doc_id", "section_index"])

    def with_cosine(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
        near = similarity.select("doc_id", F.col("left").alias(left), F.col("right").alias(right), F.col("cosine").alias(out))
        return rows.join(near, ["doc_id", left, right], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))

    # Only concepts have a second cosine; the first one is with what a kind compares its name with.
    concept = F.col("kind") == "concept"
    paired = keyed.withColumns({"with": F.when(concept, F.col("body")).otherwise(F.col("evidence")), "defined": F.when(concept, F.col("body"))})
    scored = with_cosine(with_cosine(paired, "name", "with", "c1"), "defined", "evidence", "c2").drop("with", "defined")
    score = F.when(F.col("kind") == "claim", S.claim_score(F.col("c1"), F.col("name"), F.col("evidence"))).when(concept, S.concept_score(F.col("c1"), F.col("c2"), F.col("body"), F.col("evidence"))).otherwise(S.passage_score(F.col("c1"), F.col("name"), F.col("evidence")))
    numbered = duplicate_suffix(scored.withColumn("score", score), ["doc_id", "kind"], T.ascii_slug(F.col("name"), 72), ["section_index", "item_index"])
    at = lambda *parts: F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    section_id = at("section", F.col("key"), F.col("section_index"))
    evidence_id = at("evidence", F.col("key"), F.col("section_index"), F.col("item_index"))
    item_id = F.when(F.col("kind") == "key_passage", at("key_passage", F.col("key"), F.col("section_index"), F.col("item_index"))).otherwise(at(F.col("kind"), F.col("key"), F.col("slug"), F.col("suffix")))
    # Written, as nodes and edges are made of it several times.
    ready = cut(numbered.select("*", section_id.alias("section_id"), evidence_id.alias("evidence_id"), item_id.alias("item_id")))
    # Positions: source, then each section followed by its items in order; evidence just before its claim.
    kind_rank = F.when(F.col("kind") == "claim", 1).when(F.col("kind") == "concept", 2).otherwise(3)
    spot = lambda section, kind, item, last: F.struct(section.cast("bigint").alias("section"), kind.cast("int").alias("kind"), item.cast("bigint").alias("item"), F.lit(last).alias("last"))
    place, just_before = (spot(F.col("section_index"), kind_rank, F.col("item_index"), last) for last in (1, 0))
    own_place = spot(F.col("section_index"), F.lit(0), F.lit(0), 0)
    merged = lambda *entries: F.map_concat("base", F.create_map(*entries))
    with_section = merged(F.lit("section"), F.col("title"))
    best = ready.groupBy("doc_id", "section_index").agg(F.max("score").alias("best"))
    section_rows = sections.join(sources.select("doc_id", "key", "source_path", "metadata"), "doc_id").join(best, ["doc_id", "section_index"], "left")
    cols = ["doc_id", "place", "id", "type", "label", "source", "text", "section_index", "score", "metadata"]
    nodes = [
        sources.select("doc_id", spot(F.lit(-1), F.lit(0), F.lit(0), 0).alias("place"), "id", "type", "label", F.col("source_path").alias("source"), F.lit("").alias("text"), F.lit(None).cast("int").alias("section_index"), F.lit(0.0).alias("score"), "metadata"),
        section_rows.select("doc_id", own_place.alias("place"), section_id.alias("id"), F.lit("section").alias("type"), F.col("title").alias("label"), F.col("source_path").alias("source"), T.trim_text(F.col("text")).alias("text"), "section_index", F.coalesce("best", F.lit(0.0)).alias("score"), "metadata"),
        ready.where("kind = 'claim'").select("doc_id", just_before.alias("place"), F.col("evidence_id").alias("id"), F.lit("evidence").alias("type"), F.concat(F.col("title"), F.lit(" evidence "), F.col("item_index").cast("string")).alias("label"), F.col("source_path").alias("source"), F.col("evidence").alias("text"), "section_index", "score", with_section.alias("metadata")),
        ready.select(
            "doc_id", place.alias("place"), F.col("item_id").alias("id"), F.col("kind").alias("type"),
            F.when(F.col("kind") == "key_passage", F.concat(F.col("title"), F.lit(" key passage "), F.col("item_index").cast("string"))).otherwise(T.trim_text(F.col("name"), 120)).alias("label"),
            F.col("source_path").alias("source"), F.when(F.col("kind") == "concept", F.col("body")).otherwise(F.col("name")).alias("text"), "section_index", "score",
            F.when(F.col("kind") == "claim", merged(F.lit("section"), F.col("title"), F.lit("evidence_id"), F.col("evidence_id"))).when(F.col("kind") == "concept", merged(F.lit("section"), F.col("title"), F.lit("evidence"), F.col("evidence"))).otherwise(merged(F.lit("section"), F.col("title"), F.lit("why_it_matters"), F.col("evidence"))).alias("metadata"),
        ),
    ]
    every = nodes[0].select(*cols)
    for n in nodes[1:]:
        every = every.unionByName(n.select(*cols))
    order = Window.partitionBy("doc_id").orderBy("place")
    all_nodes = every.withColumn("pos", F.row_number().over(order).cast("bigint") - 1).select("doc_id", "pos", *cols[2:])
    edge = lambda rows, place, source, target, kind, evidence: rows.select("doc_id", place.alias("place"), source.alias("source"), target.alias("target"), kind.alias("type"), F.lit(1.0).alias("weight"), evidence.alias("evidence"))
    owner = section_rows.join(sources.select("doc_id", F.col("id").alias("root")), "doc_id")
    edges = edge(owner, own_place, F.col("root"), section_id, F.lit("contains"), F.lit(""))
    edges = edges.unionByName(edge(ready.where("kind = 'claim'"), just_before, F.col("section_id"), F.col("evidence_id"), F.lit("contains"), F.lit("")))
    kinds = F.when(F.col("kind") == "claim", "supports").when(F.col("kind") == "concept", "defines").otherwise("highlights")
    edges = edges.unionByName(edge(ready, place, F.when(F.col("kind") == "claim", F.col("evidence_id")).otherwise(F.col("section_id")), F.col("item_id"), kinds, F.when(F.col("kind") == "claim", F.col("evidence")).otherwise("")))
    return all_nodes, edges.withColumn("pos", F.row_number().over(order).cast("bigint") - 1).select("doc_id", "pos", "source", "target", "type", "weight", "evidence")


def add_similar(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """edges with similar_to edges between claims; vectors: doc_id, text, vector."""
    claims = nodes.where("type = 'claim'").join(vectors, ["doc_id", "text"], "left").select("doc_id", "pos", "vector")
    pairs = similar_pairs(claims.where(F.col("vector").isNotNull()), ["doc_id"], "pos", "vector", threshold)
    ids = nodes.where("type = 'claim'").select("doc_id", F.col("pos").alias("p"), "id")
    named = pairs.join(ids.select("doc_id", F.col("p").alias("left"), F.col("id").alias("source")), ["doc_id", "left"]).join(ids.select("doc_id", F.col("p").alias("right"), F.col("id").alias("target")), ["doc_id", "right"])
    last = edges.groupBy("doc_id").agg(F.max("pos").alias("last"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("left", "right"))
    new = named.join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(-1)) + at).cast("bigint").alias("pos"), "source", "target", F.lit("similar_to").alias("type"), "weight", F.lit("").alias("evidence"))
    return edges.unionByName(new)


def merge_chunks(root: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of a document from its chunks' graphs (each row with chunk): the document's node
    first, an edge to each chunk's root, the chunks' edges but similar_to, which are added anew for
    the whole. Ids must be unique and each chunk must have one root."""
    twice = nodes.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    roots = nodes.where("type = 'chunk'").groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    checked = nodes.join(twice, ["doc_id", "id"]).withColumn("id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate node id: "), F.col("id")))).otherwise(F.col("id"))).drop("n")
    checked = checked.join(roots.select("doc_id", "chunk", F.col("n").alias("roots")), ["doc_id", "chunk"], "left").withColumn("id", F.when(F.coalesce("roots", F.lit(0)) != 1, F.raise_error(F.lit("a chunk graph must have one root")).cast("string")).otherwise(F.col("id"))).drop("roots")
    order = Window.partitionBy("doc_id").orderBy("chunk", "pos")
    shape = [c for c in root.columns if c != "pos"]
    body = checked.withColumn("pos", F.row_number().over(order).cast("bigint"))
    all_nodes = root.withColumn("pos", F.lit(0).cast("bigint")).select("pos", *shape).unionByName(body.select("pos", *shape))
    contains = checked.where("type = 'chunk'").select("doc_id", F.lit(-1).alias("chunk"), F.col("chunk").cast("bigint").alias("pos"), F.col("id").alias("target")).join(root.select("doc_id", F.col("id").alias("source")), "doc_id")
    contains = contains.select("doc_id", "chunk", "pos", "source", "target", F.lit("contains").alias("type"), F.lit(1.0).alias("weight"), F.lit("").alias("evidence"))
    kept = contains.unionByName(edges.where("type <> 'similar_to'").select("doc_id", "chunk", "pos", "source", "target", "type", "weight", "evidence"))
    return all_nodes, kept.withColumn("pos", F.row_number().over(order).cast("bigint") - 1).drop("chunk")


def ranked_items(nodes: DataFrame, kind: str, limit: int, group: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(group, id, carried columns, rank): the best item of each section in order of sections, then the best of the
    rest by score, up to limit.

    The first window bounds what reaches the second: only each section's best or the best limit.
    """
    if limit <= 0:
        return nodes.where("1 = 0").select(group, "id", *carry, F.lit(0).alias("rank"))
    items = nodes.where(F.col("type") == kind)
    in_section = F.row_number().over(Window.partitionBy(group, "section_index").orderBy(F.desc("score"), "id"))
    phased = items.withColumn("first", (F.col("section_index").isNotNull() & (in_section == 1)).cast("int"))
    order = Window.partitionBy(group).orderBy(F.desc("first"), F.when(F.col("first") == 1, F.col("section_index")), F.desc("score"), "id")
    return phased.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(group, "id", *carry, "rank")


def item_limit(configured: int | None, max_claims: int) -> int:
    """The limit of concepts or passages: half of the claims', one at least, unless configured."""
    if configured is not None and configured < 0:
        raise ValueError("item limits must not be negative")
    return max(1, max_claims // 2) if configured is None else configured


def selected_items(nodes: DataFrame, max_claims: int, max_concepts: int | None = None, max_passages: int | None = None) -> DataFrame:
    """(doc_id, id, turn): claims, then concepts, then passages, each in order of rank."""
    if max_claims <= 0:
        raise ValueError("max_claims must be positive")
    parts = [ranked_items(nodes, kind, n).withColumn("kind", F.lit(i)) for i, (kind, n) in enumerate((("claim", max_claims), ("concept", item_limit(max_concepts, max_claims)), ("key_passage", item_limit(max_passages, max_claims))))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("doc_id", "id", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "rank")).alias("turn"))


def closure_exact(edges: DataFrame, items: DataFrame, few: int = LINKS) -> DataFrame:
    """(doc_id, id) of a selection (id, turn) with ancestors, as taken in order of turns.

    Ancestors are followed over edges of any type, but not through what is selected already, and the
    targets of an item's own edges are added without their ancestors; so the order matters. A node's first
    turn is the least of those that reach it along incoming edges, through nodes that were met no later
    than an item pointed at them. These least turns are passed on from round to round, only by nodes whose
    turn has become less, until none does; so no document is gathered, however many edges it has. Documents
    of ``few`` edges at most are walked whole instead, many in a task.
    """
    key = F.col("doc_id").cast("string").alias("doc_id")
    items, links = cuts(items.select(key, "id", "turn").groupBy("doc_id", "id").agg(F.min("turn").alias("turn")), edges.select(key, "source", F.col("target").alias("id")).distinct())
    # Documents that are null meet nothing, in rounds as in joins.
    large = (links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > few) | F.col("doc_id").isNull()).select("doc_id"))
    if large.isEmpty():
        return items.select("doc_id", "id").unionByName(_walked(links, items)).distinct()
    large = cut(large)
    small = _walked(links.where("doc_id IS NOT NULL").join(large, "doc_id", "left_anti"), items.join(large, "doc_id", "left_anti"))
    return items.select("doc_id", "id").unionByName(small).unionByName(_in_rounds(links.join(large, "doc_id", "left_semi"), items.join(large, "doc_id", "left_semi"))).distinct()


def _walked(links: DataFrame, items: DataFrame) -> DataFrame:
    """What closure_exact adds to items (doc_id, id, turn), for documents with few links (doc_id, source, id)."""

    def run(found: pd.DataFrame) -> dict[str, list]:
        rows = list(zip(found["source"].tolist(), found["id"].tolist(), found["turn"].tolist(), found["item"].tolist(), strict=True))
        added = walk({i: t for _, i, t, item in rows if item and i is not None}, ((source, i) for source, i, _, item in rows if not item))
        return {"doc_id": [found["doc_id"].iloc[0]] * len(added), "id": added}

    rows = links.select("doc_id", "source", "id", F.lit(0).cast("bigint").alias("turn"), F.lit(False).alias("item")).unionByName(
        items.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("string").alias("source"), "id", F.col("turn").cast("bigint").alias("turn"), F.lit(True).alias("item"))
    )
    return cut(in_groups(rows, ["doc_id"], [], run, "doc_id string, id string"))


def walk(turns: dict[str, int], links: Iterable[tuple[str | None, str | None]]) -> list[str | None]:
    """The ids that closure_exact adds to turns (of ids) over links (source, target) of one document."""
    limits: dict[str | None, int] = {}
    above: dict[str, list] = {}
    for source, i in links:
        if source is not None and source in turns:
            limits[i] = min(limits.get(i, turns[source]), turns[source])
        elif i is not None:
            above.setdefault(i, []).append(source)
    met = set()
    for i, turn in sorted(turns.items(), key=lambda x: x[1]):
        front = [i]
        while front:
            for source in above.get(front.pop(), ()):
                if source not in met:
                    met.add(source)
                    if source is not None and turn <= limits.get(source, turn):
                        front.append(source)
    return [*limits, *(met - limits.keys())]


def _in_rounds(links: DataFrame, items: DataFrame) -> DataFrame:
    """closure_exact for documents of any size."""
    links, items = cut(links), cut(items)
    pointed = links.join(items.select("doc_id", F.col("id").alias("source"), "turn"), ["doc_id", "source"])
    limits = cut(pointed.groupBy("doc_id", "id").agg(F.min("turn").alias("limit")))
    inner = links.join(items.select("doc_id", F.col("id").alias("source")), ["doc_id", "source"], "left_anti")  # items pass on their own turn
    front, met = items, []
    while True:
        offered = inner.join(front, ["doc_id", "id"]).groupBy("doc_id", F.col("source").alias("id")).agg(F.min("turn").alias("turn"))
        if met:
            before = reduce(DataFrame.unionByName, met).groupBy("doc_id", "id").agg(F.min("turn").alias("old"))
            offered = offered.join(before, ["doc_id", "id"], "left").where(F.col("old").isNull() | (F.col("turn") < F.col("old"))).drop("old")
        new = cut(offered)
        if new.isEmpty():
            break
        met.append(new)
        if len(met) == 8:
            met = [cut(reduce(DataFrame.unionByName, met).groupBy("doc_id", "id").agg(F.min("turn").alias("turn")))]
        front = new.join(limits, ["doc_id", "id"], "left").where(F.col("limit").isNull() | (F.col("turn") <= F.col("limit"))).drop("limit")
    parts = [items.select("doc_id", "id"), limits.select("doc_id", "id"), *(m.select("doc_id", "id") for m in met)]
    return reduce(DataFrame.unionByName, parts).distinct()


def closure(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, id): items with all their ancestors and direct targets, as a fixpoint of joins.

    Each round only follows what the round before found; it ends when nothing is new.
    """
    links = cut(edges.select("doc_id", "source", "target").distinct())
    items = cut(items.select("doc_id", "id").distinct())
    found = items
    new = found
    while True:
        above = new.join(links.withColumnRenamed("target", "id"), ["doc_id", "id"]).select("doc_id", F.col("source").alias("id")).distinct()
        new = above.join(found, ["doc_id", "id"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        found = found.unionByName(new)
    below = items.join(links.withColumnRenamed("source", "id"), ["doc_id", "id"]).select("doc_id", F.col("target").alias("id"))
    return found.unionByName(below).distinct()


def induced(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are selected and edges with both ends selected."""
    kept = nodes.join(selected, ["doc_id", "id"], "left_semi")
    ends = edges.join(selected.select("doc_id", F.col("id").alias("source")), ["doc_id", "source"], "left_semi")
    return kept, ends.join(selected.select("doc_id", F.col("id").alias("target")), ["doc_id", "target"], "left_semi")


def node_order() -> list[Column]:
    return [F.col("type"), F.coalesce("section_index", F.lit(0)), F.desc("score"), F.col("id")]


def select_subgraph(nodes: DataFrame, edges: DataFrame, max_claims: int = MAX_CLAIMS, max_concepts: int | None = None, max_passages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of each document's graph that summaries are made from, its nodes numbered in their order:
    by type, section, score and id."""
    kept, links = induced(nodes, edges, closure_exact(edges, selected_items(nodes, max_claims, max_concepts, max_passages)))
    order = Window.partitionBy("doc_id").orderBy(*node_order())
    return kept.withColumn("pos", F.row_number().over(order).cast("bigint") - 1), links


def supported_claims(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, id, text, evidence_texts): claims with the texts of what supports them, in order."""
    supports = edges.where("type = 'supports'").select("doc_id", F.col("target").alias("id"), F.col("source").alias("by"), F.col("pos").alias("at"))
    texts = nodes.where("type = 'evidence'").select("doc_id", F.col("id").alias("by"), F.col("text").alias("evidence"))
    grouped = supports.join(texts, ["doc_id", "by"]).groupBy("doc_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence"))), lambda x: x["evidence"]).alias("evidence_texts"))
    return nodes.where("type = 'claim'").select("doc_id", "id", "text", "section_index", "score").join(grouped, ["doc_id", "id"], "left").withColumn("evidence_texts", F.coalesce("evidence_texts", F.array().cast("array<string>")))


def section_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, section_index, claims, concepts, passages)."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    return nodes.where(F.col("section_index").isNotNull()).groupBy("doc_id", "section_index").agg(n("claim").alias("claims"), n("concept").alias("concepts"), n("key_passage").alias("passages"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, nodes, claims, sections, edges, similar)."""
    a = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") == "claim").alias("claims"), F.count_if(F.col("type") == "section").alias("sections"))
    b = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("type") == "similar_to").alias("similar"))
    return a.join(b, "doc_id", "left").fillna(0, ["edges", "similar"])


def render_markdown(nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): the selected graph as prompts have it: claims with what supports them,
    concepts, passages, evidence with what it supports, and sections with counts, in order of pos.

    docs (doc_id, name) gives documents' names; the id stands for a missing one.
    """
    listed = lambda rows, by, item: rows.groupBy("doc_id", F.col(by).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(item).alias("x")))), lambda s: s["x"]).alias("ends"))
    supports = edges.where("type = 'supports'").select("doc_id", "source", "target", F.col("pos").alias("at"))
    claims = nodes.where("type = 'claim'").join(listed(supports, "target", "source"), ["doc_id", "id"], "left")
    proof = nodes.where("type = 'evidence'").join(listed(supports, "source", "target"), ["doc_id", "id"], "left")
    child = edges.join(nodes.where("type IN ('evidence', 'concept', 'key_passage')").select("doc_id", F.col("id").alias("target")), ["doc_id", "target"]).groupBy("doc_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    sections = nodes.where("type = 'section'").join(child, ["doc_id", "id"], "left")
    texts = node_texts(F.col)
    part = lambda rows, n: rows.select("doc_id", F.lit(n + 1).alias("part"), "pos", texts[n][1].alias("text"))
    every = [part(rows, n) for n, rows in enumerate((claims, nodes.where("type = 'concept'"), nodes.where("type = 'key_passage'"), proof, sections))]
    joined = every[0]
    for e in every[1:]:
        joined = joined.unionByName(e)
    whole = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "text"))).alias("all"))
    named = nodes.select("doc_id").distinct().join(whole, "doc_id", "left")
    named = named.withColumn("name", F.col("doc_id").cast("string")) if docs is None else named.join(docs.select("doc_id", "name"), "doc_id", "left").withColumn("name", F.coalesce("name", F.col("doc_id").cast("string")))
    return named.select("doc_id", page(F.col("name"), lambda n: F.transform(F.filter("all", lambda x: x["part"] == n + 1), lambda x: x["text"])).alias("markdown"))


def node_texts(of: Callable[[str], Column]) -> list[tuple[str, Column]]:
    """For each type that a rendered graph shows, in order, what it says of a node; of gives the node's
    columns: ends (ids that support a claim, or that evidence supports) and children beside those of nodes."""
    said = lambda key, default: F.coalesce(F.try_element_at(of("metadata"), F.lit(key)), F.lit(default))
    quoted = F.array_join(F.transform(F.coalesce(of("ends"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    head = F.concat(F.lit("### "), of("id"), F.lit("\n\n"))
    score = F.concat(F.lit("- Score: "), F.format_string("%.4f", of("score")), F.lit("\n"))
    section = F.concat(F.lit("- Section: "), said("section", "Unknown section"), F.lit("\n"))
    return [
        ("claim", F.concat(head, score, section, F.lit("- Claim: "), of("text"), F.lit("\n- Supported by: "), quoted)),
        ("concept", F.concat(head, score, section, F.lit("- Concept: "), of("label"), F.lit("\n- Definition: "), of("text"), F.lit("\n- Source evidence: "), said("evidence", ""))),
        ("key_passage", F.concat(head, score, section, F.lit("- Why it matters: "), said("why_it_matters", ""), F.lit("\n\n"), of("text"))),
        ("evidence", F.concat(head, section, F.lit("- Supports: "), quoted, F.lit("\n\n"), of("text"))),
        ("section", F.concat(F.lit("- `"), of("id"), F.lit("` "), of("label"), F.lit(" (score "), F.format_string("%.4f", of("score")), F.lit("; "), F.coalesce(of("children"), F.lit(0)).cast("string"), F.lit(" selected summary nodes)"))),
    ]


def page(name: Column, texts: Callable[[int], Column]) -> Column:
    """A rendered graph of what texts gives for each type of node_texts, by its place there."""
    titles = ("Claims", "Concepts", "Key Passages", "Evidence", "Sections")
    said = F.array(*[F.struct(F.lit(f"## {title}\n\n").alias("head"), F.array_join(texts(n), "\n" if n == 4 else "\n\n").alias("said")) for n, title in enumerate(titles)])
    blocks = F.transform(said, lambda x: F.concat(x["head"], F.when(x["said"] != "", F.concat(x["said"], F.lit("\n\n"))).otherwise("")))
    return F.concat(T.strip(F.concat(F.lit("# Selected Summary Graph\n\nDocument: `"), name, F.lit("`\n\n"), F.array_join(blocks, ""))), F.lit("\n"))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, graph): both tables as one JSON text a document."""
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "type", "label", "source", "text", "section_index", "score", F.to_json("metadata").alias("metadata")))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target", "type", "weight", "evidence"))).alias("edges"))
    return n.join(e, "doc_id", "left").select("doc_id", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))).alias("graph"))


def is_readable(graph: Column) -> Column:
    """Whether a text is a graph of to_json: JSON with nodes that have ids and types, and edges."""
    read = F.try_parse_json(graph)
    nodes = F.try_variant_get(read, "$.nodes", "array<struct<id:string,type:string>>")
    edges = F.try_variant_get(read, "$.edges", "array<struct<source:string,target:string>>")
    named = F.forall(nodes, lambda n: n["id"].isNotNull() & n["type"].isNotNull())
    return F.coalesce(named & F.forall(edges, lambda e: e["source"].isNotNull() & e["target"].isNotNull()), F.lit(False))


def from_json(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of to_json, with defaults for what is missing."""
    read = graphs.select("doc_id", F.from_json("graph", GRAPH).alias("g"))
    nodes = read.select("doc_id", F.inline("g.nodes")).withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    return with_defaults(nodes, read.select("doc_id", F.inline("g.edges")))


def with_defaults(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables as they are read again from what to_json makes of them."""
    nodes = nodes.withColumn("metadata", F.coalesce("metadata", F.from_json(F.lit("{}"), "map<string,string>"))).fillna({"text": "", "score": 0.0})
    return nodes, edges.fillna({"weight": 1.0, "evidence": ""})
