"""Connected components of an edge table by alternating stars, every step written to shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import discard, durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the component's smallest node.

    Large stars hang a node's larger neighbours under its smallest one, small stars its smaller
    ones; the minimum of a node's neighbours is a partially aggregated sum, so a node with very
    many edges is not gathered anywhere.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = durable(edges, f"{name}-0")
    before = None
    step = 0
    while (now := _state(edges)) != before:
        before = now
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Each edge points down now: a > b.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        old, edges = edges, durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        discard(old)
    found = durable(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), name)
    discard(edges)
    return found
