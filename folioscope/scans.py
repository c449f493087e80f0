"""Running aggregates over groups of any length, by ranges instead of one task a group.

Rows are dealt to ranges of (group, order), so a group that holds most rows is spread over many
ranges. Each range adds up its own rows; what a group had in earlier ranges is carried in. Only
groups that cross a range's border need that: two of each range at most, so the table of carried
values has a few rows a range and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut

#: What a kind adds up, and how two parts are put together.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def dealt(rows: DataFrame, group: Sequence[str], order: Sequence[Column], part: str = "_part") -> DataFrame:
    """rows written in ranges of (group, order), with the range's number."""
    return cut(rows.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[n].eqNullSafe(b[n]) for n in names])


def running(rows: DataFrame, group: Sequence[str], order: Sequence[Column], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """rows with a column for each of ``values`` (name: kind, expression): the aggregate over the group's
    rows up to this one. ``order`` should be total within a group; rows that tie come in any order.

    Null values are passed over; an aggregate of nulls alone is null. Null groups are one group.
    """
    part, edge = "_part", "_edge"
    ranged = dealt(rows.select("*", *[e.alias(f"_v_{n}") for n, (_, e) in values.items()]), group, order, part)
    over = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(*group) if group else F.struct(F.lit(0))
    ends = ranged.groupBy(part).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    borders = ends.select(part, F.explode(F.array_distinct(F.array("first", "last"))).alias(edge)).select(part, *[F.col(f"{edge}.{g}").alias(g) for g in group])
    few = F.broadcast(borders)  # two rows a range at most
    inside = ranged.join(few, _same(ranged, few, [part, *group]), "left_semi")
    totals = inside.groupBy(part, *group).agg(*[KINDS[k][0](f"_v_{n}").alias(f"_c_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(totals.select(part, *group, *[KINDS[k][0](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in values.items()]))
    here = ranged.select("*", *[KINDS[k][0](f"_v_{n}").over(over).alias(f"_w_{n}") for n, (k, _) in values.items()])
    side = F.broadcast(carried)
    both = here.join(side, _same(here, side, [part, *group]), "left").select(*[here[c] for c in here.columns], *[side[f"_c_{n}"] for n in values])
    out = [F.when(F.col(f"_c_{n}").isNull(), F.col(f"_w_{n}")).when(F.col(f"_w_{n}").isNull(), F.col(f"_c_{n}")).otherwise(KINDS[k][1](F.col(f"_w_{n}"), F.col(f"_c_{n}"))).alias(n) for n, (k, _) in values.items()]
    return both.select(*rows.columns, *out)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """rows with their number in the group, from 1."""
    return running(rows, group, order, {name: ("sum", F.lit(1).cast("bigint"))})
