"""A store of results by content key.

What is put is a segment of its own, so writers never wait for each other; compaction makes all segments
that it saw one new generation and then swaps a pointer to it. Of a key's rows the first writer's counts;
rows whose value doesn't fit its digest, or can't be read, don't count, so a later good one takes over.

Generations are bucketed tables sorted by key, written once: lookups shuffle the wanted keys, not the
store. Segments are small and read only for keys that the generation lacks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.lineage import cut

ROWS = "key string, value string, digest string, at timestamp, writer string"


def _first() -> Column:
    """Of a key's rows the first writer's."""
    return F.min_by(F.struct("value", "digest", "at", "writer"), F.struct("at", "writer")).alias("r")


class ContentStore:
    """(key, value) at a path that driver and executors share. readable says which values count, beside
    their digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, readable: Callable[[Column], Column] | None = None) -> None:
        self.spark, self.path, self.buckets, self.readable = spark, path.rstrip("/"), buckets, readable
        jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs, self._path = root.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    # Files.

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _committed(self, folder: str) -> list[str]:
        """Names of folders whose job has ended: Spark marks them last."""
        return [n for n in self._names(folder) if self._fs.exists(self._path(f"{self.path}/{folder}/{n}/_SUCCESS"))]

    def generation(self) -> int:
        """The newest generation that is pointed to; 0 if there is none."""
        return max((int(n.removeprefix("current-")) for n in self._names("pointers") if n.startswith("current-")), default=0)

    def _included(self, generation: int) -> set[str]:
        """Segments that a generation has taken in."""
        return set(self._names(f"taken/{generation}")) if generation else set()

    def segments(self) -> list[str]:
        return [n for n in self._committed("segments") if n not in self._included(self.generation())]

    # Rows.

    def _good(self, rows: DataFrame) -> DataFrame:
        fits = F.col("value").isNotNull() & (F.sha2("value", 256) == F.col("digest"))
        return rows.where(fits if self.readable is None else fits & F.coalesce(self.readable(F.col("value")), F.lit(False)))

    def _generation_rows(self, generation: int) -> DataFrame | None:
        if not generation:
            return None
        name = f"store_{hashlib.md5(self.path.encode()).hexdigest()}_{generation}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ROWS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/generations/{generation}'")
        return self.spark.table(name)

    def _segment_rows(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/segments/{n}" for n in names]) if names else self.spark.createDataFrame([], ROWS)

    def put(self, rows: DataFrame) -> None:
        """Add rows (key, value); what is there already stays. Null values are left out."""
        made = rows.where("value IS NOT NULL").select("key", "value", F.sha2("value", 256).alias("digest"), F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("writer"))
        made.write.parquet(f"{self.path}/segments/{made.sparkSession.sparkContext.applicationId}-{uuid.uuid4().hex}")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """(key, value) of the wanted keys (key) that are there."""
        keys = wanted.select("key").distinct()
        generation = self.generation()
        old = self._generation_rows(generation)
        recent = self._good(self._segment_rows(self.segments()))
        if old is None:
            return recent.join(keys, "key", "left_semi").groupBy("key").agg(_first()).select("key", "r.value")
        kept = self._good(old).join(keys.hint("merge"), "key").select("key", "value")
        # A generation has one row a key; segments are asked for the rest.
        rest = recent.join(keys, "key", "left_semi").join(kept.select("key"), "key", "left_anti")
        return kept.unionByName(rest.groupBy("key").agg(_first()).select("key", "r.value"))

    def compact(self) -> int:
        """Make one generation of all that is there, and point to it. Of several that compact at once the one
        that points first wins, and the others' work is left unused; no segment is lost."""
        before = self.generation()
        taken = self.segments()
        every = self._segment_rows(taken)
        old = self._generation_rows(before)
        if old is not None:
            every = every.unionByName(old.select(*every.columns))
        first = cut(self._good(every).groupBy("key").agg(_first()).select("key", "r.*"))
        after = before + 1
        # Numbers of their own until the pointer is set, so that nobody reads a half of it.
        tried = f"{after}-{uuid.uuid4().hex[:8]}"
        name = f"tried_{tried.replace('-', '_')}"
        first.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/tried/{tried}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        for p in ("generations", "pointers", f"taken/{after}"):
            self._fs.mkdirs(self._path(f"{self.path}/{p}"))
        if not self._fs.rename(self._path(f"{self.path}/tried/{tried}"), self._path(f"{self.path}/generations/{after}")) or self._names(f"generations/{after}").count(tried):
            return self.generation()
        for s in [*taken, *self._included(before)]:
            self._fs.create(self._path(f"{self.path}/taken/{after}/{s}"), True).close()
        self._fs.create(self._path(f"{self.path}/pointers/current-{after}"), False).close()
        return after

    def clean(self) -> None:
        """Delete segments that the current generation has, and older generations. For when nobody reads them."""
        now = self.generation()
        for s in self._included(now):
            self._fs.delete(self._path(f"{self.path}/segments/{s}"), True)
        for g in self._names("generations"):
            if int(g) < now:
                self._fs.delete(self._path(f"{self.path}/generations/{g}"), True)
        self._fs.delete(self._path(f"{self.path}/tried"), True)


def through(store: ContentStore, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """wanted (key, and what make needs) with value and error: known values come from the store; make gives
    (key, value, error) for one row of each other key, whose values are put into it."""
    wanted = cut(wanted)
    known = cut(store.lookup(wanted))
    made = cut(make(wanted.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])).select("key", "value", "error"))
    store.put(made.where("error IS NULL").select("key", "value"))
    every = known.withColumn("error", F.lit(None).cast("string")).unionByName(made)
    return wanted.join(every, "key", "left")
