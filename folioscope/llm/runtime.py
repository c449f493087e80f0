"""What the operators share: durable cuts of lineage, joins on uneven keys, and the way texts are read."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast: sizes are counted first, and larger tables are shuffled.
LISTED = 1 << 20
#: The keys with most rows that are told apart from the others, and the least rows they have.
HOT, HOT_ROWS = 4096, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets a
    temporary one; on a cluster its executors could not read that, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (dots as double underscores) changed for a while."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, n in names.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it outlives any executor.

    The shuffle files of the write are dropped when it is done, for nothing reads them again.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.durable_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of durable tables that nothing needs any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.durable_path
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def small(table: DataFrame, listed: int = LISTED) -> DataFrame:
    """The table marked for broadcast if it was counted to be small, else for a merge join."""
    return F.broadcast(table) if table.limit(listed + 1).count() <= listed else table.hint("merge")


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """rows joined with table, which has one row a key and says in column weight how many rows have it.

    The heaviest keys, ``hot`` at most, are broadcast, so their rows stay where they are; what is
    left is shuffled, and no key has more than a share of 1 / hot of it. The column weight is dropped.
    """
    heavy = durable(table.where(F.col(weight) > HOT_ROWS).orderBy(F.desc(weight), *keys).limit(hot).drop(weight), "heavy-keys")
    if heavy.isEmpty():
        return rows.join(table.drop(weight).hint("merge"), list(keys), how)
    few = F.broadcast(heavy)
    rest = table.drop(weight).join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti").hint("merge")
    return rows.join(few, list(keys)).unionByName(rows.join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti").join(rest, list(keys), how))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Rows of an Arrow batch. Whole texts are long, so a batch of the usual ten thousand would take
#: hundreds of megabytes of a Python worker.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS at most. The registered queries and the pipeline's
    stages do so, for what they return runs later; the operators themselves leave the session alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Give memory that this process no longer needs back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back to the system when its task is done: workers live
    on from task to task, and what their allocators keep adds to the executor's memory."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def utf8(texts: list[str | None]) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]
