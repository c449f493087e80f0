"""Ingest on a stream whose index is the stream's own state.

The state of a content hash is its folder and how far its work has come; it lies in the state store
(RocksDB), partitioned by hash, so a batch costs what it brings and not what is known already. Work that
was left half done is tried again by a timer, or when the same content comes again. Every change is a row
of the output, which thereby is the log from which the index can be read at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

#: Times that half-done work is tried again by itself.
TRIES = 3
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("asset_dir", StringType()), StructField("processed", BooleanType()), StructField("path", StringType()), StructField("tries", IntegerType())])
OUT = "path string, sha256 string, asset_dir string, status string, processed boolean"

#: What is done for new content: (sha256, path) -> (folder, whether the work is complete).
Process = Callable[[str, str], tuple[str, bool]]


def named(sha256: str, path: str) -> tuple[str, bool]:
    """A folder by hash, and nothing else to do."""
    return sha256[:12], True


class Ingest(StatefulProcessor):
    """Of a hash, the first path is ingested and all others are skipped; half-done work is resumed."""

    def __init__(self, process: Process, retry_ms: int | None) -> None:
        self.process, self.retry_ms = process, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def _work(self, sha256: str, path: str, status: str, tries: int, now: int) -> tuple:
        folder, processed = self.process(sha256, path)
        self.known.update((folder, processed, path, tries))
        if not processed and self.retry_ms is not None and tries < TRIES:
            self.handle.registerTimer(now + self.retry_ms)
        return path, sha256, folder, status, processed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sha256, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        # Only the first path counts; the others are told as they stream by.
        held, first = [], None
        for part in rows:
            paths = part["path"].tolist()
            held += paths
            least = min(paths)
            first = least if first is None or least < first else first
        known = self.known.get() if self.known.exists() else None
        out = []
        if known is None:
            out.append(self._work(sha256, first, "ingested", 0, now))
        elif not known[1]:
            out.append(self._work(sha256, first, "resumed", known[3], now))
        else:
            out.append((first, sha256, known[0], "skipped", True))
        folder, done = out[0][2], out[0][4]
        held.remove(first)
        out += [(p, sha256, folder, "skipped", done) for p in sorted(held)]
        yield pd.DataFrame(out, columns=["path", "sha256", "asset_dir", "status", "processed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else None
        if known is not None and not known[1]:
            row = self._work(key[0], known[2], "resumed", known[3] + 1, timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame([row], columns=["path", "sha256", "asset_dir", "status", "processed"])

    def close(self) -> None:
        pass


@contextmanager
def starting(spark: SparkSession) -> Iterator[None]:
    """The session's settings while a query starts, which keeps them: where state lies, and no batches
    without data, as with timers these would never end. Timers that are due run with the next data."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in wanted}
    for n, v in wanted.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def run(stream: DataFrame, outcome_path: str, checkpoint: str, process: Process = named, retry_ms: int | None = None):
    """Start ingesting a stream of (path, sha256) and return the query, which ends when all there is is read.

    Outcomes (path, sha256, asset_dir, status, processed) are files that only count when their batch is
    committed, so each is there once, whatever fails and is run again.
    """
    worked = stream.select("path", "sha256").groupBy("sha256").transformWithStateInPandas(Ingest(process, retry_ms), OUT, "Append", "ProcessingTime")
    with starting(stream.sparkSession):
        return worked.writeStream.format("parquet").option("path", outcome_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def index_of(outcomes: DataFrame) -> DataFrame:
    """(sha256, asset_dir, processed) from the log of outcomes: what is complete stays so."""
    worked = outcomes.where("status <> 'skipped'")
    return worked.groupBy("sha256").agg(F.max(F.struct("processed", "asset_dir")).alias("x")).select("sha256", "x.asset_dir", "x.processed")
