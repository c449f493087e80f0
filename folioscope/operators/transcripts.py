"""Transcripts of recordings that were cut into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import diarised_line


def merge(parts: DataFrame) -> DataFrame:
    """(recording, text, language, duration, segments) of parts (recording, offset, text, language,
    duration, segments): times are moved by the part's offset, the language is the first known."""
    moved = F.transform("segments", lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), (s["end"] + F.col("offset")).alias("end"), s["speaker"].alias("speaker"), s["text"].alias("text")))
    ready = parts.withColumn("moved", moved)
    ends = F.array_max(F.transform("moved", lambda s: s["end"]))
    grouped = ready.groupBy("recording").agg(
        F.array_sort(F.collect_list(F.struct("offset", "text", "moved"))).alias("p"),
        F.min(F.when(F.col("language").isNotNull(), F.struct("offset", "language"))).alias("l"),
        F.max(F.greatest(F.col("offset") + F.coalesce("duration", F.lit(0.0)), F.coalesce(ends, F.lit(0.0)))).alias("duration"),
    )
    return grouped.select("recording", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), F.col("l.language").alias("language"), "duration", F.flatten(F.transform("p", lambda x: x["moved"])).alias("segments"))


def diarised(segments: DataFrame, group: str, order: str) -> DataFrame:
    """(group, text): one line a segment (text, speaker, start, end), in order."""
    line = diarised_line(F.col("text"), F.col("speaker"), F.col("start"), F.col("end"))
    return segments.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
