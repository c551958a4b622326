"""Streaming fronts: depth by bin as fragments arrive, and events by time windows. Batch
jobs state the results; these add nothing but early figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_by_bin(fragments: DataFrame, width: int = 1000) -> DataFrame:
    """(chr, bin, fragments), kept up to date: for output mode update or complete. State
    grows with the genome and not with the reads."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width))).alias("bin")
    return fragments.select("chr", bins).groupBy("chr", "bin").agg(F.count("*").alias("fragments"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by tumbling window and kind; windows close behind the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes", time: str = "ts", who: str = "user_id") -> DataFrame:
    """Sessions by gaps of silence."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), who).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
