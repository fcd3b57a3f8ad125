"""Retention: which blobs and logs go when stores are over their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newer_bytes(blobs: DataFrame, bucket: int) -> DataFrame:
    """blobs(hash, bytes, mtime) with `kept_if`: the bytes of the blob and of all newer ones.

    A running sum over all rows, in two levels: sums of mtime buckets, and sums inside each bucket. Only the bucket sums are in
    one task.
    """
    rows = blobs.withColumn("_b", F.floor(F.col("mtime") / bucket))
    sums = rows.groupBy("_b").agg(F.sum("bytes").alias("_s"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_after", F.coalesce(F.sum("_s").over(after), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_b").orderBy(F.desc("mtime"), F.desc("hash")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "_b").withColumn("kept_if", F.col("_after") + F.sum("bytes").over(inside)).drop("_b", "_after")


def evicted_blobs(blobs: DataFrame, max_bytes: int, bucket: int = 3_600_000) -> DataFrame:
    """Blobs that go, oldest first by the time they were written, until the rest fits. Reading a blob doesn't make it newer."""
    return newer_bytes(blobs, bucket).where(F.col("kept_if") > max_bytes).drop("kept_if")


def retained_events(events: DataFrame, now_ms: int | Column, days: int = 30, own: str | None = None, writer: str = "session") -> DataFrame:
    """Events of writers whose log was last written within the days, and of the own one."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    last = events.groupBy(writer).agg(F.max("ts_ms").alias("_last"))
    live = last.where((F.col("_last") >= now - days * 86_400_000) | F.coalesce(F.col(writer) == F.lit(own), F.lit(False)))
    return events.join(live.select(writer), writer, "left_semi")


def archive_bytes(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("blobs"))
