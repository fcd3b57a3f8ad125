"""The edit guard in batch: what a writer has seen last, and whether an edit may go ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key
from ..functions.transcripts import is_guarded

#: Files whose state a writer keeps.
SEEN_CAP = 5000


def latest_seen(marks: DataFrame, by: list[str], seq: str = "seq", cap: int = SEEN_CAP) -> DataFrame:
    """marks(*by, key, ts, hash, seq) -> (*by, key, ts, hash): the newest mark of each file, at equal times the later row.

    A mark without a hash wins like any other and takes the hash away. The newest `cap` files of each reader are kept.
    """
    from pyspark.sql import Window

    last = marks.groupBy(*by, "key").agg(F.max_by(F.struct("ts", "hash"), F.struct("ts", seq)).alias("m")).select(*by, "key", "m.*")
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), "key")
    return last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def verdict(tool: Column, path: Column, exists: Column, seen_ts: Column, seen_hash: Column, disk_hash: Column, epoch_ms: Column) -> Column:
    """allow, never-seen or drift. Everything uncertain is allowed: other tools, no path, new files, unknown hashes (null or empty)."""
    asked = F.coalesce(is_guarded(tool) & (path != "") & exists, F.lit(False))
    unseen = seen_ts.isNull() | (seen_ts <= epoch_ms)
    drift = F.coalesce(F.nullif(disk_hash, F.lit("")) != F.nullif(seen_hash, F.lit("")), F.lit(False))
    return F.when(~asked, "allow").when(unseen, "never-seen").when(drift, "drift").otherwise("allow")


def judge_edits(edits: DataFrame, marks: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """edits(*by, ask, tool, path, ts, seq, exists, disk_hash, epoch_ms) with `verdict`, as of each edit's own place in time.

    The mark that counts is the newest of the reader's on the file before the edit: an as-of join, made of one sort over both
    tables' rows instead of a range join.
    """
    from pyspark.sql import Window

    # both kinds of rows in one order; a mark never depends on the edit's own row
    e = edits.select(*by, path_key(F.col("path")).alias("key"), F.col(seq).alias("_at"), F.lit(1).alias("_kind"), F.struct("ask", "tool", "path", "exists", "disk_hash", "epoch_ms").alias("_e"), F.lit(None).cast("struct<ts: bigint, at: bigint, hash: string>").alias("_m"))
    m = marks.select(*by, "key", F.col(seq).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), F.struct(F.col("ts").cast("long").alias("ts"), F.col(seq).cast("long").alias("at"), "hash").alias("_m"))
    w = Window.partitionBy(*by, "key").orderBy("_at", F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = e.unionByName(m).withColumn("_seen", F.max("_m").over(w)).where("_kind = 1")
    v = verdict(F.col("_e.tool"), F.col("_e.path"), F.col("_e.exists"), F.col("_seen.ts"), F.col("_seen.hash"), F.col("_e.disk_hash"), F.col("_e.epoch_ms"))
    return joined.select(*by, F.col("_e.ask").alias("ask"), F.col("_e.tool").alias("tool"), F.col("_e.path").alias("path"), v.alias("verdict"), F.col("_seen.ts").alias("seen_ts"), F.col("_seen.hash").alias("seen_hash"))
