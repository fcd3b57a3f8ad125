"""Metering, working sets, packs, blame, receipts: aggregates over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_key

# --- metering ---------------------------------------------------------------------------------------------------------


def meter_totals(meter: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("full", "diff", "unchanged")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("baseline_tokens", "sent_tokens")]
    return meter.agg(F.count("*").alias("reads"), *kinds, sums[0].alias("baseline_tokens"), sums[1].alias("sent_tokens"), (sums[0] - sums[1]).alias("saved_tokens"))


def _sums() -> list[Column]:
    base, sent = F.sum("baseline_tokens"), F.sum("sent_tokens")
    return [base.alias("baseline_tokens"), sent.alias("sent_tokens"), (base - sent).alias("saved_tokens")]


def meter_by_repo(meter: DataFrame) -> DataFrame:
    """Per repository, most sent first; files are counted by their paths as written."""
    return meter.groupBy("repo").agg(F.count("*").alias("reads"), F.countDistinct("path").alias("files"), *_sums()).orderBy(F.desc("sent_tokens"), "repo")


def top_files(meter: DataFrame, n: int = 10) -> DataFrame:
    rows = meter.groupBy("path").agg(F.count("*").alias("reads"), F.sum("sent_tokens").alias("sent_tokens"), F.sum("baseline_tokens").alias("baseline_tokens"))
    return rows.orderBy(F.desc("sent_tokens"), "path").limit(n)


# --- sweeps and working sets ------------------------------------------------------------------------------------------


def touch_fold(touches: DataFrame, seq: str = "seq") -> DataFrame:
    """Per file of the main session: reads, edits, the last touch, and the path as it was first written."""
    main = touches.where(~F.coalesce("sidechain", F.lit(False)))
    read = F.col("op") == "read"
    return main.groupBy(path_key(F.col("path")).alias("key")).agg(
        F.min_by("path", seq).alias("path"), F.count_if(read).alias("reads"), F.count_if(~read).alias("edits"),
        F.max_by("op", seq).alias("last_op"), F.max_by("ts", seq).alias("last_ts"),
    )


def sweep_stats(lines: DataFrame, touches: DataFrame, exact: DataFrame, line: str = "line") -> DataFrame:
    """One row: lines, lines that said something, reads and edits (those of sub-agents too)."""
    said = touches.select(line).unionByName(exact.select(line)).distinct()
    one = lambda rows, x: rows.agg(x).scalar()
    return lines.agg(F.count("*").alias("lines")).select(
        "lines", one(said, F.count("*")).alias("parsed_lines"), one(touches, F.count_if(F.col("op") == "read")).alias("reads_seen"), one(touches, F.count_if(F.col("op") != "read")).alias("edits_seen")
    )


def first_versions(exact: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each (file, content)."""
    w = Window.partitionBy(path_key(F.col("path")), "hash").orderBy(seq)
    return exact.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def on_disk(touched: DataFrame, snapshot: DataFrame, max_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(touched files with their content on disk, touched files without: missing, too large or binary)."""
    usable = snapshot.where(F.col("exists") & (F.col("size") <= max_bytes) & ~F.coalesce("binary", F.lit(False)))
    usable = usable.select("path", "size", F.col("hash").alias("disk_hash"))
    return touched.join(usable, "path"), touched.join(usable.select("path"), "path", "left_anti")


def heat_order() -> list[Column]:
    """Edited files first, then the most touched, then the latest, then by path as people sort."""
    return [F.desc(F.col("edits") > 0), F.desc(F.col("reads") + F.col("edits")), F.desc("last_ts"), F.collate("path", "UNICODE")]


def working_set(events: DataFrame, manifest: DataFrame, now_ms: int | Column, seq: str = "seq", hours: int = 24) -> DataFrame:
    """events(path, ts_ms, hash, approx_tokens, source) of the last hours merged over a manifest's rows (path, touches,
    approx_tokens, hash, ts_ms). A later event replaces version and size; at equal times what came first stays."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    recent = events.where(F.col("ts_ms") >= now - hours * 3_600_000)
    cols = [path_key(F.col("path")).alias("key"), "path", "touches", "approx_tokens", "hash", "source", "ts_ms", "_seq"]
    mine = manifest.select("path", F.col("touches").cast("long").alias("touches"), "approx_tokens", "hash", F.lit("sweep").alias("source"), "ts_ms", F.lit(-1).cast("long").alias("_seq"))
    theirs = recent.select("path", F.lit(1).cast("long").alias("touches"), "approx_tokens", "hash", "source", "ts_ms", F.col(seq).cast("long").alias("_seq"))
    latest = F.struct("ts_ms", -F.col("_seq"))
    # sources in the order they came: for each source its first row, then sorted by it
    per_source = mine.select(*cols).unionByName(theirs.select(*cols)).groupBy("key", "source").agg(
        F.sum("touches").alias("touches"), F.min("_seq").alias("first"), F.min_by("path", "_seq").alias("path"),
        F.max_by(F.struct("hash", "approx_tokens"), latest).alias("v"), F.max(latest).alias("at"),
    )
    merged = per_source.groupBy("key").agg(
        F.min_by("path", "first").alias("path"), F.sum("touches").alias("touches"), F.max_by("v", "at").alias("v"), F.max("at").alias("at"),
        F.array_sort(F.collect_list(F.struct("first", "source"))).alias("s"),
    )
    return merged.select("key", "path", "touches", F.col("v.hash").alias("hash"), F.col("v.approx_tokens").alias("approx_tokens"), F.array_join(F.transform("s", lambda x: x["source"]), "+").alias("sources"), F.col("at.ts_ms").alias("last_ms"))


# --- packs ------------------------------------------------------------------------------------------------------------


def pack_stats(events: DataFrame, seq: str = "seq", repo: str | None = None) -> DataFrame:
    """Per file that isn't secret: sessions, reads (all operations), versions, and score: breadth first, over churn."""
    rows = events.where(~F.coalesce("excluded", F.lit(False)))
    if repo is not None:
        rows = rows.where(path_key(F.col("repo")) == path_key(F.lit(repo)))
    stats = rows.groupBy(path_key(F.col("path")).alias("key")).agg(F.min_by("path", seq).alias("path"), F.countDistinct("session").alias("sessions"), F.count("*").alias("reads"), F.countDistinct("hash").alias("versions"))
    return stats.withColumn("score", (F.col("sessions") * 10 + F.col("reads")) / F.col("versions"))


def pack_order() -> list[Column]:
    return [F.desc("score"), F.collate("path", "UNICODE")]


# --- blame ------------------------------------------------------------------------------------------------------------


def in_first_seen_order(value: str, seq: str) -> Column:
    """Distinct values in the order they were first seen (no set keeps an order)."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(value)))), lambda x: x[value]))


def blame_versions(events: DataFrame, path: str, seq: str = "seq") -> DataFrame:
    """The versions of one file: when and by whom each was seen."""
    mine = events.where(path_key(F.col("path")) == path_key(F.lit(path))).where(~F.coalesce("excluded", F.lit(False)) & (F.col("hash") != ""))
    lists = {"session": "sessions", "source": "sources", "op": "ops"}
    # one row for each (version, value) before values are listed: a list is as long as its distinct values
    firsts = None
    for col, name in lists.items():
        once = mine.groupBy("hash", col).agg(F.min(seq).alias("_first"))
        listed = once.groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(col).cast("string").alias("_value")))), lambda x: x["_value"]), ",").alias(name))
        firsts = listed if firsts is None else firsts.join(listed, "hash")
    stats = mine.groupBy("hash").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("events"), F.min_by("bytes", seq).alias("bytes"),
        F.max_by("git_blob_sha1", F.when(F.col("git_blob_sha1").isNotNull(), F.col(seq))).alias("git_blob_sha1"),
    )
    return stats.join(firsts, "hash").orderBy("first_ms", "hash")


def blame_counters(events: DataFrame, path: str) -> DataFrame:
    mine = events.where(path_key(F.col("path")) == path_key(F.lit(path)))
    return mine.agg(F.count("*").alias("total_events"), F.count_if(F.coalesce("excluded", F.lit(False))).alias("excluded_events"))


def co_context(events: DataFrame, path: str, window_minutes: int = 30, at_ms: int | None = None, seq: str = "seq", top: int = 20) -> DataFrame:
    """Files seen within the window around the focus moment, in sessions that saw the path in it: most events first."""
    key = path_key(F.col("path"))
    mine = events.where(key == path_key(F.lit(path)))
    focus = mine.agg(F.max("ts_ms")).scalar() if at_ms is None else F.lit(at_ms)
    near = F.abs(F.col("ts_ms") - focus) <= window_minutes * 60_000
    sessions = mine.where(near).select("session").distinct()
    others = events.where((key != path_key(F.lit(path))) & ~F.coalesce("excluded", F.lit(False))).where(near)
    found = others.join(sessions, "session", "left_semi").groupBy(key.alias("key")).agg(F.min_by("path", seq).alias("path"), F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.min(seq).alias("first"))
    return found.orderBy(F.desc("events"), "first").limit(top).select("path", "events", "sessions")


def co_context_all(events: DataFrame, window_minutes: int = 30, seq: str = "seq", top: int = 20) -> DataFrame:
    """co_context of every path around its own latest moment: (focus, path, events, sessions, place), `top` places for each focus.

    The band join has an equality on session and time bucket: a bucket is as wide as the window, so what a focus reaches lies in its
    own bucket or the two beside it.
    """
    width = window_minutes * 60_000
    rows = events.select(path_key(F.col("path")).alias("key"), "path", "session", "ts_ms", F.col(seq).alias("_seq"), F.coalesce("excluded", F.lit(False)).alias("_hidden"))
    focus = rows.groupBy("key").agg(F.max("ts_ms").alias("moment"))
    saw = rows.join(focus, "key").where(F.abs(F.col("ts_ms") - F.col("moment")) <= width).select(F.col("key").alias("focus"), "moment", "session").distinct()
    bucket = F.floor(F.col("moment") / width)
    asked = saw.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    others = rows.where(~F.col("_hidden")).withColumn("_bucket", F.floor(F.col("ts_ms") / width))
    met = asked.join(others, ["session", "_bucket"]).where((F.col("focus") != F.col("key")) & (F.abs(F.col("ts_ms") - F.col("moment")) <= width))
    found = met.groupBy("focus", "key").agg(F.min_by("path", "_seq").alias("path"), F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.min("_seq").alias("_first"))
    place = F.row_number().over(Window.partitionBy("focus").orderBy(F.desc("events"), "_first"))
    return found.withColumn("place", place).where(F.col("place") <= top).select("focus", "path", "events", "sessions", "place")


# --- receipts ---------------------------------------------------------------------------------------------------------


def receipt_files(meter: DataFrame, seq: str = "seq") -> DataFrame:
    """Per (path, view), a pair and never a joined text: what was read. One secret event withholds all hashes of the pair."""
    secret = F.coalesce("excluded", F.lit(False)) | (F.coalesce("hash", F.lit("")) == "")
    out = F.bool_or(secret)
    shown = lambda x, empty: F.when(out, F.lit(empty)).otherwise(x)
    git = F.max_by("git_blob_sha1", F.when(F.col("git_blob_sha1").isNotNull(), F.col(seq)))
    hashes = meter.groupBy("path", "view", "hash").agg(F.min(seq).alias("_first")).where("hash <> ''").groupBy("path", "view")
    hashes = hashes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "hash"))), lambda x: x["hash"]), ",").alias("_hashes"))
    files = meter.groupBy("path", "view").agg(
        F.count("*").alias("reads"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("full", "diff", "unchanged")],
        shown(F.max_by("hash", seq), "").alias("final_hash"), F.when(~out, git).alias("git_blob_sha1"), out.alias("excluded"),
    )
    named = files.join(hashes, ["path", "view"], "left").withColumn("hashes_seen", F.when(F.col("excluded"), "").otherwise(F.coalesce("_hashes", F.lit(""))))
    return named.drop("_hashes").orderBy(F.concat("path", "view"), "path")


def receipt_totals(meter: DataFrame) -> DataFrame:
    return meter.agg(
        F.count("*").alias("reads"), F.countDistinct("path", "view").alias("files"), F.sum("baseline_tokens").alias("baseline_tokens"), F.sum("sent_tokens").alias("sent_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_set("epoch")), lambda e: e.cast("string")), ",").alias("epochs"), F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"),
    )


def receipt_swept(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Per path of swept, attestable events: reads, distinct hashes in the order seen, the last git id."""
    rows = events.where((F.col("source") == "sweep") & ~F.coalesce("excluded", F.lit(False)) & (F.coalesce("hash", F.lit("")) != ""))
    once = rows.groupBy("path", "hash").agg(F.count("*").alias("n"), F.min(seq).alias("_first"), F.max(F.when(F.col("git_blob_sha1").isNotNull(), F.struct(seq, "git_blob_sha1"))).alias("_git"))
    out = once.groupBy("path").agg(F.sum("n").alias("reads"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "hash"))), lambda x: x["hash"]), ",").alias("hashes_seen"), F.max("_git").alias("_git"))
    return out.select("path", "reads", "hashes_seen", F.col("_git.git_blob_sha1").alias("git_blob_sha1")).orderBy(F.collate("path", "UNICODE"))
