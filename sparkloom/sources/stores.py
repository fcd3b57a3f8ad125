"""Batch sources and sinks. `now` is always a parameter; nothing here looks at a clock or at files outside the given folders."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.content import content_hash, git_blob_sha1
from ..functions.paths import safe_name, writer_key
from ..schemas import ARCHIVE_EVENT, BLOB, MANIFEST, PRESENCE

DAY_MS = 86_400_000
#: Splits of transcripts whose places are broadcast; those of more are joined.
BROADCAST_SPLITS = 100_000
#: Blobs that are looked up in the store by name.
NAMED = 1000


def event_ms(ts: Column) -> Column:
    """Milliseconds of an ISO text; null where it can't be read."""
    return F.unix_millis(F.try_to_timestamp(ts))


def read_events(spark: SparkSession, path: str, since_ms: int | None = None, names: str = "*.jsonl") -> DataFrame:
    """The union of all writers' JSON-lines logs under path: rows with a path, a hash and a ts, from since_ms on (rows whose ts
    can't be read stay). Blank and broken lines are skipped. `_writer` and the ts give a defined order."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path)
    rows = lines.select(F.from_json("value", ARCHIVE_EVENT).alias("e"), F.col("_metadata.file_path").alias("_writer")).select("e.*", "_writer")
    rows = rows.where("path is not null and hash is not null and ts is not null")
    return rows if since_ms is None else rows.where(~F.coalesce(event_ms(F.col("ts")) < since_ms, F.lit(False)))


def read_event_table(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """The log as Parquet, partitioned by day: whole days before the bound are never opened."""
    rows = spark.read.parquet(path)
    if since_ms is None:
        return rows
    return rows.where(F.col("day") >= F.date_from_unix_date(F.lit(since_ms // DAY_MS).cast("int"))).where(event_ms(F.col("ts")) >= since_ms)


def append_events(events: DataFrame, path: str, now_iso: str) -> None:
    """Stamp rows with their record time and append them to the Parquet log."""
    stamped = events.withColumn("ts", F.lit(now_iso)).withColumn("day", F.to_date(F.lit(now_iso[:10])))
    stamped.write.mode("append").partitionBy("day").parquet(path)


def oldest_first(events: DataFrame) -> DataFrame:
    return events.orderBy("ts", *[c for c in ("_writer", "event_id") if c in events.columns])


def lookup_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """wanted(hash, ...) with content, null where there is none."""
    return wanted.join(blobs.select("hash", "content"), "hash", "left")


def has_blob(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    return wanted.join(blobs.select("hash").distinct().withColumn("in_archive", F.lit(True)), "hash", "left").withColumn("in_archive", F.coalesce("in_archive", F.lit(False)))


def as_blobs(contents: DataFrame, mtime: Column) -> DataFrame:
    """contents(content) as blob rows, one for each content: its hash, size, git id and first mtime."""
    rows = contents.where("content is not null").withColumn("mtime", mtime)
    rows = rows.groupBy(content_hash(F.col("content")).alias("hash")).agg(F.first("content").alias("content"), F.min("mtime").cast("long").alias("mtime"))
    return rows.select("hash", "content", F.octet_length("content").cast("long").alias("bytes"), git_blob_sha1(F.col("content")).alias("git_sha1"), "mtime")


def new_blobs(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs that the store lacks: what a put writes. Putting the same content again writes nothing."""
    return candidates.join(stored.select("hash"), "hash", "left_anti")


def _part(hash_: Column) -> Column:
    return F.substring(hash_, 1, 2)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    kind = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in BLOB)}, _put string, part string"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)


def stored_among(spark: SparkSession, candidates: DataFrame, path: str) -> DataFrame:
    """(hash): those of the candidates that the store holds. Of the store only hashes are read, and never shuffled while the candidates are few:
    up to NAMED are looked up by name, in the folders of their first digits, where files are sorted by hash and have bloom filters; of more,
    Spark broadcasts the candidates while they are small."""
    stored, hashes = _stored(spark, path).select("part", "hash"), candidates.select(_part(F.col("hash")).alias("part"), "hash").distinct()
    few = hashes.limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        return stored.where(F.col("part").isin(sorted({r.part for r in few})) & F.col("hash").isin([r.hash for r in few])).select("hash").distinct()
    return stored.join(hashes, ["part", "hash"], "left_semi").select("hash").distinct()


def put_blobs(spark: SparkSession, candidates: DataFrame, path: str) -> None:
    """Add what the store lacks, in folders by the hash's first digits. Two puts at once may both add a blob: read_blobs gives it once."""
    new = new_blobs(candidates, stored_among(spark, candidates, path)).select(*BLOB.names, F.lit(uuid.uuid4().hex).alias("_put"), _part(F.col("hash")).alias("part"))
    new.repartition("part").sortWithinPartitions("part", "hash").write.mode("append").option("parquet.bloom.filter.enabled#hash", "true").partitionBy("part").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The store's blobs, one row a hash."""
    rows = _stored(spark, path)
    twice = rows.groupBy("hash").agg(F.min("_put").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(twice, "hash", "left").where(F.coalesce(F.col("_first") == F.col("_put"), F.lit(True))).select(*BLOB.names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def read_transcripts(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """(file, line, value): every line of every transcript under path, lines numbered from 0 in each file.

    Files are read in splits. Each split counts its lines first; the sums of the counts before it, one number for each split (of which the driver plans
    the reading anyway), say at which line it begins, and its rows come in order. No file's lines meet in one task.
    """
    split = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("lineSep", "\n").text(path)
    rows = split.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_order"))
    counted = rows.groupBy("file", "_start").agg(F.count("*").alias("n"), F.min("_order").alias("first")).collect()
    before, begins = {}, []
    for r in sorted(counted):
        begins.append((r.file, r["_start"], before.get(r.file, 0) - r["first"]))
        before[r.file] = before.get(r.file, 0) + r.n
    shift = spark.createDataFrame(begins, "file string, _start long, _shift long")
    shift = F.broadcast(shift) if len(begins) <= BROADCAST_SPLITS else shift
    return rows.join(shift, ["file", "_start"]).select("file", (F.col("_order") + F.col("_shift")).cast("int").alias("line"), "value").where("value <> ''")


def read_files(spark: SparkSession, path: str, max_bytes: int = 2_000_000) -> DataFrame:
    """(path, size, content, hash) of text files up to a size; larger and binary ones are left out before they are read."""
    from ..functions.content import looks_binary

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    texts = files.where(~looks_binary(F.col("content"))).select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    return texts.withColumn("hash", content_hash(F.col("content")))


def manifest(ranked: DataFrame, order: list[Column], session: str, now_iso: str, top: int = 12) -> DataFrame:
    """One row (file, session, ts, entries): the first `top` entries of a ranked working set."""
    kept = ranked.orderBy(*order).limit(top)
    names = [c for c in MANIFEST["entries"].dataType.elementType.names if c in kept.columns]
    numbered = kept.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("_rank", *names))), lambda e: F.struct(*[e[n].alias(n) for n in names]))
    return numbered.agg(entries.alias("entries")).select(safe_name(F.lit(session)).alias("file"), F.lit(session).alias("session"), F.lit(now_iso).alias("ts"), "entries")


def manifest_as_of(manifests: DataFrame, session: str | None, now_ms: int, max_age_ms: int = DAY_MS) -> DataFrame:
    """manifests(session, mtime, ...) -> the session's own, however old; else the newest that isn't too old; else nothing."""
    own = F.col("session") == F.lit(session)
    fresh = (F.lit(now_ms) - F.col("mtime") <= max_age_ms) & (F.col("mtime") <= now_ms)
    fit = manifests.withColumn("_own", F.coalesce(own, F.lit(False))).where(F.col("_own") | fresh)
    return fit.orderBy(F.desc("_own"), F.desc("mtime"), "session").limit(1).drop("_own")


def _save_by(rows: DataFrame, key: Column, name: str, path: str) -> None:
    """Replace the keys that rows hold, each in a folder of its own; other keys stay as they are."""
    keyed = rows.withColumn(name, key)
    keyed.repartition(name).write.partitionBy(name).option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def save_presence(records: DataFrame, path: str) -> None:
    """Write each writer's record over its last one (see operators.presence for what a writer keeps)."""
    _save_by(records.select(*PRESENCE.names), writer_key(F.col("sid"), F.col("agent")), "writer", path)


def save_seen(seen: DataFrame, reader: str, path: str) -> None:
    """Write each reader's last-seen files (reader, key, ts, hash) over its last state."""
    _save_by(seen, F.col(reader), "_reader", path)


def load_seen(spark: SparkSession, path: str, reader: str) -> DataFrame:
    """(key, ts, hash) of one reader: only its folder is opened."""
    return spark.read.schema("key string, ts long, hash string, _reader string").json(path).where(F.col("_reader") == reader).drop("_reader")


def read_presence(spark: SparkSession, path: str) -> DataFrame:
    """Presence records, one JSON file each, with the file's `mtime`; malformed ones are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = rows.select(F.from_json("value", PRESENCE).alias("r"), F.unix_millis("_metadata.file_modification_time").alias("mtime"))
    return parsed.select("r.*", "mtime").where("intents is not null and edits is not null")


def cursors(sets: DataFrame, cap: int = 256) -> DataFrame:
    """sets(path, offset, seq) -> (path, offset): the last offset set for each path, of the most recently set `cap` paths."""
    last = sets.groupBy("path").agg(F.max_by("offset", "seq").alias("offset"), F.max("seq").alias("seq"))
    return last.orderBy(F.desc("seq")).limit(cap).select("path", "offset")


def offset_for(wanted: DataFrame, held: DataFrame) -> DataFrame:
    return wanted.join(held, "path", "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def git_head(repo: str) -> dict[str, str]:
    """{branch, sha} of a working tree, read from its git folder: worktree links, loose and packed refs. Unknown parts are absent."""
    git = os.path.join(repo, ".git")
    try:
        if os.path.isfile(git):
            with open(git, encoding="utf-8") as f:
                git = os.path.join(repo, f.read().strip().removeprefix("gitdir:").strip())
        with open(os.path.join(git, "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
    except OSError:
        return {}
    if not head.startswith("ref:"):
        return {"sha": head} if head else {}
    ref = head.removeprefix("ref:").strip()
    out = {"branch": ref.removeprefix("refs/heads/")}
    common = git
    if os.path.isfile(link := os.path.join(git, "commondir")):
        with open(link, encoding="utf-8") as f:
            common = os.path.normpath(os.path.join(git, f.read().strip()))
    for folder in (git, common):
        if os.path.isfile(loose := os.path.join(folder, ref)):
            with open(loose, encoding="utf-8") as f:
                return out | {"sha": f.read().strip()}
    if os.path.isfile(packed := os.path.join(common, "packed-refs")):
        with open(packed, encoding="utf-8") as f:
            for line in f:
                sha, _, name = line.strip().partition(" ")
                if name == ref and not line.startswith(("#", "^")):
                    return out | {"sha": sha}
    return out


def repo_heads(spark: SparkSession, repos: list[str]) -> DataFrame:
    """A small dimension table (repo, branch, head_sha), read on the driver: one row per attested repository."""
    rows = [(r, (h := git_head(r)).get("branch"), h.get("sha")) for r in repos]
    return spark.createDataFrame(rows, "repo string, branch string, head_sha string")
