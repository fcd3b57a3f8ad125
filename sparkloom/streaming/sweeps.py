"""Transcripts swept into the archive as they grow: the target of foreachBatch over any stream of transcript lines.

A batch holds new lines of many sessions. What it adds lies in tables of its own, each written to a folder named after the batch and
replaced as a whole: a batch that is done again, after whatever failure, reads only what earlier batches left and writes the same rows
to the same places. Sessions' touches are kept as sums for each (session, file), so that a batch adds to the sums of the files it touches and
neither a session nor a transcript is gathered anywhere.

    sink = SweepSink(folder, disk)
    lines.writeStream.foreachBatch(sink).option("checkpointLocation", ...).start()
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content, paths, transcripts
from ..operators import analytics as A
from ..operators import budget
from ..schemas import BLOB, MANIFEST
from ..sources.stores import as_blobs, new_blobs

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _of(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_PLACE = _of(line=_L, pos=_L)
_TOUCHES = _of(session=_S, key=_S, path=_S, reads=_L, edits=_L, last_op=_S, last_ts=_S, first=_PLACE, last=_PLACE)
_EXACT = _of(session=_S, key=_S, hash=_S, size=_L, taken=_B, line=_L)
_EVENTS = _of(session=_S, path=_S, hash=_S, git_blob_sha1=_S, bytes=_L, approx_tokens=_L, source=_S, op=_S, view=_S, sidechain=_B, excluded=_B, seen_ts=_S)
_STATS = _of(session=_S, lines=_L, parsed_lines=_L, reads_seen=_L, edits_seen=_L, exact_versions=_L)
_ENTRIES = MANIFEST["entries"].dataType
_MANIFESTS = _of(session=_S, entries=_ENTRIES)
_TABLES = {"touches": _TOUCHES, "exact": _EXACT, "events": _EVENTS, "stats": _STATS, "blobs": BLOB, "manifests": _MANIFESTS}


def read(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """A table of the archive with its `batch`; of the batches before one, if given."""
    kind = T.StructType([*_TABLES[name].fields, T.StructField("batch", _L)])
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).parquet(f"{root}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with a batch, each key's newest."""
    own = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(own, "batch").alias("x")).select(*keys, "x.*").drop("batch")


def touch_sums(touches: DataFrame) -> DataFrame:
    """touches(session, line, pos, path, op, sidechain, ts) -> _TOUCHES rows: the main session's, for each file."""
    main, read_, at = touches.where(~F.coalesce("sidechain", F.lit(False))), F.col("op") == "read", F.struct(F.col("line").cast("long").alias("line"), F.col("pos").cast("long").alias("pos"))
    sums = main.withColumn("_at", at).groupBy("session", paths.path_key(F.col("path")).alias("key")).agg(
        F.min_by("path", "_at").alias("path"), F.count_if(read_).alias("reads"), F.count_if(~read_).alias("edits"), F.max_by("op", "_at").alias("last_op"), F.max_by("ts", "_at").alias("last_ts"),
        F.min("_at").alias("first"), F.max("_at").alias("last"),
    )
    return sums.select(*_TOUCHES.names)


def added(sums: DataFrame) -> DataFrame:
    """_TOUCHES rows of any number of batches, one for each file."""
    return sums.groupBy("session", "key").agg(
        F.min_by("path", "first").alias("path"), F.sum("reads").alias("reads"), F.sum("edits").alias("edits"), F.max_by("last_op", "last").alias("last_op"), F.max_by("last_ts", "last").alias("last_ts"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    ).select(*_TOUCHES.names)


def _shown(secret: Column, value: Column, hidden) -> Column:
    return F.when(secret, F.lit(hidden)).otherwise(value)


@dataclass
class SweepSink:
    """disk: rows (path, exists, size, binary, content), or what gives them for a DataFrame of paths. A session's exact versions are kept
    up to exact_bytes, in the order of its lines; files on disk up to max_bytes. top: entries of a manifest."""

    root: str
    disk: DataFrame | Callable[[DataFrame], DataFrame]
    exact_bytes: int = 64 << 20
    max_bytes: int = 2_000_000
    top: int = 12
    written: dict[str, int] = field(default_factory=dict)

    def __call__(self, lines: DataFrame, batch: int) -> None:
        """lines(session, line, value): new lines of any sessions, `line` growing with a session's lines (a number or a file's offset)."""
        spark = lines.sparkSession
        before = lambda name: read(spark, self.root, name, batch)
        said = transcripts.parsed(lines.select("session", F.col("line").cast("long").alias("line"), "value"))
        touches = transcripts.touches(said, ["session", "line"])
        exact = transcripts.exact_versions(said, ["session", "line"]).withColumn("key", paths.path_key(F.col("path"))).withColumn("hash", content.content_hash(F.col("content"))).withColumn("size", content.byte_size(F.col("content")).cast("long"))
        kept = self._kept(exact, before("exact"))
        self._write(kept.select(*_EXACT.names), "exact", batch)
        kept = kept.join(self._own(spark, "exact", batch).where("taken").select("session", "key", "hash"), ["session", "key", "hash"], "left_semi")

        # the sums of the files that the batch touches, and those alone
        self._write(touch_sums(touches), "touches", batch)
        new = self._own(spark, "touches", batch)
        sessions = new.select("session").distinct()
        there = added(before("touches").drop("batch").join(sessions, "session", "left_semi").unionByName(new))
        disk = self.disk(there.select("path").distinct()) if callable(self.disk) else self.disk
        usable = disk.where(F.col("exists") & (F.col("size") <= self.max_bytes) & ~F.coalesce("binary", F.lit(False))).select("path", "size", "content")
        held = there.join(usable, "path").withColumn("excluded", paths.is_secret(F.col("path")))

        secret = F.col("excluded")
        current = held.join(new.select("session", "key"), ["session", "key"], "left_semi").select("session", "path", "content", F.col("last_op").alias("op"), F.lit(False).alias("sidechain"), "excluded", F.col("last_ts").alias("seen_ts"))
        rows = kept.select("session", "path", "content", F.lit("read").alias("op"), "sidechain", paths.is_secret(F.col("path")).alias("excluded"), F.col("ts").alias("seen_ts")).unionByName(current)
        events = rows.select(
            "session", "path", _shown(secret, content.content_hash(F.col("content")), "").alias("hash"), F.when(~secret, content.git_blob_sha1(F.col("content"))).alias("git_blob_sha1"),
            _shown(secret, content.byte_size(F.col("content")).cast("long"), 0).cast("long").alias("bytes"), _shown(secret, content.approx_tokens(F.col("content")).cast("long"), 0).cast("long").alias("approx_tokens"),
            F.lit("sweep").alias("source"), "op", F.lit("full").alias("view"), "sidechain", "excluded", "seen_ts",
        )
        self._write(events, "events", batch)
        blobs = as_blobs(rows.where(~secret), F.lit(batch))
        self._write(new_blobs(blobs, before("blobs")).select(*BLOB.names), "blobs", batch)
        self._write(self._manifests(held), "manifests", batch)
        self._write(self._stats(said, touches, exact, self._own(spark, "exact", batch)), "stats", batch)

    def _own(self, spark: SparkSession, name: str, batch: int) -> DataFrame:
        return read(spark, self.root, name).where(F.col("batch") == batch).drop("batch")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _kept(self, exact: DataFrame, earlier: DataFrame) -> DataFrame:
        """First versions that no earlier batch kept, and whether the session's budget still holds them."""
        first = exact.withColumn("_n", F.row_number().over(Window.partitionBy("session", "key", "hash").orderBy("line"))).where("_n = 1").drop("_n")
        new = first.join(earlier.where("taken").select("session", "key", "hash"), ["session", "key", "hash"], "left_anti")
        # what is spent comes before every line
        spent = earlier.where("taken").groupBy("session").agg(F.sum("size").alias("size")).join(new.select("session").distinct(), "session", "left_semi")
        ledger = new.select("session", "key", "hash", "size", "line").unionByName(spent.select("session", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("hash"), "size", F.lit(-1).cast("long").alias("line")))
        walked = budget.greedy(ledger, ["session"], ["line"], "size", self.exact_bytes).where("key is not null").select("session", "key", "hash", "taken")
        return new.join(walked, ["session", "key", "hash"])

    def _manifests(self, held: DataFrame) -> DataFrame:
        heat = Window.partitionBy("session").orderBy(*A.heat_order())
        top = held.withColumn("_rank", F.row_number().over(heat)).where(F.col("_rank") <= self.top)
        secret = F.col("excluded")
        entry = F.struct(
            "_rank", "path", _shown(secret, content.content_hash(F.col("content")), "").alias("hash"), _shown(secret, F.col("size"), 0).cast("long").alias("bytes"),
            _shown(secret, content.approx_tokens(F.col("content")).cast("long"), 0).cast("long").alias("approxTokens"), "reads", "edits", F.col("last_op").alias("lastOp"), F.col("last_ts").alias("lastTs"), "excluded",
        )
        entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*[e[n].alias(n) for n in _ENTRIES.elementType.names]))  # `top` of them
        return top.groupBy("session").agg(entries.alias("entries"))

    @staticmethod
    def _stats(said: DataFrame, touches: DataFrame, exact: DataFrame, kept: DataFrame) -> DataFrame:
        spoke = touches.select("session", "line").unionByName(exact.select("session", "line")).distinct().groupBy("session").agg(F.count("*").alias("parsed_lines"))
        ops = touches.groupBy("session").agg(F.count_if(F.col("op") == "read").alias("reads_seen"), F.count_if(F.col("op") != "read").alias("edits_seen"))
        took = kept.where("taken").groupBy("session").agg(F.count("*").alias("exact_versions"))
        out = said.groupBy("session").agg(F.count("*").alias("lines"))
        for part in (spoke, ops, took):
            out = out.join(part, "session", "left")
        return out.na.fill(0).select(*_STATS.names)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """Each session's counts over all batches."""
    return read(spark, root, "stats").groupBy("session").agg(*[F.sum(c).alias(c) for c in _STATS.names[1:]])


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Each session's newest working set."""
    return latest(read(spark, root, "manifests"), "session")
