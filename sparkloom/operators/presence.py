"""Presence: who has edited or is about to edit what, and where that collides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import half_up
from ..functions.paths import path_key, writer_key

#: Seconds that a record, and an intent, count as fresh; rows that a writer keeps; milliseconds in which edits are one.
RECORD_SECS, INTENT_SECS, KEPT, BUCKET_MS = 1800, 90, 100, 5000


def _now(now: int | Column) -> Column:
    return F.lit(now) if isinstance(now, int) else now


def live(records: DataFrame, now: int | Column, own: str = "", age_secs: int = RECORD_SECS) -> DataFrame:
    """Records (or their flat rows) of other writers, written within the last `age_secs`; an empty own key leaves none out."""
    key = writer_key(F.col("sid"), F.col("agent"))
    return records.where((F.col("mtime") >= _now(now) - age_secs * 1000) & (key != own))


def flat(records: DataFrame, what: str) -> DataFrame:
    """(sid, agent, path, ts[, hash]) of the records' edits or intents."""
    return records.select("sid", "agent", "updatedAt", F.explode(what).alias("x")).select("sid", "agent", "updatedAt", "x.*")


def kept_edits(edits: DataFrame, now: int | Column, seq: str = "seq", age_secs: int = RECORD_SECS, bucket_ms: int = BUCKET_MS, kept: int = KEPT) -> DataFrame:
    """Per writer: of the edits of a file in one time bucket the first, or the first with a hash; the newest `kept` of these."""
    fresh = edits.where(F.col("ts") >= _now(now) - age_secs * 1000)
    bucket = half_up(F.col("ts") / bucket_ms)
    one = Window.partitionBy("sid", "agent", path_key(F.col("path")), bucket).orderBy(F.col("hash").isNull(), seq)
    newest = Window.partitionBy("sid", "agent").orderBy(F.desc("ts"), F.desc(seq))
    once = fresh.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= kept).drop("_n")


def kept_intents(intents: DataFrame, now: int | Column, seq: str = "seq", age_secs: int = RECORD_SECS, kept: int = KEPT) -> DataFrame:
    newest = Window.partitionBy("sid", "agent").orderBy(F.desc(seq))
    return intents.where(F.col("ts") >= _now(now) - age_secs * 1000).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= kept).drop("_n")


def retire_intents(intents: DataFrame, edits: DataFrame) -> DataFrame:
    """Intents without those that an edit of the same writer on the same file, at the same time or later, has superseded."""
    done = edits.select("sid", "agent", path_key(F.col("path")).alias("_key"), "ts").groupBy("sid", "agent", "_key").agg(F.max("ts").alias("_done"))
    keyed = intents.withColumn("_key", path_key(F.col("path")))
    return keyed.join(done, (keyed.sid == done.sid) & (keyed.agent == done.agent) & (keyed._key == done._key) & (keyed.ts <= done._done), "left_anti").drop("_key")


def _asks(asks: DataFrame, *more: Column) -> DataFrame:
    return asks.select("ask", "sid", "now", "seen_ts", path_key(F.col("path")).alias("_key"), writer_key(F.col("sid"), F.col("agent")).alias("_own"), *more)


def _writes(others: DataFrame) -> DataFrame:
    """(_key, _w, other_ts): rows of others by file and writer; writers are ordered by their keys."""
    writer = F.struct(writer_key(F.col("sid"), F.col("agent")).alias("key"), F.col("sid").alias("sid"), F.col("agent").alias("agent"))
    return others.select(path_key(F.col("path")).alias("_key"), writer.alias("_w"), F.col("ts").alias("other_ts"))


def _found(rows: DataFrame, kind: str) -> DataFrame:
    """rows(ask, sid, now, _w, other_ts) as conflicts."""
    return rows.select("ask", F.lit(kind).alias("kind"), F.col("_w.sid").alias("other_sid"), F.col("_w.agent").alias("other_agent"), (F.col("now") - F.col("other_ts")).alias("age_ms"), (F.col("_w.sid") == F.col("sid")).alias("same_session"))


def in_flight(asks: DataFrame, intents: DataFrame, fresh_secs: int = INTENT_SECS) -> DataFrame:
    """Per ask: another writer's fresh intent on the file, not older than what the asker saw of it: the first writer's, its first. Future
    intents don't count.

    Rows meet by file and stretch of time, two stretches for each ask, and a writer's intents on a file in one stretch are one row: an ask
    meets writers that are at work beside it, however many intents a file has had.
    """
    fresh = fresh_secs * 1000
    stretch = lambda t: F.floor(t / fresh)
    busy = _writes(intents).groupBy("_key", stretch(F.col("other_ts")).alias("_at"), "_w").agg(F.array_sort(F.collect_list("other_ts")).alias("_times"))  # one writer's, of 90 seconds
    since = F.greatest(F.col("now") - fresh, F.coalesce("seen_ts", F.col("now") - fresh))
    a = _asks(asks, F.explode(F.array(stretch(F.col("now")), stretch(F.col("now")) - 1)).alias("_at"))
    met = a.join(busy, ["_key", "_at"]).where("_own <> _w.key")
    met = met.withColumn("other_ts", F.get(F.filter("_times", lambda t: (t >= since) & (t <= F.col("now"))), 0)).where("other_ts is not null")
    first = met.groupBy("ask").agg(F.min(F.struct("_w", "other_ts", "sid", "now")).alias("x"))
    return _found(first.select("ask", "x.*"), "in-flight")


#: Parts into which the asks on one file are spread.
SPREAD = 16


def landed(asks: DataFrame, edits: DataFrame) -> DataFrame:
    """Per ask whose file was seen without a hash: another writer's edit after that: the first writer's, its first.

    A writer has edited since t if its last edit is later, so the file's writers are one row each. Sorted by these times together with the
    asks, downwards, the first writer so far and the first but for that one are running minima: what comes second is the least of those
    that ever lost against the first. No ask meets more than these two.
    """
    writes = _writes(edits)
    a = _asks(asks.where("seen_ts is not null and seen_hash is null")).withColumn("_part", F.pmod(F.xxhash64("ask"), F.lit(SPREAD)))
    last = writes.groupBy("_key", "_w").agg(F.max("other_ts").alias("_t")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    mine = F.struct("ask", "sid", "now", "seen_ts", "_own").alias("_a")
    rows = a.select("_key", "_part", F.col("seen_ts").alias("_t"), mine).unionByName(last, allowMissingColumns=True)
    down = Window.partitionBy("_key", "_part").orderBy(F.desc("_t"), F.col("_a").isNull())  # at the same time asks first: an edit must be later
    upto, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.min("_w").over(upto)).withColumn("_had", F.min("_w").over(before))
    rows = rows.withColumn("_lost", F.when(F.col("_w").isNotNull() & F.col("_had").isNotNull(), F.greatest("_w", "_had"))).withColumn("_second", F.min("_lost").over(upto))
    other = F.when(F.col("_first.key") != F.col("_a._own"), F.col("_first")).otherwise(F.col("_second"))
    chosen = rows.where("_a is not null").select("_key", "_a", other.alias("_w")).where("_w is not null")
    # that writer's first edit after what was seen: the last one met on the way down
    both = chosen.select("_key", "_w", F.col("_a.seen_ts").alias("_t"), "_a").unionByName(writes.select("_key", "_w", F.col("other_ts").alias("_t")), allowMissingColumns=True)
    way = Window.partitionBy("_key", "_w").orderBy(F.desc("_t"), F.col("_a").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("other_ts", F.min(F.when(F.col("_a").isNull(), F.col("_t"))).over(way)).where("_a is not null")
    return _found(near.select("_a.ask", "_a.sid", "_a.now", "_w", "other_ts"), "landed-edit")


def conflicts(asks: DataFrame, intents: DataFrame, edits: DataFrame, fresh_secs: int = INTENT_SECS) -> DataFrame:
    """in_flight, and landed where nothing is in flight."""
    first = in_flight(asks, intents, fresh_secs)
    return first.unionByName(landed(asks, edits).join(first.select("ask"), "ask", "left_anti"))


def attribution(asks: DataFrame, edits: DataFrame) -> DataFrame:
    """Per ask: the other writer whose edit of the file is youngest, of equally young ones the first: one of the file's two newest writers."""
    newest = _writes(edits).groupBy("_key", "_w").agg(F.max("other_ts").alias("other_ts"))
    two = newest.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("other_ts"), "_w"))).where("_n <= 2")
    met = _asks(asks).join(two, "_key").where("_own <> _w.key")
    return _found(met.groupBy("ask").agg(F.min(F.struct("_n", "_w", "other_ts", "sid", "now")).alias("x")).select("ask", "x.*"), "landed-edit")


def radar_sessions(edits: DataFrame, intents: DataFrame) -> DataFrame:
    """Per session of flat rows (sid, agent, updated_ms, ...): agents, edits, intents, last activity."""
    rows = edits.select("sid", "agent", "updated_ms", F.lit(1).alias("e"), F.lit(0).alias("i")).unionByName(intents.select("sid", "agent", "updated_ms", F.lit(0).alias("e"), F.lit(1).alias("i")))
    out = rows.groupBy("sid").agg(F.countDistinct("agent").alias("agents"), F.max("updated_ms").alias("last_ms"), F.sum("e").alias("edits"), F.sum("i").alias("intents"))
    return out.orderBy(F.desc("last_ms"), "sid")


def radar_files(edits: DataFrame, intents: DataFrame, now: int | Column, fresh_secs: int = INTENT_SECS, top: int = 12) -> DataFrame:
    """Paths as written that two sessions touched, or on which an edit is in flight: latest first."""
    fresh = _now(now) - F.col("ts") < fresh_secs * 1000
    rows = edits.select("sid", "path", "ts", F.lit(False).alias("f")).unionByName(intents.select("sid", "path", "ts", fresh.alias("f")))
    out = rows.groupBy("path").agg(F.countDistinct("sid").alias("sids"), F.max("ts").alias("last_ms"), F.bool_or("f").alias("in_flight"))
    return out.where((F.col("sids") >= 2) | F.col("in_flight")).orderBy(F.desc("last_ms"), "path").limit(top)
