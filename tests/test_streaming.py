import random

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.operators import delivery, guard
from sparkloom.streaming import ledger, seen

COLUMNS = "session string, kind string, key string, ts long, hash string, ask long, tool string, exists boolean, disk_hash string"


def rows():
    m = lambda s, k, t, h: (s, "mark", k, t, h, None, None, None, None)
    e = lambda s, k, t, ask, disk, tool="Edit": (s, "edit", k, t, None, ask, tool, True, disk)
    return [
        [m("s", "/a", 10, "h"), e("s", "/a", 11, 1, "h"), e("s", "/b", 12, 2, "x")],
        [e("s", "/a", 20, 3, "g"), m("s", "/a", 5, "late"), e("s", "/a", 21, 4, "h"), m("t", "/a", 22, None)],
        [("s", "reset", None, 30, None, None, None, None, None), e("s", "/a", 31, 5, "h"), e("t", "/a", 32, 6, "anything"), e("s", "/b", 33, 7, "x", "Read")],
    ]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], COLUMNS).write.parquet(src)
    stream = seen.guard_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for batch in rows():
            spark.createDataFrame(batch, COLUMNS).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        got = {r.ask: r.verdict for r in spark.table("verdicts").collect()}
    finally:
        q.stop()
    assert got == {1: "allow", 2: "never-seen", 3: "drift", 4: "allow", 5: "never-seen", 6: "allow", 7: "allow"}

    flat = spark.createDataFrame([(*r, i) for i, r in enumerate(r for b in rows() for r in b)], COLUMNS + ", seq long")
    marks = flat.where("kind = 'mark'").select("session", "key", "ts", "seq", "hash")
    epoch = F.when((F.col("session") == "s") & (F.col("key") == "/a") & (F.col("ts") > 30), 30).otherwise(-1)
    edits = flat.where("kind = 'edit'").select("session", "ask", "tool", F.col("key").alias("path"), "seq", "exists", "disk_hash", epoch.cast("long").alias("epoch_ms"))
    assert {r.ask: r.verdict for r in guard.judge_edits(edits, marks, ["session"]).collect()} == got


def run(spark, tmp_path, name, schema, batches, through):
    """Rows of a stream over batches that arrive one by one."""
    src = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(src)
    q = through(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_the_newest_files_are_kept(spark, tmp_path):
    """A session that has seen more files than it may keep, in one batch and over several, against the batch form."""
    mark = lambda s, k, t: (s, "mark", k, t, f"h{t}", None, None, None, None)
    edit = lambda s, k, ask: (s, "edit", k, 1000, None, ask, "Edit", True, None)
    marks = [[mark("s", f"/f{k}", 10 + k) for k in range(8)] + [mark("t", "/f0", 5)], [mark("s", "/f3", 40), mark("s", "/g", 39), mark("s", "/e", 14)], [mark("s", "/x", 39), mark("s", "/f0", 1)]]
    keys = [f"/f{k}" for k in range(8)] + ["/g", "/e", "/x"]
    asks = [edit(s, k, n) for n, (s, k) in enumerate((s, k) for s in "st" for k in keys)]
    got = run(spark, tmp_path, "capped", COLUMNS, [*marks, asks], lambda r: seen.guard_stream(r, cap=4))
    flat = spark.createDataFrame([(r[0], r[2], r[3], r[4], n) for n, r in enumerate(r for b in marks for r in b)], "session string, key string, ts long, hash string, seq long")
    kept = sorted((r.session, r.key, r.ts) for r in guard.latest_seen(flat, ["session"], cap=4).collect())
    assert sorted((r.session, r.key, r.seen_ts) for r in got if r.verdict == "allow") == kept
    assert {k for s, k, _ in kept if s == "s"} == {"/f3", "/g", "/x", "/f7"}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """By the rows' own times: a session's timer moves on with it; one that rests loses marks and reset."""
    at = lambda s, kind, k, minute, ask=None: (s, kind, k, minute * 60_000, None, ask, "Edit" if ask is not None else None, True, None)
    batches = [
        [at("idle", "mark", "/a", 1), at("busy", "mark", "/a", 1)], [at("busy", "mark", "/b", 20)], [at("busy", "mark", "/c", 45), at("clock", "mark", "/", 45)], [at("clock", "mark", "/", 50)], [at("clock", "mark", "/", 51)],
        [at("busy", "edit", "/a", 52, 1), at("idle", "edit", "/a", 52, 2)],
    ]
    got = {r.ask: r.verdict for r in run(spark, tmp_path, "idle", COLUMNS, batches, lambda r: seen.guard_stream(r, idle_ms=30 * 60_000, delay="1 minute"))}
    assert got == {1: "allow", 2: "never-seen"}


def test_ledger_equals_batch(spark, tmp_path):
    """Reads of two sessions in batches, with new epochs, forced reads, sizes below a marker and files larger than the ledger."""
    rng, rows = random.Random(3), []
    for n in range(240):
        path = f"/f{rng.randrange(7)}"
        version = rng.randrange(3)
        rows.append((rng.choice("st"), n, path, rng.choice(["full", "full", "lines:1-2"]), n // 90, f"{path}{version}", rng.choice([10, 256, 257, 700, 1500, 5000]) + version, rng.random() < 0.1))
    schema = "session string, seq long, path string, view string, epoch long, hash string, bytes long, force boolean"
    got = run(spark, tmp_path, "ledger", schema, [rows[:50], rows[50:51], rows[51:180], rows[180:]], lambda r: ledger.delivery_stream(r, 4000))
    want = delivery.decide(spark.createDataFrame(rows, schema), force=F.col("force"), ledger_bytes=4000).select("session", "seq", "kind", "base_hash").collect()
    assert sorted((r.session, r.seq, r.kind, r.base_hash) for r in got) == sorted(map(tuple, want))
    assert len({r.kind for r in got}) == 3


def test_conflicts_by_file(spark, tmp_path):
    columns = "key string, kind string, sid string, agent string, ts long, ask long, verdict string, tool string, exists boolean, seen_ts long, seen_hash string"
    wrote = lambda k, kind, sid, ts: (k, kind, sid, "main", ts, None, None, None, None, None, None)
    ask = lambda k, sid, ts, n, seen=5, h="h", verdict="allow", tool="Edit", exists=True: (k, "ask", sid, "main", ts, n, verdict, tool, exists, seen, h)
    batches = [
        [wrote("/a", "intent", "t", 1000), ask("/a", "s", 2000, 1), ask("/a", "t", 2000, 2), ask("/a", "s", 100_000, 3), ask("/b", "s", 2000, 4)],
        # the ask that was allowed is an intent now; a landed edit ends it
        [ask("/b", "t", 3000, 5), wrote("/b", "landed", "s", 4000), ask("/b", "t", 5000, 6), ask("/b", "t", 5000, 7, h=None), ask("/b", "u", 5000, 8, seen=4500, h=None)],
        [ask("/c", "s", 10, 9, verdict="drift"), ask("/c", "s", 10, 10, tool="Read"), ask("/c", "s", 10, 11, exists=False), ask("/c", "t", 20, 12)],
    ]
    src = str(tmp_path / "in")
    spark.createDataFrame([], columns).write.parquet(src)
    out = seen.conflict_stream(spark.readStream.schema(columns).parquet(src))
    q = out.writeStream.format("memory").queryName("conflicts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, columns).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        got = {r.ask: (r.conflict, r.other_sid, r.allowed, r.intent) for r in spark.table("conflicts").collect()}
    finally:
        q.stop()
    assert got == {
        1: ("in-flight", "t", False, False), 2: (None, None, True, True), 3: (None, None, True, True), 4: (None, None, True, True), 5: ("in-flight", "s", False, False), 6: (None, None, True, True),
        7: ("landed-edit", "s", False, False), 8: ("in-flight", "t", False, False), 9: (None, None, False, False), 10: (None, None, True, False), 11: (None, None, True, False), 12: (None, None, True, True),
    }


def test_stream_dedup_of_edits(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "sid string, agent string, path string, ts long, hash string, ts_time timestamp"
    rows = [("s", "a", "f", 2500, None), ("s", "a", "f", 2600, "h"), ("s", "a", "f", 2700, "g"), ("s", "a", "f", 9000, None), ("s", "a", "f", 9100, None), ("s", "b", "f", 2500, None)]
    write = lambda some: spark.createDataFrame(some, "sid string, agent string, path string, ts long, hash string").withColumn("ts_time", F.timestamp_millis("ts")).write.mode("append").parquet(src)
    write(rows)
    q = seen.dedup_edits(spark.readStream.schema(schema).parquet(src), "10 seconds").writeStream.format("memory").queryName("edits_once").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        write([("z", "z", "z", 60_000, None)])
        q.processAllAvailable()
        assert sorted((r.sid, r.agent, r.ts, r.hash) for r in spark.table("edits_once").collect()) == [("s", "a", 2600, "h"), ("s", "a", 9000, None), ("s", "b", 2500, None)]
    finally:
        q.stop()


class Store:
    """A state store in memory that counts what is asked of it."""

    def __init__(self):
        self.states, self.calls = {}, 0

    def getMapState(self, name, *kinds):
        return self.states.setdefault(name, Entries(self))

    getValueState = getMapState


class Entries:
    def __init__(self, store):
        self.store, self.kept = store, {}

    def exists(self):
        return None in self.kept

    def get(self):
        return self.kept[None]

    def update(self, value):
        self.kept[None] = value

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.kept

    def getValue(self, key):
        self.store.calls += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.kept[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.kept[key]

    def iterator(self):
        self.store.calls += len(self.kept)
        return iter(list(self.kept.items()))

    def clear(self):
        self.kept.clear()


def calls(processor, columns, batches):
    """Rows that a processor gives for one group, and what the last batch asked of the store."""
    store, out = Store(), []
    processor.init(store)
    for batch in batches:
        store.calls = 0
        frames = [pd.DataFrame(batch[at : at + 100], columns=columns) for at in range(0, len(batch), 100)]
        out += [r for pdf in processor.handleInputRows(("s",), iter(frames), None) for r in pdf.itertuples(index=False)]
    return out, store.calls


def test_rows_of_one_millisecond(spark, tmp_path):
    """An edit doesn't see marks of its own millisecond, but loses what a reset of it takes; of equally new marks the last hash counts, whatever their order."""
    mark = lambda k, t, h: ("s", "mark", k, t, h, None, None, None, None)
    edit = lambda k, t, ask: ("s", "edit", k, t, None, ask, "Edit", True, "h")
    rows = [mark("/a", 1, "h"), mark("/a", 5, "g"), edit("/a", 5, 1), edit("/a", 6, 2), mark("/b", 3, "z"), mark("/b", 3, "h"), edit("/b", 4, 3), mark("/c", 5, "h"), edit("/c", 5, 4), edit("/a", 9, 5), ("s", "reset", None, 9, None, None, None, None, None)]
    for n, batch in enumerate((rows, rows[::-1])):
        got = {r.ask: (r.verdict, r.seen_ts) for r in run(spark, tmp_path / str(n), f"ties{n}", COLUMNS, [batch], seen.guard_stream)}
        assert got == {1: ("allow", 1), 2: ("drift", 5), 3: ("drift", 3), 4: ("never-seen", None), 5: ("never-seen", 5)}


def test_ledger_fetches_entries_once():
    """2,000 reads of ten files under a ledger that forgets: the store is asked for files, not for reads."""
    rng = random.Random(5)
    rows = [(n, f"/f{rng.randrange(10)}", "full", 0, f"h{rng.randrange(3)}", 700, False) for n in range(4000)]
    got, asked = calls(ledger.LedgerProcessor(4000), ["seq", "path", "view", "epoch", "hash", "bytes", "force"], [rows[:2000], rows[2000:]])
    alone, _ = calls(ledger.LedgerProcessor(4000), ["seq", "path", "view", "epoch", "hash", "bytes", "force"], [[r] for r in rows])
    assert got == alone and len(got) == 4000 and {r.kind for r in got} == {"full", "changed", "unchanged"}
    assert asked < 200


def test_conflicts_fetch_writers_once():
    """Asks of a file with thirty writers; an intent that comes with or before its writer's landed edit is over, whichever row is first."""
    rng = random.Random(6)
    columns = ["key", "kind", "sid", "agent", "ts", "ask", "verdict", "tool", "exists", "seen_ts", "seen_hash"]
    rows = []
    for n in range(2000):
        kind = rng.choice(["intent", "landed", "ask"])
        own = (kind, f"s{rng.randrange(10)}", f"a{rng.randrange(3)}", n * 100)
        rows.append(("k", *own, n, "allow", "Edit", True, n * 100 - 5000, None) if kind == "ask" else ("k", *own, None, None, None, None, None, None))
    got, asked = calls(seen.ConflictProcessor(9000, None, False), columns, [rows[:1000], rows[1000:]])
    alone, _ = calls(seen.ConflictProcessor(9000, None, False), columns, [[r] for r in rows])
    assert got == alone and {r.conflict for r in got} >= {"in-flight"}
    assert asked < 200
    wrote = lambda kind: ("k", kind, "t", "a", 50, None, None, None, None, None, None)
    ask = ("k", "ask", "s", "a", 60, 1, "allow", "Edit", True, 10, "h")
    for first, second in (("intent", "landed"), ("landed", "intent")):
        assert [r.conflict for r in calls(seen.ConflictProcessor(9000, None, False), columns, [[wrote(first), wrote(second), ask]])[0]] == [None]
