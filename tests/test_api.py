import hashlib
import json

from pyspark.sql import functions as F

from sparkloom.plans import api
from sparkloom.plans.views import archive_events, meter_events

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def line(ts, **more):
    return json.dumps({"timestamp": f"2026-01-01T00:00:{ts:02}.000Z", **more})


def call(name, path):
    return {"message": {"content": [{"type": "tool_use", "name": name, "input": {"file_path": path}}]}}


def test_sweep(spark):
    read = lambda p, c, **k: {"toolUseResult": {"file": {"filePath": p, "content": c, "startLine": 1, "numLines": 1, "totalLines": 1}}, **k}
    lines = [line(1, **call("Read", "/a.ts")), line(2, **read("/a.ts", "old a")), line(3, **call("Edit", "/b.ts")), line(4, **call("Read", "/gone.ts")), line(5, **call("Edit", "/.env")), line(6, **read("/.env", "KEY=1")), line(7, **read("/a.ts", "old a")), "{{{", line(8, isSidechain=True, **call("Read", "/side.ts"))]
    disk = spark.createDataFrame([(p, True, len(c), False, c, sha(c)) for p, c in (("/a.ts", "new a"), ("/b.ts", "b"), ("/.env", "KEY=2"), ("/side.ts", "s"))], "path string, exists boolean, size long, binary boolean, content string, hash string")
    s = api.sweep(spark.createDataFrame(list(enumerate(lines)), "line int, value string"), disk, "sess")
    assert tuple(s.stats.first()) == (9, 8, 3, 2)
    assert [(r.path, r.hash, r.bytes, r.excluded) for r in s.working_set.collect()] == [("/.env", "", 0, True), ("/b.ts", sha("b"), 1, False), ("/a.ts", sha("new a"), 5, False)]
    assert {r.content for r in s.blobs.collect()} == {"old a", "new a", "b"}
    events = s.events.collect()
    assert len(events) == 5 and all(r.hash == "" and r.bytes == 0 and r.git_blob_sha1 is None for r in events if r.path == "/.env")
    assert "KEY" not in str(events)


def test_pack_gives_reasons(spark):
    rows = []
    for i, (p, sessions) in enumerate([("/big", 6), ("/bin", 5), ("/.env", 4), ("/lost", 3), ("/fat", 2), ("/ok", 1), ("/ok2", 1)]):
        rows += [(i * 10 + s, f"s{s}", p, "/", "h", False, 100) for s in range(sessions)]
    ev = spark.createDataFrame(rows, "seq long, session string, path string, repo string, hash string, excluded boolean, ts_ms long")
    disk = spark.createDataFrame([("/big", 3_000_000, False, "x"), ("/bin", 5, True, "x"), ("/.env", 5, False, "x"), ("/fat", 800, False, "y" * 800), ("/ok", 8, False, "12345678"), ("/ok2", 8, False, "12345678")], "path string, size long, binary boolean, content string")
    files, skipped = api.export_pack(ev, disk, 100, tokens=100, top=1)
    assert [(r.path, r.tokens) for r in files.collect()] == [("/ok", 2)]
    assert {r.path: r.reason for r in skipped.collect()} == {"/big": "too large", "/bin": "binary", "/.env": "secret-pattern", "/lost": "unreadable", "/fat": "over budget (~200 tok)"}


def test_restore_stays_in_its_budget(spark):
    entries = spark.createDataFrame([(1, "/a", sha("a" * 40)), (2, "/gone", "h"), (3, "/b", "old"), (4, "/c", "h")], "place int, path string, hash string")
    disk = spark.createDataFrame([("/a", "a" * 40, sha("a" * 40)), ("/b", "b" * 400, "new"), ("/c", "c" * 8, "h")], "path string, content string, hash string")
    got = [(r.path, r.status, r.changed) for r in api.restore_context(entries, disk, 20).orderBy("place").collect()]
    assert got == [("/a", "sent", False), ("/gone", "unreadable", None), ("/b", "over-budget", True), ("/c", "sent", False)]


def test_receipts_verify_and_show_tampering(spark):
    m = meter_events(spark, SF)
    receipt, signature = api.context_receipt(m, "artifact", "2026-01-01T00:00:00.000Z", "key", archive_events(spark, SF))
    assert api.verify_context_receipt(receipt, signature, "key") and receipt["sources"] == ["mcp", "transcript-sweep"]
    assert receipt["totals"]["reads"] == m.count() and sum(f["reads"] for f in receipt["files"]) == m.count()
    assert not api.verify_context_receipt(receipt | {"artifact": "other"}, signature, "key")


def test_written_receipts(spark, tmp_path):
    """The signature of the document on the driver, from rows that tasks have written."""
    m, ev = meter_events(spark, SF).withColumn("excluded", F.col("path") == "/r1/f4"), archive_events(spark, SF)
    for n, events in enumerate((None, ev)):
        path = str(tmp_path / str(n))
        signature = api.write_receipt(m, 'an "artifact" é', "2026-01-01T00:00:00.000Z", "key", path, events)
        assert signature == api.context_receipt(m, 'an "artifact" é', "2026-01-01T00:00:00.000Z", "key", events)[1]
        assert api.verify_receipt(spark, path, signature, "key") and not api.verify_receipt(spark, path, signature, "other") and not api.verify_receipt(spark, path, None, "key")
        spark.createDataFrame([(1 << 50, "{}")], "n long, json string").write.mode("append").parquet(f"{path}/files")
        assert not api.verify_receipt(spark, path, signature, "key")
    empty = str(tmp_path / "empty")
    assert api.write_receipt(m.limit(0), "a", "t", "key", empty) == api.context_receipt(m.limit(0), "a", "t", "key")[1]


def test_stats_blame_and_status(spark):
    stats = api.context_stats(meter_events(spark, SF))
    assert stats["totals"].first().saved_usd.startswith("$") and stats["by_repo"].count() == 3 and stats["top_files"].count() == 8
    ev = archive_events(spark, SF)
    now = ev.agg(F.max("ts_ms")).first()[0]
    blobs = ev.where("k = 10").select("hash").distinct()
    b = api.context_blame(ev, blobs, "/r0/f10.ts", now, window_minutes=7200, days=60)
    assert b.versions.where("in_archive").count() == b.versions.count() > 0 and b.counters.first().excluded_events == 0
    rec = [("s", "main", 1, 990, [("f", 980)], [("g", 970, None)]), ("t", "main", 1, 995, [], [("g", 960, "h")]), ("old", "main", 1, -2_000_000, [], [("g", 1, None)])]
    records = spark.createDataFrame(rec, "sid string, agent string, pid long, updatedAt long, intents array<struct<path: string, ts: bigint>>, edits array<struct<path: string, ts: bigint, hash: string>>").withColumn("mtime", F.col("updatedAt"))
    status = api.coordination_status(records, 1000)
    assert [(r.sid, r.edits, r.intents) for r in status["sessions"].collect()] == [("t", 1, 0), ("s", 1, 1)]
    assert [(r.path, r.sids, r.in_flight) for r in status["files"].collect()] == [("f", 1, True), ("g", 2, False)]
    assert api.bump_epoch(5, 3) == 6 and api.bump_epoch(5, 9) == 9


def test_guard_with_conflicts(spark):
    marks = spark.createDataFrame([("s", "/a", 10, 1, "h"), ("s", "/b", 10, 1, None)], "session string, key string, ts long, seq long, hash string")
    edits = spark.createDataFrame([("s", 1, "Edit", "/a", 20, 2, True, "h", 0, "s", "main", 20), ("s", 2, "Edit", "/b", 20, 2, True, "x", 0, "s", "main", 20), ("s", 3, "Edit", "/c", 20, 2, True, "x", 0, "s", "main", 20)], "session string, ask long, tool string, path string, ts long, seq long, exists boolean, disk_hash string, epoch_ms long, sid string, agent string, now long")
    intents = spark.createDataFrame([], "sid string, agent string, path string, ts long")
    landed = spark.createDataFrame([("t", "main", "/b", 15), ("t", "main", "/a", 15)], "sid string, agent string, path string, ts long")
    got = {r.ask: (r.verdict, r.conflict, r.allowed) for r in api.guard_edits(edits, marks, intents, landed, ["session"]).collect()}
    assert got == {1: ("allow", None, True), 2: ("allow", "landed-edit", False), 3: ("never-seen", None, False)}


def test_reading_in_order(spark):
    big = "x\n" * 400
    rows = [("s", 0, "/a", "full", big, False, 1), ("s", 1, "/a", "full", big, False, 1), ("s", 2, "/.env", "full", "K", False, 1)]
    df = spark.createDataFrame(rows, "session string, seq long, path string, view string, content string, force_full boolean, epoch long")
    assert [(r.kind, r.archived) for r in api.read_files(df).orderBy("seq").collect()] == [("full", True), ("unchanged", True), ("full", False)]
    files = spark.createDataFrame([("/a", "def f():\n  pass"), ("/b", "nothing")], "path string, content string")
    assert [(r.path, r.total_lines, r.line, r.text) for r in api.outline(files).orderBy("path").collect()] == [("/a", 2, 1, "def f():"), ("/b", 1, None, None)]


def test_read_file_views_errors_and_records(spark):
    text = "def f():\n    return 1\n\n" + "\n".join(f"x{i} = {i}" for i in range(100))
    disk = spark.createDataFrame([("/a.py", len(text), False, text), ("/.env", 5, False, "K=123"), ("/b", 5, True, "x"), ("/big", 3_000_000, False, "x")], "path string, size long, binary boolean, content string")
    asks = [("/a.py", None, None), ("\\a.py", "", ""), ("/a.py", "f", "1-2"), ("/a.py", "nope", None), ("/a.py", None, "4 - 5"), ("/a.py", None, "x-5"), ("/a.py", None, "90-9999"), ("/gone", None, None), ("/b", None, None), ("/big", None, None), ("/.env", None, None)]
    requests = spark.createDataFrame([("s", i, p, sy, li, False, 1) for i, (p, sy, li) in enumerate(asks)], "session string, seq long, path string, symbol string, lines string, force_full boolean, epoch long")
    a = api.read_file(requests, disk)
    sent = {r.seq: r for r in a.sent.collect()}
    assert {k: (r.kind, r.view) for k, r in sent.items()} == {0: ("full", "full"), 1: ("unchanged", "full"), 2: ("full", "sym:f"), 4: ("full", "lines:4-5"), 6: ("full", "lines:90-103"), 10: ("full", "full")}
    assert sent[2].content == "def f():\n    return 1" and (sent[2].first_line, sent[2].last_line) == (1, 2) and sent[4].content == "x0 = 0\nx1 = 1"
    assert {r.seq: r.error for r in a.errors.collect()} == {3: "no such symbol", 5: "bad line range", 7: "unreadable", 8: "binary", 9: "too large"}
    meter = {r.seq: r for r in a.meter.collect()}
    assert set(meter) == set(sent) and meter[10].hash == "" and meter[10].git_blob_sha1 is None and meter[1].base_hash == meter[0].hash and meter[2].git_blob_sha1 is None
    assert {(r.seq, r.hash, r.bytes, r.excluded) for r in a.events.collect()} == {(0, sha(text), len(text), False), (1, sha(text), len(text), False), (10, "", 0, True)}
    assert [r.content for r in a.blobs.collect()] == [text]


def test_restores_are_reads(spark):
    disk = spark.createDataFrame([("/a", 400, False, "a" * 400, sha("a" * 400)), ("/b", 400, False, "b" * 400, sha("b" * 400)), ("/c", 4000, False, "c" * 4000, sha("c" * 4000))], "path string, size long, binary boolean, content string, hash string")
    entries = spark.createDataFrame([(1, "/a", sha("a" * 400)), (2, "/b", "old"), (3, "/c", "h"), (4, "/gone", "h")], "place int, path string, hash string")
    earlier = spark.createDataFrame([("s", 5, "/a", None, None, False, 1), ("t", 9, "/b", None, None, False, 1)], "session string, seq long, path string, symbol string, lines string, force_full boolean, epoch long")
    plan, reads = api.restore_and_record(entries, disk, earlier, "s", 1, tokens=250)
    assert {r.path: r.status for r in plan.collect()} == {"/a": "sent", "/b": "sent", "/c": "over-budget", "/gone": "unreadable"}
    assert sorted((r.seq, r.path, r.kind) for r in reads.sent.collect()) == [(6, "/a", "unchanged"), (7, "/b", "full")]
    assert sorted((r.seq, r.path, r.source, r.op) for r in reads.events.collect()) == [(6, "/a", "mcp", "read"), (7, "/b", "mcp", "read")]
    assert len(reads.meter.collect()) == 2 and sorted(r.hash for r in reads.blobs.collect()) == sorted([sha("a" * 400), sha("b" * 400)])


def test_injected_text(spark):
    kind = "session string, mtime long, ts string, entries array<struct<path: string, hash: string, bytes: bigint, approxTokens: bigint, reads: bigint, edits: bigint, lastOp: string, lastTs: string, excluded: boolean>>"
    entry = lambda p, x=False: (p, "" if x else "h" * 64, 10, 3, 2, 1, "read", "t", x)
    m = spark.createDataFrame([("s", 5, "T", [entry("/a"), entry("/.env", True)]), ("long", 5, "T", [entry("/" + "p" * 200) for _ in range(60)]), ("none", 5, "T", [])], kind)
    text = api.inject(m, "s", "compact", 10).first().text
    assert text == "Working set of session s as of T:\n1. /a (2 reads, 1 edits, ~3 tok, hash hhhhhhhhhhhh)\n2. /.env (2 reads, 1 edits, ~3 tok, not archived (secret-pattern))"
    long = api.inject(m, "long", "resume", 10).first().text
    assert len(long) == 9500 + len("\n[truncated]") and long.endswith("\n[truncated]")
    assert api.inject(m, "s", "startup", 10).collect() == [] and api.inject(m, "none", "compact", 10**12).collect() == []


def test_publish(spark):
    kind = "sid string, agent string, pid long, updatedAt long, intents array<struct<path: string, ts: bigint>>, edits array<struct<path: string, ts: bigint, hash: string>>"
    records = spark.createDataFrame([("s", "main", 7, 5, [("/a", 900), ("/b", 950)], [("/c", 800, None)]), ("t", "main", 8, 5, [("/a", 900)], [])], kind)
    landed = spark.createDataFrame([("s", "main", "/a", 1000, "h"), ("u", "x", "/z", 1000, None)], "sid string, agent string, path string, ts long, hash string")
    got = {r.sid: r for r in api.publish(records, landed, 1000).collect()}
    assert set(got) == {"s", "u"} and [tuple(x) for x in got["s"].intents] == [("/b", 950)] and got["s"].pid == 7 and got["s"].updatedAt == 1000
    assert [tuple(x) for x in got["s"].edits] == [("/c", 800, None), ("/a", 1000, "h")] and [tuple(x) for x in got["u"].edits] == [("/z", 1000, None)] and got["u"].intents == []
