import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import api
from sparkloom.streaming import sweeps

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
DISK = "path string, exists boolean, size long, binary boolean, content string"
LINES = "session string, line long, value string"


def said(ts, **more):
    return json.dumps({"timestamp": f"2026-01-01T00:00:{ts:02}.000Z", **more})


def call(name, path):
    return {"message": {"content": [{"type": "tool_use", "name": name, "input": {"file_path": path}}]}}


def whole(path, text):
    return {"toolUseResult": {"file": {"filePath": path, "content": text, "startLine": 1, "numLines": 1, "totalLines": 1}}}


def transcript():
    out = []
    for s in ("s", "t"):
        lines = [said(1, **call("Read", "/a.ts")), said(2, **whole("/a.ts", f"old a of {s}")), said(3, **call("Edit", "/b.ts")), said(4, **call("Read", "/gone.ts")), said(5, **call("Edit", "/.env")), said(6, **whole("/.env", "KEY=1")),
                 said(7, **whole("/a.ts", f"old a of {s}")), "{{{", said(8, isSidechain=True, **call("Read", "/side.ts")), said(9, **call("Write", "/A.ts".lower())), said(10, **whole("/a.ts", "x" * 40)), said(11, **whole("/a.ts", "y" * 5))]
        out += [(s, n, x) for n, x in enumerate(lines)]
    return out


def disk(spark):
    return spark.createDataFrame([(p, True, len(c), False, c) for p, c in (("/a.ts", "new a"), ("/b.ts", "b"), ("/.env", "KEY=2"), ("/side.ts", "s"))], DISK)


def state(spark, root):
    rows = lambda name: sorted(map(str, sweeps.read(spark, root, name).collect()))
    return {name: rows(name) for name in sweeps._TABLES}


@pytest.mark.parametrize("cuts", [[12], [3, 12], [1, 4, 7, 10, 12]])
def test_batches_add_up_to_one_sweep(spark, tmp_path, cuts):
    root, rows = str(tmp_path / "archive"), transcript()
    sink = sweeps.SweepSink(root, disk(spark), exact_bytes=40)
    low = 0
    for k, high in enumerate(cuts):
        sink(spark.createDataFrame([r for r in rows if low <= r[1] < high], LINES), k)
        low = high
    for s in ("s", "t"):
        lines = spark.createDataFrame([(n, x) for q, n, x in rows if q == s], "line int, value string")
        want = api.sweep(lines, disk(spark).withColumn("hash", F.sha2("content", 256)), s, exact_bytes=40)
        one = sweeps.stats(spark, root).where(F.col("session") == s).first()
        assert (one.lines, one.parsed_lines, one.reads_seen, one.edits_seen) == tuple(want.stats.first())
        assert one.exact_versions == 3  # forty bytes more don't fit beside the first, five do
        entries = sweeps.manifests(spark, root).where(F.col("session") == s).first().entries
        assert [(e.path, e.hash, e.bytes, e.reads, e.edits, e.lastOp, e.excluded) for e in entries] == [(r.path, r.hash, r.bytes, r.reads, r.edits, r.last_op, r.excluded) for r in want.working_set.collect()]
    events = sweeps.read(spark, root, "events").collect()
    assert "KEY" not in str(events) and all(r.hash == "" and r.bytes == 0 for r in events if r.path == "/.env")
    exact = sorted((r.session, r.hash) for r in events if r.path == "/a.ts" and r.hash != sha("new a"))
    assert exact == sorted((s, sha(x)) for s in "st" for x in (f"old a of {s}", "y" * 5))
    blobs = [r.content for r in sweeps.read(spark, root, "blobs").collect()]
    assert sorted(blobs) == sorted(["old a of s", "old a of t", "y" * 5, "new a", "b"])


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    root, rows = str(tmp_path / "archive"), transcript()
    sink = sweeps.SweepSink(root, disk(spark), exact_bytes=40)
    halves = [spark.createDataFrame([r for r in rows if (r[1] < 6) == first], LINES) for first in (True, False)]
    for k, half in enumerate(halves):
        sink(half, k)
    once = state(spark, root)
    sink(halves[1], 1)
    assert state(spark, root) == once
    # what a batch that failed half-way left behind is replaced
    sweeps.read(spark, root, "events").where("batch = 1").drop("batch").limit(1).write.mode("append").parquet(f"{root}/events/batch=2")
    sink(spark.createDataFrame([], LINES), 2)
    assert state(spark, root) == once


def test_a_stream(spark, tmp_path):
    """Two runs of a query over files that arrive, from one checkpoint."""
    src, root = str(tmp_path / "in"), str(tmp_path / "archive")
    rows = transcript()
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(src)
        asked = []

        def on_disk(wanted):
            asked.append(wanted.count())
            return disk(spark)

        q = spark.readStream.schema(LINES).parquet(src).writeStream.foreachBatch(sweeps.SweepSink(root, on_disk)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert asked
    got = {r.session: (r.lines, r.exact_versions) for r in sweeps.stats(spark, root).collect()}
    assert got == {"s": (12, 4), "t": (12, 4)} and sweeps.read(spark, root, "stats").select("batch").distinct().count() == 2
    assert [e.path for e in sweeps.manifests(spark, root).where("session = 't'").first().entries] == ["/a.ts", "/.env", "/b.ts"]
