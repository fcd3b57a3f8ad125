import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.sources import stores


def event(ts, path="/a", hash_="h", **more):
    return json.dumps({"ts": ts, "path": path, "hash": hash_, "session": "s", "bytes": 3, **more})


def test_event_logs(spark, tmp_path):
    (tmp_path / "w1.jsonl").write_text("\n".join([event("2026-01-01T00:00:00.000Z"), "", "{broken", json.dumps({"ts": "x", "path": 1}), event("2026-01-03T00:00:00.000Z", excluded=True)]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "w2.jsonl").write_text(event("not a time", "/b") + "\n" + event("2026-01-02T00:00:00.000Z", "/c"))
    all_ = stores.oldest_first(stores.read_events(spark, str(tmp_path))).collect()
    assert [r.path for r in all_ if r.ts[0] == "2"] == ["/a", "/c", "/a"] and len([r for r in all_ if r.path in ("/a", "/b", "/c")]) == 4
    since = stores.read_events(spark, str(tmp_path), 1767312000000)
    assert sorted(r.ts for r in since.collect() if r.path != "1") == ["2026-01-02T00:00:00.000Z", "2026-01-03T00:00:00.000Z", "not a time"]


def test_event_table_prunes_days(spark, tmp_path):
    df = spark.createDataFrame([("s", "/a", "h")], "session string, path string, hash string")
    for day in (1, 2, 3):
        stores.append_events(df, str(tmp_path / "t"), f"2026-01-0{day}T10:00:00.000Z")
    rows = stores.read_event_table(spark, str(tmp_path / "t"), 1767312000000)
    assert rows.count() == 2
    assert "day#" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_blobs_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "blobs")
    for texts in (["a", "b", "a"], ["b", "c", None]):
        stores.put_blobs(spark, stores.as_blobs(spark.createDataFrame([(t,) for t in texts], "content string"), F.lit(1)), path)
    assert sorted(r.content for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("named", [0, 1000])
def test_a_put_leaves_the_store_where_it_is(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(stores, "NAMED", named)
    path = str(tmp_path / "blobs")
    blobs = lambda texts: stores.as_blobs(spark.createDataFrame([(t,) for t in texts], "content string"), F.lit(1))
    stores.put_blobs(spark, blobs([f"old {k}" for k in range(300)]), path)
    some = blobs(["old 7", "new", "old 299"])
    found = stores.stored_among(spark, some, path)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.hash for r in found.collect()) == sorted(r.hash for r in blobs(["old 7", "old 299"]).collect())
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("Relation")[0].split("Project [hash")[0]
    if named:
        assert "PartitionFilters: [part" in executed and "In(hash" in executed
    else:
        assert "BroadcastHashJoin" in executed
    # two puts that don't see each other
    late = stores.stored_among
    monkeypatch.setattr(stores, "stored_among", lambda s, c, p: late(s, c, p).limit(0))
    stores.put_blobs(spark, some, path)
    monkeypatch.setattr(stores, "stored_among", late)
    stores.put_blobs(spark, some, path)
    held = [r.content for r in stores.read_blobs(spark, path).collect()]
    assert len(held) == 301 and len(set(held)) == 301 and spark.read.parquet(path).count() == 303


def test_transcript_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x\r\n\ny\n")
    assert [(r.line, r.value) for r in stores.read_transcripts(spark, str(tmp_path)).collect()] == [(0, "x"), (2, "y")]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_lines_of_a_file_in_several_splits(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(stores, "BROADCAST_SPLITS", broadcast)
    texts = {f: ["" if k % 7 == 0 else f"{f}{k}" + "." * (k % 50) for k in range(n)] for f, n in (("a", 900), ("b", 1), ("c", 250))}
    for f, lines in texts.items():
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + "\n" * (f != "c"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = stores.read_transcripts(spark, str(tmp_path))
        got = sorted((r.file[-7], r.line, r.value) for r in found.collect())
        assert found.rdd.getNumPartitions() > 3 and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f, k, x) for f, lines in texts.items() for k, x in enumerate(lines) if x)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_text("x" * 100)
    assert [r.content for r in stores.read_files(spark, str(tmp_path), 50).collect()] == ["text"]


def test_manifests(spark):
    ranked = spark.createDataFrame([(f"/f{i:02}", i % 3, i, f"t{i}") for i in range(20)], "path string, edits long, reads long, last_ts string")
    m = stores.manifest(ranked, A.heat_order(), "a/b", "now").first()
    assert m.file == "a_b" and len(m.entries) == 12 and m.entries[0].path == "/f19"
    held = spark.createDataFrame([("old", 10), ("new", 990), ("newer", 995), ("future", 2000)], "session string, mtime long")
    pick = lambda s, age=100: [r.session for r in stores.manifest_as_of(held, s, 1000, age).collect()]
    assert pick("old") == ["old"] and pick("none") == ["newer"] and pick(None) == ["newer"] and pick("none", 1) == []


def test_presence_files(spark, tmp_path):
    (tmp_path / "s__main.json").write_text(json.dumps({"sid": "s", "agent": "main", "updatedAt": 5, "intents": [{"path": "f", "ts": 1}], "edits": []}))
    (tmp_path / "bad.json").write_text("{")
    rows = stores.read_presence(spark, str(tmp_path)).collect()
    assert [(r.sid, r.intents[0].path) for r in rows] == [("s", "f")] and rows[0].mtime > 0


def test_records_replace_their_own_writers_only(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "sid string, agent string, pid long, updatedAt long, intents array<struct<path: string, ts: bigint>>, edits array<struct<path: string, ts: bigint, hash: string>>"
    save = lambda *rows: stores.save_presence(spark.createDataFrame([(s, a, 1, t, [], [("f", t, None)]) for s, a, t in rows], schema), path)
    save(("s/1", "main", 5), ("t", "sub", 6))
    save(("s/1", "main", 9))
    assert sorted((r.sid, r.updatedAt, r.edits[0].ts) for r in stores.read_presence(spark, path).collect()) == [("s/1", 9, 9), ("t", 6, 6)]
    seen = spark.createDataFrame([("r", "/a", 1, "h"), ("q", "/b", 2, None)], "who string, key string, ts long, hash string")
    stores.save_seen(seen, "who", str(tmp_path / "g"))
    stores.save_seen(seen.where("who = 'r'").withColumn("ts", F.lit(7).cast("long")), "who", str(tmp_path / "g"))
    assert [tuple(r) for r in stores.load_seen(spark, str(tmp_path / "g"), "r").collect()] == [("/a", 7, "h")]
    assert [tuple(r) for r in stores.load_seen(spark, str(tmp_path / "g"), "q").collect()] == [("/b", 2, None)]


def test_git_heads(tmp_path, spark):
    repo = tmp_path / "r"
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    repo.mkdir()
    run("init", "-q", "-b", "trunk")
    assert stores.git_head(str(repo)) == {"branch": "trunk"}
    (repo / "f").write_text("x")
    run("add", "f")
    run("commit", "-qm", "c")
    sha = run("rev-parse", "HEAD")
    assert stores.git_head(str(repo)) == {"branch": "trunk", "sha": sha}
    run("pack-refs", "--all")
    assert stores.git_head(str(repo)) == {"branch": "trunk", "sha": sha}
    run("worktree", "add", "-q", "-b", "side", str(tmp_path / "w"))
    assert stores.git_head(str(tmp_path / "w")) == {"branch": "side", "sha": sha}
    run("checkout", "-q", "--detach")
    assert stores.git_head(str(repo)) == {"sha": sha} and stores.git_head(str(tmp_path / "none")) == {}
    assert stores.repo_heads(spark, [str(repo), "/none"]).where("head_sha is null").count() == 1
