import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.operators import budget, delivery, guard, retention
from sparkloom.operators import presence as P
from sparkloom.plans.views import now_ms


def requests(spark, rows):
    df = spark.createDataFrame([(s, i, p, "full", c, f, e) for i, (s, p, c, f, e) in enumerate(rows)], "session string, seq long, path string, view string, content string, force_full boolean, epoch long")
    return df.withColumn("hash", F.sha2("content", 256)).withColumn("bytes", F.octet_length("content").cast("long"))


BIG = "\n".join(f"line {i} of a file" for i in range(200)) + "\n"


def test_delivery_kinds(spark):
    rows = [("s", "/a", BIG, False, 1), ("s", "/a", BIG, False, 1), ("s", "/a", BIG.replace("line 7 ", "LINE 7 "), False, 1), ("s", "/a", "gone", False, 1), ("s", "/a", "gone", False, 1), ("s", "/b", BIG, False, 1), ("s", "/b", BIG, True, 1), ("s", "/b", BIG, False, 2), ("t", "/b", BIG, False, 2)]
    df = requests(spark, rows)
    out = delivery.deliver(df).orderBy("seq").collect()
    assert [r.kind for r in out] == ["full", "unchanged", "diff", "full", "full", "full", "full", "full", "full"]
    assert out[2].base_hash == out[0].hash and out[2].sent_bytes < out[2].bytes
    plain = delivery.decide(df, force=F.col("force_full")).orderBy("seq").collect()
    assert [r.kind for r in plain] == ["full", "unchanged", "changed", "changed", "full", "full", "full", "full", "full"]


def test_delivery_never_loses_text(spark):
    rng = random.Random(99)
    texts = {p: BIG for p in "abc"}
    rows = []
    for i in range(200):
        p = rng.choice("abc")
        if rng.random() < 0.5:
            lines = texts[p].split("\n")
            lines[rng.randrange(len(lines))] = f"edit {i}"
            texts[p] = "\n".join(lines) if rng.random() < 0.9 else f"tiny {i}"
        rows.append((rng.choice("st"), p, texts[p], rng.random() < 0.1, i // 60))
    df = requests(spark, rows)
    for ledger in (64 << 20, 5000):
        held = delivery.reconstruct(delivery.deliver(df, ledger)).select("session", "seq", "text")
        assert held.join(df, ["session", "seq"]).where("text = content").count() == 200


def test_ledger_forgets_oldest(spark):
    rows = [("s", "/a", BIG, False, 1), ("s", "/b", BIG + "b", False, 1), ("s", "/b", BIG + "b", False, 1), ("s", "/a", BIG, False, 1)]
    kinds = [r.kind for r in delivery.deliver(requests(spark, rows), len(BIG) + 10).orderBy("seq").collect()]
    assert kinds == ["full", "full", "unchanged", "full"]


def test_patch_without_a_version_before(spark):
    df = spark.createDataFrame([("s", 0, "/a", "full", "unchanged", None, None)], "session string, seq long, path string, view string, kind string, content string, patch string")
    with pytest.raises(Exception, match="without a version"):
        delivery.reconstruct(df).collect()


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 60, False), ("g", 2, 50, False), ("g", 3, 30, False), ("g", 4, 20, True), ("g", 5, 10, False), ("h", 1, 101, False)], "g string, n int, size int, skip boolean")
    got = {(r.g, r.n): (r.taken, r.spent) for r in budget.greedy(df, ["g"], ["n"], "size", 100, free="skip").collect()}
    assert got == {("g", 1): (True, 60), ("g", 2): (False, None), ("g", 3): (True, 90), ("g", 4): (False, None), ("g", 5): (True, 100), ("h", 1): (False, None)}
    top = [r.n for r in budget.greedy(df, ["g"], ["n"], "size", 100, top=1).where("taken").collect()]
    assert top == [1]
    scored = df.where("g = 'g'").withColumn("score", -F.col("n").cast("double")).withColumn("key", F.col("n").cast("string"))
    assert [p["n"] for p in budget.pick(scored, "score", "key", "size", 100, 8)] == [1, 3, 5]


def test_long_rankings(spark):
    """Groups of thousands of rows, one of them most of the table, against the walk by hand."""
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", None, *"abcdefgh"]), n, rng.choice([None, 0, rng.randrange(1, 9), rng.randrange(1, 4000)]), rng.random() < 0.1) for n in range(9000)]
    df = spark.createDataFrame(rows, "g string, n long, size long, skip boolean").repartition(7)
    for top in (None, 25):
        want, state = {}, {}
        for g, n, size, skip in sorted(rows, key=lambda r: r[1]):
            spent, count = state.get(g, (0, 0))
            if skip or size is None or spent + size > 20_000 or count == top:
                want[n] = None
            else:
                state[g] = spent + size, count + 1
                want[n] = spent + size
        got = budget.greedy(df, ["g"], ["n"], "size", 20_000, top=top, free="skip")
        assert got.columns == [*df.columns, "taken", "spent"]
        assert {r.n: r.spent for r in got.collect()} == want and got.where("taken <> (spent is not null)").count() == 0
    picks = budget.pick(df.where("size is not null"), "size", "n", "size", 20_000, 6000)
    left, mine = 20_000, []
    for g, n, size, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[1])):
        if size <= left and len(mine) < 6000:
            left -= size
            mine.append(n)
    assert [p["n"] for p in picks] == mine


def test_pack_order(spark):
    rows = [(i, s, "/hot", "h1", False) for i, s in enumerate("abc")] + [(10 + i, "a", "/churn", f"h{i}", False) for i in range(5)] + [(20, "z", "/.env", "", True)]
    df = spark.createDataFrame(rows, "seq long, session string, path string, hash string, excluded boolean")
    assert [(r.path, r.score) for r in A.pack_stats(df).orderBy(*A.pack_order()).collect()] == [("/hot", 33.0), ("/churn", 3.0)]


def test_receipts_keep_pairs_apart_and_exclusion_sticks(spark):
    rows = [(0, "dir::sub", "full", "h", False), (1, "dir", "sub::full", "h", False), (2, "k", "full", "h1", False), (3, "k", "full", "", True), (4, "k", "full", "h2", False)]
    df = spark.createDataFrame([(*r, "full", None) for r in rows], "seq long, path string, view string, hash string, excluded boolean, kind string, git_blob_sha1 string")
    got = {(r.path, r.view): (r.final_hash, r.hashes_seen, r.excluded) for r in A.receipt_files(df).collect()}
    assert got == {("dir::sub", "full"): ("h", "h", False), ("dir", "sub::full"): ("h", "h", False), ("k", "full"): ("", "", True)}


NOW = 10_000_000


def conflict(spark, seen_ts=None, seen_hash=None, intent=None, edit=None, me=("me", "main"), them=("you", "main"), path="f"):
    asks = spark.createDataFrame([(1, *me, "f", NOW, seen_ts, seen_hash)], "ask long, sid string, agent string, path string, now long, seen_ts long, seen_hash string")
    intents = spark.createDataFrame([(*them, path, intent)] if intent is not None else [], "sid string, agent string, path string, ts long")
    edits = spark.createDataFrame([(*them, path, edit)] if edit is not None else [], "sid string, agent string, path string, ts long")
    rows = P.conflicts(asks, intents, edits).collect()
    return rows[0].kind if rows else None


def test_conflict_matrix(spark):
    assert conflict(spark, intent=NOW - 90_000) == "in-flight"
    assert conflict(spark, intent=NOW - 90_001) is None
    assert conflict(spark, intent=NOW + 1) is None
    assert conflict(spark, intent=NOW - 10, seen_ts=NOW - 5) is None
    assert conflict(spark, intent=NOW - 10, seen_ts=NOW - 10) == "in-flight"
    assert conflict(spark, intent=NOW - 10, them=("me", "sub")) == "in-flight"
    assert conflict(spark, intent=NOW - 10, them=("me", "main")) is None
    assert conflict(spark, intent=NOW - 10, path="other") is None
    assert conflict(spark, edit=NOW - 10, seen_ts=NOW - 20) == "landed-edit"
    assert conflict(spark, edit=NOW - 20, seen_ts=NOW - 20) is None
    assert conflict(spark, edit=NOW - 10, seen_ts=NOW - 20, seen_hash="h") is None
    assert conflict(spark, edit=NOW - 10) is None


def test_conflicts_on_one_file(spark):
    """Everything happens on one file: each ask against all rows by hand; what the joins put out stays in proportion to the rows."""
    rng = random.Random(4)
    writers = [(s, a) for s in ("me", "s1", "s2", "s3") for a in ("main", "sub")]
    at = lambda: rng.randrange(0, 600_000)
    rows = [(*rng.choice(writers), "f", at()) for _ in range(1500)]
    intents, edits = rows[:900], rows[900:]
    asks = []
    for n in range(900):
        now = at()
        asks.append((n, *rng.choice(writers), "f", now, rng.choice([None, now - rng.randrange(0, 120_000), rng.choice(edits)[3]]), rng.choice([None, None, "h"])))
    name = lambda w: f"{w[0]}__{w[1]}"

    def first(ask, kind, fits, order):
        found = [(order(o), o) for o in (intents if kind == "in-flight" else edits) if o[:2] != ask[1:3] and fits(o[3])]
        return (kind, *min(found)[1][:2], ask[4] - min(found)[1][3]) if found else None

    want, young = {}, {}
    for ask in asks:
        now, seen, h = ask[4:]
        by_name = lambda o: (name(o), o[3])
        hit = first(ask, "in-flight", lambda t: 0 <= now - t <= 90_000 and not (seen is not None and seen > t), by_name)
        hit = hit or (first(ask, "landed-edit", lambda t: t > seen, by_name) if seen is not None and h is None else None)
        if hit:
            want[ask[0]] = hit
        young[ask[0]] = first(ask, "landed-edit", lambda t: True, lambda o: (-o[3], name(o)))
    a = spark.createDataFrame(asks, "ask int, sid string, agent string, path string, now long, seen_ts long, seen_hash string")
    i, e = (spark.createDataFrame(x, "sid string, agent string, path string, ts long") for x in (intents, edits))
    got = lambda df: {r.ask: (r.kind, r.other_sid, r.other_agent, r.age_ms) for r in df.collect()}
    assert got(P.conflicts(a, i, e)) == want and got(P.attribution(a, e)) == young
    busiest = 0
    for df in (P.in_flight(a, i), P.landed(a, e), P.attribution(a, e)):
        df.collect()
        busiest = max(busiest, *[int(x) for x in re.findall(r"number of output rows: (\d+)", metrics(df))], 0)
    assert busiest <= P.SPREAD * len(rows)


def metrics(df):
    """The numbers that an executed plan's nodes have counted."""
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            left.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            left.append(node.plan())
        m = node.metrics().get("numOutputRows")
        if m.isDefined():
            out.append(f"number of output rows: {m.get().value()}")
        left += [node.children().apply(k) for k in range(node.children().size())]
    return "\n".join(out)


def test_kept_edits(spark):
    rows = [(0, 2500, None), (1, 2600, "h"), (2, 7499, None), (3, 7600, None), (4, 12_500, None)]
    df = spark.createDataFrame([("s", "a", "f", *r) for r in rows], "sid string, agent string, path string, seq long, ts long, hash string")
    got = sorted(r.seq for r in P.kept_edits(df, 20_000).collect())
    assert got == [1, 3, 4]  # 2500..7499 round to one bucket, where the hashed row wins
    assert sorted(r.seq for r in P.kept_edits(df, 20_000, kept=2).collect()) == [3, 4]
    assert P.kept_edits(df, 2_000_000).count() == 0


def test_verdicts(spark):
    cases = [("Edit", "/f", True, 5, "h", "h", 4, "allow"), ("Edit", "/f", True, 5, "h", "g", 4, "drift"), ("Edit", "/f", True, 5, None, "g", 4, "allow"), ("Edit", "/f", True, 4, "h", "h", 4, "never-seen"), ("Write", "/f", True, None, None, "h", 0, "never-seen"), ("Write", "/f", False, None, None, None, 0, "allow"), ("NotebookEdit", "/f", True, None, None, "h", 0, "allow"), ("MultiEdit", "", True, None, None, "h", 0, "allow"), ("Edit", None, True, None, None, "h", 0, "allow")]
    df = spark.createDataFrame(cases, "tool string, path string, there boolean, ts long, seen string, disk string, epoch long, want string")
    c = F.col
    assert df.where(guard.verdict(c("tool"), c("path"), c("there"), c("ts"), c("seen"), c("disk"), c("epoch")) != c("want")).count() == 0


def test_latest_seen_ties_and_lost_hashes(spark):
    df = spark.createDataFrame([("r", "k", 5, 1, "a"), ("r", "k", 5, 2, None), ("r", "j", 9, 3, "b"), ("r", "j", 8, 4, "c")], "who string, key string, ts long, seq long, hash string")
    assert sorted((r.key, r.ts, r.hash) for r in guard.latest_seen(df, ["who"]).collect()) == [("j", 9, "b"), ("k", 5, None)]
    assert [r.key for r in guard.latest_seen(df, ["who"], cap=1).collect()] == ["j"]


def test_eviction_is_by_write_time(spark):
    df = spark.createDataFrame([(f"h{i}", 10, i * 7) for i in range(30)], "hash string, bytes long, mtime long")
    for size in (5, 100, 1000):
        assert sorted(r.mtime // 7 for r in retention.evicted_blobs(df, 95, size).collect()) == list(range(21))
    assert now_ms(df, "mtime") == 203


def _history(spark, reads):
    schema = "session string, seq long, path string, view string, content string, force_full boolean, epoch long"
    return spark.createDataFrame(reads, schema).withColumn("hash", F.sha2("content", 256))


def test_reconstruct_walks_partitions(spark):
    """Interleaved files of two sessions, answered in full, by markers and by patches, are walked without a group for each."""
    rng, body = random.Random(4), "".join(f"line {i}\n" for i in range(60))
    reads = [(rng.choice("st"), n, f"/f{rng.randrange(40)}", "full", body + f"end {rng.randrange(3)}\n", False, n // 400) for n in range(900)]
    sent = delivery.deliver(_history(spark, reads))
    held = delivery.reconstruct(sent)
    assert not [at for at in held._jdf.queryExecution().executedPlan().toString().splitlines() if "FlatMapGroups" in at and "rebuild" in at]
    assert {(r.session, r.seq): r.text for r in held.collect()} == {(r[0], r[1]): r[4] for r in reads}
    assert {r.kind for r in sent.select("kind").distinct().collect()} == {"full", "unchanged", "diff"}


def test_reconstructed_deals_contents_out_once(spark):
    """One exchange holds contents, from reads to what the reader holds; rows that lie otherwise are refused, never walked wrongly."""
    rng, body = random.Random(5), "".join(f"line {i}\n" for i in range(60))
    reads = [(rng.choice("st"), n, f"/f{rng.randrange(20)}", "full", body + f"end {rng.randrange(3)}\n", rng.random() < 0.1, n // 150) for n in range(400)]
    sent = delivery.deliver(_history(spark, reads))
    held = delivery.reconstruct(sent, dealt=True)
    wide = 0
    assert {(r.session, r.seq): r.text for r in held.collect()} == {(r[0], r[1]): r[4] for r in reads}
    plan = [held._jdf.queryExecution().executedPlan().initialPlan()]
    while plan:
        node = plan.pop()
        plan += [node.children().apply(i) for i in range(node.children().size())]
        wide += "Exchange" in node.nodeName() and bool({"content", "patch", "text", "_before"} & {a.name() for a in [node.output().apply(i) for i in range(node.output().size())]})
    assert wide == 1
    with pytest.raises(Exception, match="without a version before it"):
        delivery.reconstruct(sent.orderBy(F.desc("seq")), dealt=True).collect()


def test_sessions_are_ordered_without_contents(spark):
    """What is put in order by session alone has no contents in it."""
    sent = delivery.deliver(_history(spark, [("s", 1, "/a", "full", "x", False, 1)]))
    plan, found = [sent._jdf.queryExecution().optimizedPlan()], 0
    while plan:
        node = plan.pop()
        plan += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window" and node.partitionSpec().size() <= 2:
            found += 1
            assert not {"content", "_before"} & {a.name() for a in [node.output().apply(i) for i in range(node.output().size())]}
    assert found


def test_forgotten_only_where_the_ledger_overflowed(spark):
    """Reads that follow each other at once lose nothing however much is read, against a ledger kept by hand; those far apart do."""
    rng = random.Random(8)
    near = [("near", n, f"/f{n // 4}", f"h{n % 4 // 2}", 300 + n % 7) for n in range(400)]
    far = [("far", n, f"/f{rng.randrange(9)}", f"h{rng.randrange(3)}", rng.choice([100, 256, 257, 700, 1500])) for n in range(400)]
    reads = spark.createDataFrame([(*r[:3], "full", *r[3:], 0) for r in near + far], "session string, seq long, path string, view string, hash string, bytes long, epoch_run long")
    ledger, held, ever, want = {}, 0, set(), set()
    for _, n, path, h, size in far:
        if path not in ledger and path in ever:
            want.add(("far", n))
        ever.add(path)
        if path not in ledger or ledger[path][0] != h or size <= delivery.MARKER_BYTES:
            ledger.pop(path, None)
            ledger[path] = (h, size)
            while sum(s for _, s in ledger.values()) > 4000 and next(iter(ledger)) != path:
                ledger.pop(next(iter(ledger)))
    gone = delivery.forgotten(reads, 4000)
    assert {(r.session, r.seq) for r in gone.collect()} == want and want
