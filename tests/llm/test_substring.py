import random

import pytest

from sparkloom.llm import substring as S


def brute(rows, window=13):
    first = {}
    docs = [(S.LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((None if i == S.LAST else i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    shared = [" ".join(rng.choices(words, k=25)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 30)))]
        if rng.random() < 0.7:
            parts.append(rng.choice(shared)[: rng.randrange(20, 80)])
            parts.append(" ".join(rng.choices(words, k=rng.randrange(0, 9))))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a " * 200), (n + 3, "a " * 500), (n + 3, "a " * 40), (None, rows[0][1]), (n + 4, rows[1][1]), (n + 5, "é\x0bü\x85 " * 20)]
    return rows


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    assert got(S.dedup(docs.select("doc_id", "text"))) == brute(rows)
    monkeypatch.setattr(S, "BUCKET_BYTES", 500)
    for batches, hot in ((1, S.HOT_BUCKETS), (5, 3)):
        monkeypatch.setattr(S, "HOT_BUCKETS", hot)
        assert got(S.dedup(docs, batches=batches)) == brute(rows)


def test_batches_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 700)
    rows = sorted((r for r in corpus(5, 48) if r[0] is not None), key=lambda r: r[0])
    index, found, levels = S.FingerprintIndex(spark, fanout=2), [], []
    for low in range(0, 60, 12):
        found.append(index.add(spark.createDataFrame([r for r in rows if low <= r[0] < low + 12], "doc_id long, text string")))
        levels.append([x.split("_")[0] for x in index.runs])
    assert levels == [["L0"], ["L1"], ["L1", "L0"], ["L2"], ["L2", "L0"]]
    assert sorted((r for f in found for r in got(f)), key=repr) == brute(rows)
    run = spark.table(f"{index.names}_{index.runs[0]}")
    assert run.count() == run.distinct().count() > 100


def test_work_follows_the_batch(spark, monkeypatch):
    """What a batch meets, and the history that is read for it, depend on the batch; neither texts nor runs of history are shuffled."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 600)
    rng = random.Random(8)
    text = lambda lo, hi: " ".join(f"w{rng.randrange(lo, hi)}" for _ in range(60))
    passage, met = text(0, 10**6), {}
    for size in (40, 160):
        index = S.FingerprintIndex(spark, fanout=9)
        old = [(i, f"{text(0, 10**6)} {passage if i == 7 else ''}") for i in range(size)]
        index.add(spark.createDataFrame(old[: size // 2], "doc_id long, text string"))
        index.add(spark.createDataFrame(old[size // 2 :], "doc_id long, text string"))
        new = index.add(spark.createDataFrame([(1000, f"{text(0, 10**6)} {passage}"), (1001, text(0, 10**6))], "doc_id long, text string"))
        assert sorted((r.doc_id, r.n_removed) for r in new.collect()) == [(1000, 60), (1001, 0)]
        last = index.held["runs"].pop()
        met[size] = index._met(last).groupBy("_bucket").count().collect()
        plan = new._jdf.queryExecution().optimizedPlan().toString()
        lines = new._jdf.queryExecution().executedPlan().toString().split("\n")
        assert "_text" in plan and not [x for x in lines if "Exchange" in x and "_text" in x]
        for k, x in enumerate(lines):  # a scan of texts stands below a sort for its bucket, never below an exchange
            if "FileScan" in x and "_text" in x:
                assert "Bucketed: true" in x and not any("Exchange" in y for y in lines[max(0, k - 3) : k])
    assert sorted(r["count"] for r in met[40]) == sorted(r["count"] for r in met[160]) and len(met[40]) == 2


def test_reopened(spark, monkeypatch):
    """Batches through indexes that are opened anew for each, by names of their own; what a failed batch left is written again."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 700)
    rows = sorted((r for r in corpus(5, 48) if r[0] is not None), key=lambda r: r[0])
    path, found = S.new_folder(spark, "kept-index"), []
    for low in range(0, 60, 12):
        index = S.FingerprintIndex(spark, path, fanout=2, window=13 if not low else 99)
        assert index.serial == low // 12 and index.window == 13
        batch = spark.createDataFrame([r for r in rows if low <= r[0] < low + 12], "doc_id long, text string")
        if low == 24:
            broken = S.FingerprintIndex(spark, path, fanout=2)
            with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
                m.setattr(broken, "_met", lambda run: 1 / 0)
                broken.add(batch)
        found.append(got(index.add(batch)))
    assert sorted((r for f in found for r in f), key=repr) == brute(rows)


def test_runs_are_merged_in_their_order(spark, monkeypatch):
    """Neither a sort nor a shuffle of runs in the join that finds what is met; only history's files that hold it are opened."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 600)
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    passage, index = text(), S.FingerprintIndex(spark, fanout=9)
    for low in (0, 100):
        index.add(spark.createDataFrame([(low + i, f"{text()} {passage if low + i == 7 else ''}") for i in range(60)], "doc_id long, text string"))
    index.add(spark.createDataFrame([(1000, f"{text()} {passage}")], "doc_id long, text string"))
    last = index.held["runs"].pop()
    spark.conf.set(S._IN_ORDER, "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._meets(last)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(S._IN_ORDER)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what is sorted is the list of the batch's own fingerprints that it holds twice
    assert plan.count("SortMergeJoin") == 5 and plan.count("Sort [") == 1 and "HashAggregate" in plan[plan.index("Sort [") :][:400] and "Exchange" not in plan
    met, scan = index._met(last), {}
    for name in index.texts[:2]:
        found = index._holding(name, met).groupBy("_bucket").agg(S.F.count("*").alias("n"))
        scan[name] = found._jdf.queryExecution().executedPlan().toString(), sum(r.n for r in found.collect())
    assert "SelectedBucketsCount: 1 out of 4" in scan["texts1"][0] and scan["texts1"][1] <= 3
    assert "LocalTableScan <empty>" in scan["texts2"][0] or scan["texts2"][1] == 0


def test_line_ends_stay():
    import numpy as np

    gone = np.array([False, True, True, False, False, True])
    assert S._without(b"a b\nc  d\te \n f", gone) == b"a\nd\te" and S._without(b" a\nb c d\ne f\n", np.array([False, False, True, True, False, False])) == b" a\nb\ne f\n"
    assert S._without(b"a b c", np.array([True, True, True])) == b"" and S._without(b"a\nx\nb", np.array([False, True, False])) == b"a\nb"


def test_empty(spark):
    assert got(S.dedup(spark.createDataFrame([], "doc_id long, text string"))) == []
