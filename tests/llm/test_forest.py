import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import forest


def brute(rows, k):
    fine = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in fine if i % 10 == 0):
        near = sorted((float(np.sqrt(((v - fine[q]) ** 2).sum())), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        out[q] = near[:k]
    return out


def data(n=1200, d=16):
    x = np.random.default_rng(5).standard_normal((n, d)).astype("float32")
    x[: n // 3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(5000, None), (5010, [0.0] * d), (5020, [1.0, None] + [0.5] * (d - 2)), (5030, [float("nan")] * d), (5040, [float("inf")] + [1.0] * (d - 1)), (5050, []), (5060, [1.0, 2.0]), (5070, [1.0, 2.5]), (None, [1.0] * d)]


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    monkeypatch.setattr(forest, "SHARD_ROWS", 400)
    monkeypatch.setattr(forest, "BLOCK_QUERIES", 50)
    monkeypatch.setattr(forest, "LEAST", 60)
    got = {}
    for r in forest.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(rows, 10)
    assert set(got) == set(want)
    hit = total = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(near)
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        hit += len({m[2] for m in mine} & {i for _, i in near})
        total += len(near)
    assert hit / total >= 0.9
    assert [m[2] for m in sorted(got[0])] == list(range(1, 11))  # copies: distance zero, smallest ids first
    assert got[5060] == [(1, 0.5, 5070)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.search(df, F.col("vec_id") % 10 == 0).collect() == []


def test_repeated_rows_and_ids(spark, monkeypatch):
    rows = data(300)[:300]
    rows += rows + [rows[0]] * 15 + [(7, [2.0] * 16), (250, rows[120][1]), (120, rows[250][1])]
    monkeypatch.setattr(forest, "SHARD_ROWS", 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in forest.search(df, F.col("vec_id") % 10 == 0, share=64.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], round(r.score, 9), r.vec_id))
    own = {}
    for i, v in rows:
        own.setdefault(i, set()).add(tuple(np.float32(v).tolist()))
    for q in range(0, 300, 10):
        d = sorted((round(min(float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) for a in own[i] for b in own[q]), 9), i) for i in own if i != q)
        assert [m[1:] for m in sorted(got[q])] == d[:10]
