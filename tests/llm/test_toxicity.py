import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as T


def brute_segments(s):
    """The definition: the best segment (shortest, leftmost), then the same on what is left of it and right of it."""
    if not len(s):
        return []
    best = None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            x = sum(s[a:b])
            if x > 0 and (best is None or x > best[2] + 1e-9):
                best = (a, b, x)
    if best is None:
        return []
    a, b, x = best
    return brute_segments(s[:a]) + [(a, b, x)] + [(p + b, q + b, y) for p, q, y in brute_segments(s[b:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 7 for _ in range(rng.randrange(0, 14))]
        got = T.maximal_segments(np.array(s, dtype=float))
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def corpus():
    rng, words = random.Random(6), [f"word{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(400):
        w = rng.choices(words, k=rng.randrange(20, 120))
        toxic = i % 8 == 0
        for _ in range(rng.randrange(3, 7) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile!", "scum,", "filth"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "... !!", "x"), (None, "scum scum filth vile", "x"), (3, docs[3][1], "x"), (1003, "word1 " * 20000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    l = spark.createDataFrame([*labels, (2, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    m = T.fit(d, l, F.col("doc_id") % 5 != 0)
    rows = T.score(d, m).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 400 and (r.score >= 0.5) != (r.doc_id % 8 == 0)]
    assert not wrong
    odd = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id >= 1000}
    assert odd[None].score > 0.5 and odd[None].passages and max(odd[k].score for k in (1000, 1001, 1002, 1003)) < 0.5


def test_without_examples(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    l = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert 0 < T.score(d, T.fit(d, l, F.lit(True))).first().score < 0.5
    assert T.score(d.limit(0), T.fit(d.limit(0), l, F.lit(True))).collect() == []


def test_fit_by_hand(spark):
    docs, labels = corpus()
    docs += [(5, docs[5][1], "x"), (500, "vile scum here", "x")]
    labels += [(7, 1, 1), (500, 1, None)]  # 7 is labelled both ways: toxic
    d, l = spark.createDataFrame(docs, "doc_id long, text string, _toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = T.fit(d, l, F.col("doc_id") % 5 != 0)
    flag = {}
    for i, _, t in labels:
        if t is not None and i % 5:
            flag[i] = flag.get(i, False) or t > 0
    sample = {(flag[i], t) for i, t, _ in docs if i in flag}
    seen = {(f, w, b) for f, t in sample for w, b in zip(T.tokens(t), [b"", *T.tokens(t)])}
    toxic, clean = {}, {}
    for f, w, _ in seen:
        own = toxic if f else clean
        own[w] = own.get(w, 0) + 1
    n1, n0, want = sum(toxic.values()), sum(clean.values()), {}
    for w in toxic:
        t, c = toxic[w], clean.get(w, 0)
        a, b = t + T.PRIOR * (t + c), c + T.PRIOR * (t + c)
        odds, deviation = np.log(a / n1) - np.log(b / n0), np.sqrt(1 / a + 1 / b)
        if t > 1 and odds > T.OFFSET and odds >= T.EVIDENCE * deviation and odds - deviation > T.OFFSET:
            want[w] = odds - deviation
    assert set(m.scores) == set(want) and all(abs(m.scores[w] - want[w]) < 1e-9 for w in want) and b"scum" in want
    best, logs = [], []
    for f, t in sample:
        words = T.tokens(t)
        if not f and words:
            best.append(max((x for *_, x in brute_segments_fast([want.get(w, -T.DRIFT) for w in words])), default=0.0))
            logs.append(np.log(len(words)))
    scale = max(0.25, float(np.std(best)) * np.sqrt(6) / np.pi)
    assert abs(m.scale - scale) < 1e-9 and abs(m.place - float(np.mean(np.array(best) - scale * np.array(logs)) - 0.5772 * scale)) < 1e-9


def brute_segments_fast(s):
    """The best segment alone, by Kadane's walk."""
    top = now = 0.0
    for x in s:
        now = max(0.0, now + x)
        top = max(top, now)
    return [(0, 0, top)] if top else []


def test_fit_gathers_pairs_in_little_memory(spark, monkeypatch):
    """Word pairs are held as numbers and sent on when many; the fitted model is the same, however often that is."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["vile", "scum"]) if k % 4 == 0 and n % 9 == 5 else f"w{rng.randrange(300)}" for n in range(60))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")
    whole = T.fit(docs, labels, F.lit(True))
    monkeypatch.setattr(T, "TOGETHER", 100)
    assert T.fit(docs, labels, F.lit(True)).scores == whole.scores and {b"vile", b"scum"} <= set(whole.scores)
