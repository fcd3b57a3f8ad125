import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import ppm


def brute(rows, order):
    """Every document coded symbol by symbol, contexts looked up in the training streams themselves."""
    tok = [(i, h, (t or "").encode().lower().split()) for i, h, t in rows]
    c = Counter(w for _, h, ws in tok if not h for w in [*ws, ppm.END])
    N, V = sum(c.values()), len(c)
    ctx = defaultdict(Counter)

    def coded(ws):
        s = b" " * order + b" ".join(ws) + ppm.END
        return [(s[k - order : k], s[k]) for k in range(order, len(s))]

    for _, h, ws in tok:
        if not h:
            for before, x in coded(ws):
                for k in range(order + 1):
                    ctx[before[order - k :]][x] += 1

    def lp(before, x):
        total, gone = 0.0, set()
        for k in range(order, -1, -1):
            own = ctx.get(before[order - k :])
            if not own:
                continue
            left = {y: n for y, n in own.items() if y not in gone}
            t, d = sum(left.values()), len(left)
            if x in left:
                return total + math.log10((left[x] - 0.5) / t)
            if d:
                total += math.log10(d / (2 * t))
            gone |= set(own)
        return total - math.log10(max(1, 256 - len(ctx[b""])))

    return sorted(
        (i, h, len(ws) + 1, sum(c[w] > 0 for w in [*ws, ppm.END]), N, round(sum(math.log10((c[w] + 1) / (N + V + 1)) for w in [*ws, ppm.END]), 6), round(sum(lp(*p) for p in coded(ws)), 6))
        for i, h, ws in tok
    )


def rounded(df):
    return sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé", k=rng.randrange(1, 8))) for _ in range(50)]
    rows = [(i, i % 7 == 2, rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 40)) + [f"x{i}Q"])) for i in range(40)]
    rows += [(100, False, None), (101, True, ""), (102, False, "A" * 3000), (102, False, "dup dup"), (103, True, "Zz\x00z 日本")]
    docs = spark.createDataFrame([(i, t, h, 1) for i, h, t in rows], "doc_id long, text string, h boolean, word int")
    for order, head, grams in ((4, 5, 20), (5, 1000, 100000), (2, 0, 0)):
        assert rounded(ppm.score(docs, F.col("h"), order=order, head=head, head_grams=grams)) == brute(rows, order)


def test_a_text_over_many_steps(monkeypatch):
    rng = random.Random(2)
    texts = [[bytes(rng.choices(b"abc", k=rng.randrange(1, 5))) for _ in range(n)] for n in (0, 1, 50, 3, 0, 200)]
    whole = list(ppm._grams(texts, 3))
    for step in (1, 2, 7, 64):
        monkeypatch.setattr(ppm, "STEP", step)
        parts = list(ppm._grams(texts, 3))
        for k in range(2):
            assert [x for p in parts for x in p[k].tolist()] == [x for p in whole for x in p[k].tolist()]


def test_order_of_words_matters(spark):
    rows = [(1, False, "ab cd ef gh " * 20), (2, True, "ab cd ef gh"), (3, True, "gh ef cd ab")]
    docs = spark.createDataFrame([(i, t, h) for i, h, t in rows], "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in ppm.score(docs, F.col("h")).collect()}
    assert got[2] > got[3]


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert round(got[1].score, 6) == round(-3 * math.log10(256), 6) and got[1].train_tokens == 0 and got[1].n_known == 0
    assert round(got[None].score, 6) == round(-math.log10(256), 6)


def test_empty(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []
