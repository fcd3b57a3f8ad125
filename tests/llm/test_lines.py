import random
import re
from collections import Counter, defaultdict

from sparkloom.llm import lines as L

WORD = re.compile("[^\x20\x09-\x0d]+")


def normal(line):
    table = {**{ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "0" for c in "123456789"}}
    return re.sub("[\x20\x09-\x0d]+", " ", line.translate(table)).strip(" ")


def brute(rows, limit, least):
    docs = [(i, s, t or "", [x for x in (t or "").split("\n") if WORD.search(x)]) for i, t, s in rows]
    n = Counter((s, k) for s, _, ks in {(s, t, frozenset(normal(x) for x in ls)) for _, s, t, ls in docs} for k in ks)
    out = []
    for i, s, t, ls in docs:
        w = WORD.findall(t)
        grams = defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        covered = {p + j for ps in grams.values() if len(ps) > 1 for p in ps for j in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        gone = sum(len(WORD.findall(x)) for x in ls if n[s, normal(x)] > limit)
        kept = not failed and not (2 * gone > len(w) or len(w) - gone < least)
        clean = "\n".join(x for x in t.split("\n") if not (WORD.search(x) and n[s, normal(x)] > limit))
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered), failed, kept, gone, clean))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"Wörd{k}" for k in range(60)] + ["#", "a|b", "😀", "12"]
    common = ["All rights reserved 2020.", "all  RIGHTS reserved 1999. ", "Read more", "x " * 12]
    rows = []
    for i in range(120):
        ls = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(rng.randrange(1, 5))]
        ls += [rng.choice(common) for _ in range(rng.randrange(0, 3))]
        rng.shuffle(ls)
        rows.append((i, "\n".join(ls), rng.choice(["h1", "h2", None])))
    rows += [(200, None, "h1"), (201, "", None), (202, " \n\t\n", "h2"), (203, "a b c d e " * 4000, "h1"), (204, "a b c d e f", "h1"), (204, "a b c d e f", "h1"), (None, "a b c d e a b c d e f\r\x0bg", "h2"), (205, "a b c d", "h1"), (206, "a b c d e", "h1")]
    docs = spark.createDataFrame([(*r, 7, 1) for r in rows], "doc_id long, text string, source string, n_words int, _row int")
    want = brute(rows, 8, 4)
    got = L.line_quality(docs, limit=8, least_words=4, cleaned=True)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted(map(tuple, L.line_quality(docs, limit=8, least_words=4).collect()), key=repr) == sorted((r[:-1] for r in want), key=repr)
    assert sum(r[-2] > 0 for r in want) > 20 and sum(not r[-4] and r[-3] for r in want) < len(want)
    assert L.line_quality(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = L.line_quality(docs, cleaned=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_copies_are_one_document(spark):
    page = "\n".join(f"line {k} of a page that was copied often and says nothing else at all {'x' * k}" for k in range(4))
    rows = [(i, page, "h") for i in range(40)] + [(100 + i, f"own words of document {'abcdefghijklmnopqrstuvwxyz'[i]}, quite a few of them here\nshared foot line", "h") for i in range(12)]
    got = {r.doc_id: r for r in L.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), cleaned=True).collect()}
    assert all(got[i].n_line_words == 0 and got[i].clean_text == page for i in range(40))
    assert all(got[100 + i].n_line_words == 3 and "shared" not in got[100 + i].clean_text for i in range(12))
