import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparkloom.llm import resample


def features(text, n):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(found), [" ".join(found[k : k + m]) for k in range(len(found)) for m in range(1, n + 1) if k + m <= len(found)]


def brute(docs, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        size, found = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), size >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    place = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], place.get(id(r))) for r in out]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "naïve", "ß", "日本語", "x1y"]
    docs = [(i, rng.choice([" ", "\n", "_", "-"]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \t.,"), (None, "Same words here " * 9), (203, "LONG and Short! " * 20000), (204, "a\x00b\x7fc\xa0d")]
    docs += [(300, "tied words again " * 8)] * 6 + [(5, docs[5][1])]
    target = ["w1 w2 w3 ärger", None, "", "w1 w1 Same words", "ÄRGER naïve"]
    return docs, target


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force(spark, n):
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, score string, _row int").repartition(5)
    want = brute(docs, target, n, 97, 30, 12)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=30, min_words=12)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("nodes", [0, 40])
def test_folded_tries_count_the_same(monkeypatch, nodes):
    monkeypatch.setattr(resample, "MAX_NODES", nodes)
    texts = [t for _, t in corpus()[0] if t and len(t) < 5000]
    want = Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t, 2)[1])
    trie, gains = resample.Trie(2, 97), [k * k for k in range(97)]
    weighed = resample.Trie(2, 97, gains)
    for t in texts:
        trie.count(resample.words(t.encode()))
        assert trie.size <= nodes
        assert weighed.weigh(resample.words(t.encode())) == sum(gains[zlib.crc32(f.encode()) % 97] for f in features(t, 2)[1])
    trie.fold()
    assert dict(enumerate(trie.totals.tolist())) == {b: want[b] for b in range(97)}


def test_columns_that_are_kept(spark):
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, i, t) for i, t in docs], "doc_id long, text string, _id long, _text string")
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), keep=("text", "_id", "_text"))
    rows = got.collect()
    assert got.columns[:4] == ["doc_id", "text", "_id", "_text"] and len(rows) == len(docs)
    assert all(r._id == r.doc_id and r._text == r.text for r in rows)


def test_empty(spark):
    docs, nothing = corpus()[0], spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(nothing, nothing).collect() == []
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), nothing).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(docs, [], 1, 10_000, 10, 20), key=repr)
