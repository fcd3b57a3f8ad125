import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import induce, suffixes


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + window] for t in raw for k in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus():
    rng = random.Random(7)
    letters = "abcdefgh éß日 "
    noise = lambda n: "".join(rng.choices(letters, k=n))
    common, phrase = noise(90), noise(17)
    texts = [noise(rng.randrange(0, 300)) for _ in range(40)]
    texts += [noise(rng.randrange(0, 60)) + common[rng.randrange(0, 30) :] + noise(rng.randrange(0, 60)) for _ in range(30)]
    texts += [noise(25) + phrase + noise(25) for _ in range(40)]  # shorter than a window, in ever new surroundings
    texts += [texts[3]] * 30 + [texts[5][:50] + "X" + texts[5][51:], None, "", "=" * 500, "ab" * 200, "=" * 19, "x" + "=" * 20, noise(19)]
    return texts + [noise(40) * 3, noise(10) + "=" * 25 + noise(10)]


@pytest.mark.parametrize("hot, shard, memory, held", [(1 << 20, 1 << 20, 1 << 20, 1 << 20), (60, 1 << 20, 1 << 20, 1 << 20), (1 << 20, 500, 5, 100)])
def test_against_brute_force(spark, hot, shard, memory, held):
    texts = corpus()
    rows = [(None if k == 7 else k % 150, t, k, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bucket long, kept string").repartition(5)
    got = suffixes.dedup(df, keep=("_bucket", "kept"), window=20, gram=8, hot=hot, shard_bytes=shard, memory=memory, held=held)
    assert got.columns == ["doc_id", "_bucket", "kept", "n_bytes", "n_removed", "n_spans", "kept"]
    found = {r[1]: (r[0], r[3], r[4], r[5], bytes(r[6])) for r in got.collect()}
    want = brute(texts, 20)
    assert found == {k: (rows[k][0], *w) for k, w in enumerate(want)}


def test_long_texts(spark):
    """Texts that are hashed in several pieces: a passage across a border, and one at different distances from it."""
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 1_300_000).astype(np.uint8).tobytes().decode()
    short = [body[1_048_576 - 150 : 1_048_576 + 150], body[1_048_600:1_049_000], body[500_000:500_199]]
    rows = [(0, body), *enumerate(short, 1)]
    got = {r.doc_id: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_removed, got[0].n_spans) == (300 + 400 - 126, 1) and bytes(got[0].kept) == (body[: 1_048_576 - 150] + body[1_049_000:]).encode()
    assert [(got[k].n_removed, got[k].n_spans) for k in (1, 2, 3)] == [(300, 1), (400, 1), (0, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup(df).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.dedup(df).collect()) == [(1, 0, 0, b""), (2, 0, 0, b""), (3, 5, 0, b"short")]


@pytest.mark.parametrize("memory, held", [(0, 0), (3, 64), (1000, 1 << 20)])
def test_suffix_array(memory, held):
    """Order and common lengths by comparison, with recursion down to the last name and queues on disk."""
    rng = random.Random(memory)
    for _ in range(150):
        text = [rng.randrange(1, rng.choice([2, 3, 6, 21])) for _ in range(rng.randrange(1, 80))]
        text = text * rng.choice([1, 1, 2]) + [0]
        limit = rng.choice([3, 7, 200])
        parts = list(induce.suffixes(np.array(text), limit, memory, held))
        order = np.concatenate([p[0] for p in parts])[::-1].tolist()
        common = [0, *np.concatenate([p[1] for p in parts])[::-1].tolist()][:-1]
        assert sorted(order) == list(range(len(text)))
        assert [text[i : i + limit] for i in order] == sorted(text[i : i + limit] for i in order)
        for a, b, n in zip(order, order[1:], common[1:]):
            same = 0
            while same < limit and max(a, b) + same < len(text) and text[a + same] == text[b + same]:
                same += 1
            assert n == same
