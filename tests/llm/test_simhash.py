import random
from decimal import Decimal

import xxhash

from sparkloom.llm import simhash as S


def brute_components(rows):
    fps = {i: S.simhash(t) for i, t in rows}
    group = {i: i for i in fps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_by_definition():
    for t in (None, "", "one", "one two", "One TWO three four four four É", "a b " * 900):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert S.simhash(t) == want


def flipped(rng, fp):
    for _ in range(rng.randrange(0, 3)):
        fp ^= 1 << rng.randrange(64)
    return fp


def test_links_reach_every_component(spark, monkeypatch):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        fps.append(flipped(rng, rng.choice(fps)))
    for limit in (32, 2):
        monkeypatch.setattr(S, "PAIR_LIMIT", limit)
        monkeypatch.setattr(S, "simhash", lambda t, shingle=3: fps[int(t)])
        want = brute_components_of(fps)
        classes = spark.createDataFrame([(S._signed(f), fps.index(f)) for f in set(fps)], "fp long, rep long")
        edges = S.links(classes)
        group = {r.node: r.component for r in S.connected_components(edges).collect()}
        assert {i: group.get(fps.index(f), fps.index(f)) for i, f in enumerate(fps)} == want


def brute_components_of(fps):
    group = list(range(len(fps)))
    for _ in range(len(fps)):
        old = list(group)
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
        if old == group:
            break
    return dict(enumerate(group))


def test_query_on_odd_rows(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(90)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " x") for i in range(20)] + [(200, None), (201, ""), (202, " \n"), (7, rows[7][1]), (300, "é " * 9000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows] + [(None, None, "c"), (None, "nobody else", "c")], "doc_id long, text string, component_id string")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    want = brute_components(rows)
    assert all(r.component_id == want[r.doc_id] and r.fingerprint == f"{S.simhash(dict(rows)[r.doc_id]):016x}" for r in got if r.doc_id is not None)
    assert sorted((r.component_id or -1) for r in got if r.doc_id is None) == [-1, 200]
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_left_out_ids_may_lie_beyond_longs(spark):
    """Copies without an id stand under numbers beyond longs: they take no part, and leaving them out is no overflow."""
    text, big = " ".join(f"w{k}" for k in range(40)), Decimal(18257816793136140811)
    docs = spark.createDataFrame([(Decimal(k), text) for k in (1, 2, 3)] + [(big, text)], "id decimal(20,0), text string")
    without = spark.createDataFrame([(big,), (Decimal(3),)], "id decimal(20,0)")
    pairs = S.near_pairs(docs, without, "id", "text")
    assert [(int(r.u), int(r.v)) for r in pairs.collect()] == [(1, 2)]
