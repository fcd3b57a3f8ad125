import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _part int"


def brute(rows, parts, entries, rounds):
    fine = [(i, [max(-codes.LARGEST, min(codes.LARGEST, math.floor(4096 * float(np.float32(x))))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(order[0][1])]
    first = [r[1] for r in order[:entries] if len(r[1]) == len(order[0][1])]
    width = -(-len(first[0]) // parts)
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[piece(v, p) for v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda c: (far(piece(v, p), books[p][c]), c)) for p in range(parts)] for _, v, _ in fine]
    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v, _), code in zip(fine, assign()):
            for p, c in enumerate(code):
                members[p, c].append(piece(v, p))
        for (p, c), held in members.items():
            books[p][c] = [sum(x) // len(held) for x in zip(*held)]
    out = [(i, "".join(f"{c:02x}" for c in code), sum(far(piece(v, p), books[p][c]) for p, c in enumerate(code)), lab) for (i, v, lab), code in zip(fine, assign())]
    by = defaultdict(int)
    for _, _, e, lab in out:
        by[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return [(i, code, e, by[lab], digest) for i, code, e, lab in out]


def data(d):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.4) for _ in range(d)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 7]], rng.choice([None, 1, 2, 3])) for i in range(260)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(130)]  # a third are copies
    rows += [(500, None, 1), (501, [], 1), (502, [None] + [0.5] * (d - 1), 1), (503, [float("nan")] * d, 1), (504, [float("-inf")] + [0.5] * (d - 1), None)]
    return rows + [(505, [0.0] * d, None), (506, [1.0, 2.0], 1), (None, [0.25] * d, 2), (3, [3.0] * d, 2), (3, rows[3][1], 2), (507, [3e38] + [-1e20] * (d - 1), 3)]


@pytest.mark.parametrize("d, parts, entries, rounds", [(16, 8, 16, 6), (10, 4, 5, 3), (3, 8, 2, 0)])
def test_against_brute_force(spark, monkeypatch, d, parts, entries, rounds):
    rows = data(d)
    rows = [r for r in rows if not r[1] or len(r[1]) == d or d != 2]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(6)
    train = codes.train
    monkeypatch.setattr(codes, "train", lambda vectors, keep: train(vectors, keep=keep, parts=parts, entries=entries, rounds=rounds))
    got = codes.digests(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, parts, entries, rounds), key=repr)


def test_few_and_no_rows(spark):
    few = [(i, [0.1 * i] * 8, None) for i in range(5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in few], SCHEMA)
    assert sorted(map(tuple, codes.digests(df).collect())) == sorted(brute(few, 8, 16, 6))
    assert codes.digests(df.limit(0)).collect() == [] and codes.digests(df.where("false").withColumn("embedding", df.embedding)).collect() == []


def test_only_what_moved_is_sent(spark, monkeypatch):
    """After the first round a task sends entries that changed, and nothing once no part moves."""
    df = spark.createDataFrame([(*r, "x", 1) for r in data(16)], SCHEMA).repartition(3)
    sent, cut = [], codes.cut

    def counted(rows, name):
        table = cut(rows, name)
        sent.append(table.where("_part is not null").count())
        return table

    monkeypatch.setattr(codes, "cut", counted)
    codes.train(df, rounds=14)
    assert sent[0] > 0 and sent[-1] == 0 and sum(sent[1:]) < sent[0] * len(sent[1:]) / 2


def test_decoded(spark):
    rows, books = codes.train(spark.createDataFrame([(*r, "x", 1) for r in data(16)], SCHEMA), entries=200)
    for r in codes.decode(rows, books).collect():
        if r.vec_id is not None and r.vec_id < 260 and r.vec_id != 3:
            exact = codes.integers(np.array(data(16)[r.vec_id][1], dtype=np.float32))
            assert sum((round(x * 4096) - y) ** 2 for x, y in zip(r.decoded, exact.tolist())) == r.error
