import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(FILE)


def test_same_ids_as_whole_texts(plain):
    c = packing.Coder(FILE)
    texts = [f"a{chr(u)}b  {chr(u)} 1{chr(u)}2 .{chr(u)}." for r in (range(0, 0xD800, 7), range(0xE000, 0x20000, 61)) for u in r]
    texts += [f"x{a}{b}{d}y" for a in " \n\t\x1c\x85\xa0　" for b in " \n\r\x0b " for d in (" ", "  ", "\n", "")]
    texts += ["", " ", "  ", " a", "a ", "x" * 3000, " " * 3000, "é" * 900, "<|endoftext|> ab", "ab <|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>  c", "<|endof text|>", "it's we'll\r\n\r\n  x"]
    rng = random.Random(3)
    texts += ["".join(rng.choices(["ab", " ", "\n", "12", "!", "<|endoftext|>", "é", "'s", "\t"], k=rng.randrange(40))) for _ in range(2000)]
    texts += ["\na", "a\n", "a\nb c.\nd", "a\n<|endoftext|>\nb", "it's they'll. don't, 's s's", *(f"{chr(u)}{chr(u + 1)} {chr(u)}q. x\n{chr(u)}" for u in range(0x20, 0x700))]
    got = [np.frombuffer(c.encode(t), dtype="<u2").tolist() for t in texts]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # a full memory is emptied, which changes nothing
    c.spaced.REMEMBERED = c.first.REMEMBERED = c.stretch.REMEMBERED = 10
    assert [np.frombuffer(c.encode(t), dtype="<u2").tolist() for t in texts[-2500:]] == got[-2500:]


def test_pieces(spark, plain):
    texts = [f"apple banana pear {i} " * (i % 40) if i % 2 else f"engine wheel motor {i} " * (i % 60) for i in range(300)]
    rows = [*enumerate(texts), (300, None), (301, ""), (302, "long words " * 8000), (302, "again"), (302, "again"), (None, "no id"), (303, "an <|endoftext|> inside")]
    docs = spark.createDataFrame([(i, t, 3, "z", 1, 2) for i, t in rows], "doc_id long, text string, n int, head string, row int, shard int")
    want = sorted(((i, plain.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows), key=repr)
    for size in (packing.SHARD_TOKENS, 6000):
        pieces = packing.pack(docs, FILE, shard_tokens=size).collect()
        by_doc, by_seq = {}, {}
        for p in pieces:
            by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
            by_seq.setdefault(p.sequence_id, []).append(p)
        for (i, n), own in by_doc.items():
            ids = [x for j, x in want if j == i and len(x) == n]
            assert sum(p.length for p in own) == n * len(ids)
            for p in own:
                assert any(np.array(x[p.start : p.start + p.length], "<u4").tobytes() == bytes(p.ids) for x in ids)
        assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)
        lengths = []
        for own in by_seq.values():
            own.sort(key=lambda p: p.offset)
            at = 0
            for p in own:
                assert p.offset == at
                at += p.length
            lengths.append(at)
        assert max(lengths) <= 2048
        shards = {s >> 32 for s in by_seq}
        assert sum(x < 2048 for x in lengths) <= len(shards)
    assert {(r.doc_id, r.ids_crc32) for r in packing.digests(packing.pack(docs.where("doc_id = 303"), FILE)).collect()} == {(303, zlib.crc32(np.array(dict(want)[303], "<u4").tobytes()))}
    assert packing.pack(docs.limit(0), FILE).collect() == []


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(7, "same words in every row " * 20)] * 200, "doc_id long, text string")
    pieces = packing.pack(docs, FILE, shard_tokens=3000).collect()
    assert len({p.sequence_id >> 32 for p in pieces}) > 3


def corpus(rng, n):
    topics = [[f"{a}{b}" for b in "abcdefghij"] for a in ("red", "iron", "tree", "sea")]
    docs = []
    for _ in range(n):
        words = rng.choices(rng.choice(topics), k=rng.randrange(0, 30)) + rng.choices(["the", "of", "and"], k=rng.randrange(0, 10))
        docs.append(words)
    return docs


def by_hand(docs, window, df, n_docs, mean):
    """Windows filled one document at a time, every candidate's BM25 worked out anew."""
    idf = lambda t: np.log(1 + (n_docs - df[t] + 0.5) / (df[t] + 0.5))
    counts = [{t: own[:-1].tolist().count(t) for t in set(own[:-1].tolist())} for own in docs]

    def bm25(seed, d):
        total = 0.0
        for t in sorted(counts[seed]):
            if t in counts[d]:
                c = counts[d][t]
                total += idf(t) * (c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)))
        return total

    unused, pieces, number, offset, seed = set(range(len(docs))), [], 0, 0, None
    while unused:
        if offset == window:
            number, offset, seed = number + 1, 0, None
        scored = [(-bm25(seed, d), d) for d in unused] if seed is not None else []
        best = min([x for x in scored if x[0] < 0], default=None)
        doc = best[1] if best else min(unused)
        if not best:
            seed = doc
        unused.remove(doc)
        start = 0
        while start < len(docs[doc]):
            if offset == window:
                number, offset, seed = number + 1, 0, doc
            take = min(window - offset, len(docs[doc]) - start)
            pieces.append((doc, start, take, number, offset))
            start, offset = start + take, offset + take
    return pieces


def test_fill_against_brute_force(monkeypatch):
    rng = random.Random(5)
    c = packing.Coder(FILE)
    for n, window, fetch in ((120, 100, 16), (120, 1000, 3), (60, 37, 1), (1, 50, 16)):
        monkeypatch.setattr(packing, "FETCH", fetch)
        docs = [np.frombuffer(x + b"\x01\x00", dtype="<u2") for x in (c.encode(" ".join(w)) for w in corpus(rng, n))]
        df = np.zeros(1 << 16)
        for d in docs:
            df[packing._terms(d)[0]] += 1
        mean = sum(map(len, docs)) / n
        index = packing.Index(docs, np.log(1 + (n - df + 0.5) / (df + 0.5)), mean)
        assert packing.fill([len(d) for d in docs], index, window) == by_hand(docs, window, df, n, mean)


def test_a_window_takes_every_neighbour_first():
    # two topics of short documents: a window holds far more than is put in order at a time
    c = packing.Coder(FILE)
    docs = [np.frombuffer(x + b"\x01\x00", dtype="<u2") for x in map(c.encode, ["alpha beta gamma " * 10, "one two three " * 10] * 40)]
    df = np.zeros(1 << 16)
    for d in docs:
        df[packing._terms(d)[0]] += 1
    index = packing.Index(docs, np.log(1 + (80 - df + 0.5) / (df + 0.5)), sum(map(len, docs)) / 80)
    order = [d for d, *_ in packing.fill([len(d) for d in docs], index, 1 << 20)]
    assert [d % 2 for d in order] == [0] * 40 + [1] * 40


def test_texts_together(plain, monkeypatch):
    """Texts looked at together get the ids of whole texts; each distinct word of a task is worked out once, marks after it or not."""
    c = packing.Coder(FILE)
    rng = random.Random(9)
    texts = [None, "", " ", "\n", "a", " a", "a ", "\na", "a\n", "a\nb c.\nd", "a\u00a0b c\u3000d", "a\u2003\u2003b", "x###", "don't 's", "a<|endoftext|>b <|endoftext|> c", "née.. été&&& a|<>", "a'.b a.'s b!?'re"]
    texts += ["".join(rng.choices(["ab", "Ça", " ", " ", "\n", "12", "!", "<|endoftext|>", "é", "'s", "\t", "$$$", "."], k=rng.randrange(40))) for _ in range(3000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 300, 4 << 20):
        monkeypatch.setattr(packing.Coder, "TOGETHER", size)
        assert [np.frombuffer(x, dtype="<u2").tolist() for x in c.encode_all(packing.pa.array(texts, type=packing.pa.string()))] == want
    monkeypatch.setattr(packing.Coder, "KEPT", 5)
    c.forget()
    assert len(c.spaced) == len(c.first) == 5
    asked, real = [], packing.Coder._word
    monkeypatch.setattr(packing.Coder, "_word", lambda self, lead, word, table: asked.append(lead + word) or real(self, lead, word, table))
    fresh = packing.Coder(FILE)
    fresh.encode_all(packing.pa.array(["stone water stone### water. stone water"] * 50))
    assert sorted(asked) == [" stone", " stone###", " water.", "stone"]
    fresh.forget()
    fresh.encode_all(packing.pa.array(["stone water stone### water."]))
    assert len(asked) == 4


def test_scores_are_the_same_from_a_table_and_from_lists(monkeypatch):
    rng = random.Random(6)
    c = packing.Coder(FILE)
    docs = [np.frombuffer(x + b"\x01\x00", dtype="<u2") for x in (c.encode(" ".join(w)) for w in corpus(rng, 90))] + [np.array([1], dtype="<u2")]
    idf = np.random.default_rng(1).random(1 << 16)
    table = packing.Index(docs, idf, 20.0)
    monkeypatch.setattr(packing, "TABLE", 0)
    lists = packing.Index(docs, idf, 20.0)
    assert table.table is not None and lists.table is None
    assert all((table.scores(k) == lists.scores(k)).all() for k in range(len(docs)))
