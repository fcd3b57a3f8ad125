import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from sparkloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "a", "b", "the", "ing", "▁", "é", "日", "😀", "\t", "\r", "\x00", "0", "12", "<s>", "x" * 9, "　", "ii", "aaa", "-", " -", "==", "​", "."]


def test_same_ids_as_the_library():
    c, sp, rng = pieces.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(2)
    texts = ["", " ", "\n", "a" * 5000, "ab " * 3000] + ["".join(rng.choices(PARTS, k=rng.randrange(16))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True), t


def test_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    c, sp = pieces.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = "some words of a text that repeats some words of a text"
    assert np.frombuffer(c.encode(t), "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)
    assert len(c.word) <= 3


def test_operators(spark):
    rows = [(1, "Hello  world\n▁x", "z"), (1, "Hello  world\n▁x", "z"), (2, None, None), (None, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.digests(docs, MODEL).collect()), key=repr) == sorted(want, key=repr)
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert sorted((r[0] or 0, r[1]) for r in back) == [(0, ""), (1, "Hello  world\n x"), (1, "Hello  world\n x"), (2, "")]
    assert pieces.digests(docs.limit(0), MODEL).collect() == []
