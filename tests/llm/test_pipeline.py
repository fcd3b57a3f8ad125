import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import toxicity

from .test_jaccard import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng, words = random.Random(12), [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(15, 80))) for _ in range(150)]
    passage = " ".join(rng.choices(words, k=55))
    rows = []
    for i, t in enumerate(texts):
        if i % 10 == 3:
            t = f"{t} {passage}\nmore {t[::-1]}"
        if i % 9 == 0:
            for _ in range(5):
                t = t.replace(" ", rng.choice([" vile! ", " scum, ", " filth "]), 1) + " scum filth vile"
        if i % 25 == 7:
            t += ' token = "0123456789abcdef0123456789abcdef"'
        rows.append([i, t, "en", "s", len(t)])
    rows += [[200 + k, texts[k], "en", "s2", None] for k in (1, 2, 3, 1)]
    rows += [[300, None, None, None, None], [301, "", "en", "s", 0], [None, texts[5], "en", "s", 1], [302, "long " * 9000, "en", "s", 45000], [5, texts[5], "en", "s", len(texts[5])]]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    fns = dict(corpus_pipeline.STAGES)

    kept = fns["toxicity"](spark, docs, sf)
    assert kept.columns == COLUMNS
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), corpus_pipeline.crc_bucket("doc_id", 5) != 0)
    want = sorted((r for r in rows if model.score(*model.features(r[1])[:2]) < 0.5), key=repr)
    got = sorted(map(list, kept.collect()), key=repr)
    assert got == want and {r[0] for r in rows} - {r[0] for r in got} == {i for i in range(150) if i % 9 == 0}

    unique = fns["near_dedup"](spark, kept, sf)
    ids = sorted(r[0] for r in unique.collect())
    assert unique.columns == COLUMNS and ids == sorted(brute([(r[0], r[1]) for r in want if r[0] is not None]))

    left = fns["substring_dedup"](spark, unique, sf)
    before = {r[0]: r for r in unique.collect()}
    assert left.columns == COLUMNS
    for r in left.collect():
        assert r.n_chars == (before[r[0]].n_chars if r.text == before[r[0]].text else len(r.text))
    texts = {r[0]: r.text for r in left.collect()}
    shared = sorted(i for i in before if i % 10 == 3 and i < 150)
    gone = [i for i in shared if len((texts[i] or "").split()) <= len(before[i].text.split()) - 55]
    assert gone == shared[1:] and all(texts[i] == before[i].text for i in texts if i not in shared)
    assert all(texts[i].count("\n") == 1 for i in shared)  # lines stay lines

    clean = fns["secrets"](spark, left, sf)
    assert clean.columns == COLUMNS
    for r in clean.collect():
        assert "0123456789abcdef0123" not in (r.text or "") and (r.text == (texts[r[0]] or "") or "[SECRET]" in r.text)

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coded = {r[0]: [*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in clean.collect()}
    for table in (fns["packing"](spark, clean, sf), corpus_pipeline.run(spark, sf)):
        pieces = table.collect()
        assert sum(p.length for p in pieces) == sum(map(len, coded.values()))
        for p in pieces:
            assert np.array(coded[p.doc_id][p.start : p.start + p.length], "<u4").tobytes() == bytes(p.ids)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


#: Names that the operators use for columns of their own.
INNER = [
    "score", "passages", "_text", "_rank", "n_words", "n_removed", "kept_text", "_batch", "_id", "_bucket", "spans", "redacted_text", "own", "_node", "_row", "h", "n", "key",
    "component", "ids", "row", "head", "shard", "start", "length", "piece", "offset", "sequence_id", "doc_tokens", "a.dotted name",
]


def test_columns_named_like_inner_ones(spark, tmp_path):
    rows = [[*r, *[f"{c} {k}" for c in INNER]] for k, r in enumerate(corpus()[:60])]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in INNER]])
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == [*COLUMNS, *INNER]
    kept = docs.collect()
    by_id = {r[0]: r for r in rows}
    assert kept and all(list(r)[5:] == by_id[r[0]][5:] for r in kept)
    assert sum(p.length for p in corpus_pipeline.pack_windows(spark, docs, "").collect()) > len(kept)


def test_near_dedup_meets_by_pigeonring(spark, monkeypatch):
    """The stage's first pairs come from op1's filter, are verified, and those beyond two bits are found as well."""
    from sparkloom.llm import simhash

    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:270], *"abcdefghij"]), " ".join(words[::-1]), " ".join(words), ""]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts, 1)], "doc_id long, text string")
    found, real = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 6]
    assert len(found) == 1
    pairs = simhash.near_pairs(docs, shingle=5)
    near = {(u, v) for u in range(1, 7) for v in range(u + 1, 7) if bin(simhash.simhash(texts[u - 1], 5) ^ simhash.simhash(texts[v - 1], 5)).count("1") <= 2}
    assert {tuple(r) for r in pairs.collect()} <= near and (1, 5) in near
