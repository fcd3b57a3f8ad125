"""Language-model scores by prediction by partial matching over bytes, with a unigram base beside it.

A document's bytes are its lower-cased words, one space between two of them, and an end symbol. The model is a byte trie of
contexts of up to `order` bytes, which reach back over words (spaces stand before a document), with escape method D (Howard, 1993)
and symbol exclusion: a symbol is coded in the longest context that was seen, and each escape leaves out the symbols of the
contexts already escaped from. The model is pretrained on the documents that aren't held out.

So a symbol's code length depends on the symbol and the `order` bytes before it. These grams of order + 1 bytes are what is counted and
what is scored once each, however often they occur:

1. One pass counts words and grams over all documents, apart for training documents. A task sorts its positions and sends each
   distinct gram once for some millions of positions.
2. Shorter contexts' counts are sums over the grams. A gram seen in training is coded in its whole context. The others go down the
   trie by joins on (length, context); a context has 256 symbols at most, and nothing of the trie is collected or broadcast.
3. Documents are scored: the commonest words and grams (`head` and `head_grams` at most, fixed numbers) come from a broadcast table, the
   others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back

#: The end of a document as a word and as a symbol. No word holds this byte, nor the space.
END, SPACE = b"\n", b" "
#: Symbols there are: what no context has seen is uniform over the rest of these.
SYMBOLS = 256
#: Bytes of context: with the symbol a gram must fit into 63 bits.
ORDER = 5
HEAD, HEAD_GRAMS = 1 << 18, 1 << 19
#: Bytes that are looked at together, and grams that are sorted together.
STEP, SORTED = 1 << 20, 1 << 22


def _grams(texts: list[list[bytes]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, document of each) of texts given as words, the end not among them; a gram's symbol is its lowest byte."""
    parts = [SPACE * order + SPACE.join(words) + END for words in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    for at in range(0, len(buf), STEP):
        part = buf[max(0, at - order) : at + STEP].astype(np.int64)
        lead = at - max(0, at - order)
        n = len(part) - lead
        gram = np.zeros(n, dtype=np.int64)
        place = np.arange(at, at + n)
        doc = np.searchsorted(ends, place, side="right")
        coded = place - (ends - sizes)[doc] >= order
        for back in range(min(order, lead + n - 1), -1, -1):
            # what would reach before the buffer belongs to no coded symbol
            own = part[max(0, lead - back) : lead - back + n]
            gram[n - len(own) :] |= own << (8 * back)
        yield gram[coded], doc[coded]


def _by_bytes(rows: list, size) -> Iterator[list]:
    """Consecutive rows of about STEP bytes together."""
    now, n = [], 0
    for r in rows:
        now.append(r)
        n += size(r)
        if n >= STEP:
            yield now
            now, n = [], 0
    if now:
        yield now


def _counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    return g[at], np.diff(np.append(at, len(g)))


#: A word's row has the gram -1, a gram's row the word " ".
_COUNTS = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("c", pa.int64())])


def _count(order: int, most: int = 500_000):
    """Rows (learn, text) -> words and grams with their counts in rows whose flag is true, each once for many positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bool, Counter] = {True: Counter(), False: Counter()}
        grams: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def out_words():
            words[True].update(dict.fromkeys(words[False].keys() - words[True].keys(), 0))
            all_words, counts = list(words[True]), list(words[True].values())
            for k in range(0, len(all_words), 1 << 16):
                some = pa.array(all_words[k : k + (1 << 16)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), -1)), pa.array(counts[k : k + (1 << 16)], type=pa.int64())], schema=_COUNTS)
            words[True].clear()
            words[False].clear()

        def out_grams(flag: bool):
            g, c = _counted(grams[flag])
            grams[flag].clear()
            for k in range(0, len(g), 1 << 18):
                some = g[k : k + (1 << 18)]
                blank = pa.array([SPACE], type=pa.binary()).take(pa.array(np.zeros(len(some), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([blank, pa.array(some), pa.array(c[k : k + (1 << 18)] if flag else np.zeros(len(some), dtype=np.int64))], schema=_COUNTS)

        waiting = {True: 0, False: 0}
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()))
            for flag in (True, False):
                for some in _by_bytes([t or b"" for f, t in rows if bool(f) == flag], len):
                    texts = [t.lower().split() for t in some]
                    for own in texts:
                        words[flag].update(own)
                    words[flag][END] += len(texts)
                    for g, _ in _grams(texts, order):
                        grams[flag].append(g)
                        waiting[flag] += len(g)
                        if waiting[flag] >= SORTED:
                            waiting[flag] = 0
                            yield from out_grams(flag)
                    if len(words[True]) + len(words[False]) > most:
                        yield from out_words()
        yield from out_words()
        yield from out_grams(True)
        yield from out_grams(False)
        give_back()

    return run


def count(docs: DataFrame, learn: str, text_col: str, order: int = ORDER) -> DataFrame:
    """docs -> (word, gram, c): each distinct word (and the end) and gram of all documents, with its count where learn is true."""
    rows = docs.select(F.col(learn), F.col(text_col)).mapInArrow(_count(order), "word binary, gram long, c long")
    return rows.groupBy("word", "gram").agg(F.sum("c").alias("c"))


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """grams(gram, c) -> (gram, c, lp): log10 probability of each gram's symbol after its context, under the counts c."""
    low = lambda column, n: F.col(column).bitwiseAND(F.element_at(F.array(*[F.lit((1 << min(63, 8 * k)) - 1).cast("long") for k in range(order + 3)]), n + 1))  # noqa: E731  the lowest n bytes
    whole = F.shiftright("gram", 8)
    total = F.sum("c").over(Window.partitionBy(whole))
    known = grams.where("c > 0").withColumn("total", total).select("gram", "c", F.log10((F.col("c") - 0.5) / F.col("total")).alias("lp"))

    # counts of every context's symbols: a context's length, and its bytes with the symbol's
    lengths = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    spread = grams.where("c > 0").select("gram", "c", lengths).select("k", low("gram", F.col("k") + 1).alias("g"), "c")
    trie = cut(spread.groupBy("k", "g").agg(F.sum("c").alias("n")), "ppm-trie").withColumn("ctx", F.shiftright("g", 8))

    # what training never saw goes down the trie: a row for each length
    opened = grams.where("c = 0").select("gram", lengths).select("gram", "k", low("gram", F.col("k") + 1).alias("g"))
    opened = cut(opened.withColumn("ctx", F.shiftright("g", 8)), "ppm-open")
    asked = opened.select("k", "ctx").distinct()
    mine = trie.join(asked, ["k", "ctx"], "left_semi")
    contexts = cut(mine.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "ppm-contexts")
    # what is left of the next shorter context once the symbols of this one are left out
    shorter = trie.select((F.col("k") + 1).alias("k"), F.col("g").alias("up"), F.col("n").alias("n_up"))
    gone = mine.where("k > 0").withColumn("up", low("g", F.col("k"))).join(shorter, ["k", "up"]).groupBy("k", "ctx").agg(F.sum("n_up").alias("gone"), F.count("*").alias("gone_kinds"))
    gone = cut(gone.select((F.col("k") - 1).alias("k"), F.col("ctx").alias("longer"), "gone", "gone_kinds"), "ppm-gone")

    opened = opened.withColumn("longer", F.shiftright(low("gram", F.col("k") + 2), 8))

    def met(some: Column, side) -> DataFrame:
        rows, symbols = opened.where(some), trie.where(some).select("k", "g", "n")
        return rows.join(side(contexts.where(some)), ["k", "ctx"]).join(side(symbols), ["k", "g"], "left").join(side(gone.where(some)), ["k", "longer"], "left")

    # every gram asks the one empty context, and one of 256: their tables have 2**16 rows at most and are broadcast
    at = met(F.col("k") < 2, F.broadcast).unionByName(met(F.col("k") >= 2, lambda table: table))
    total, kinds = F.col("total") - F.coalesce("gone", F.lit(0)), F.col("kinds") - F.coalesce("gone_kinds", F.lit(0))
    # a context with nothing left after exclusion is escaped from at no cost
    step = F.struct("k", F.log10(F.try_divide(F.col("n") - 0.5, total)).alias("hit"), F.when(kinds > 0, F.log10(F.try_divide(kinds, 2 * total))).otherwise(0.0).alias("escape"), "kinds")
    steps = at.groupBy("gram").agg(F.collect_list(step).alias("steps"))  # order + 1 at most
    hit = F.filter("steps", lambda s: s["hit"].isNotNull())
    level = F.coalesce(F.array_max(F.transform(hit, lambda s: s["k"])), F.lit(-1))
    unseen = lambda s: -F.log10(F.greatest(F.lit(1.0), SYMBOLS - s["kinds"]))
    cost = lambda s: F.when(s["k"] > level, s["escape"] + F.when((level < 0) & (s["k"] == 0), unseen(s)).otherwise(0.0)).when(s["k"] == level, s["hit"]).otherwise(0.0)
    fresh = steps.select("gram", F.lit(0).cast("long").alias("c"), F.aggregate(F.transform("steps", cost), F.lit(0.0), lambda a, b: a + b).alias("lp"))
    # without any training there is no context at all
    alone = opened.select("gram").distinct().join(steps.select("gram"), "gram", "left_anti").select("gram", F.lit(0).cast("long").alias("c"), F.lit(-float(np.log10(SYMBOLS))).alias("lp"))
    return known.unionByName(fresh).unionByName(alone)


def _top(scored: DataFrame, most: int) -> DataFrame:
    """Rows whose count reaches a bound that `most` rows at most reach. The counts' histogram has some hundred steps, so no row is sorted."""
    step = F.floor(8 * F.log2(F.col("c"))).cast("int")
    sizes = scored.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, room = None, most
    for r in sorted(sizes, key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    return scored.where((F.col("c") > 0) & (step >= least) if least is not None else F.lit(False))


def _score_docs(words_table, grams_table, total: int, vocabulary: int, order: int):
    """Rows (row, own, word, gram, tf): a document's sums over the tables' words and grams on one row, its other words and grams each on one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = words_table.value
        norm = np.log10(total + vocabulary + 1)
        place = dict(zip(words, range(len(words))))
        base = np.log10(counts + 1.0) - norm
        keys, lps = grams_table.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            everything = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()))
            for some in _by_bytes(everything, lambda r: len(r[2] or b"")):
                texts = [(t or b"").lower().split() for _, _, t in some]
                lp = np.zeros(len(texts))
                rest_doc, rest_gram = [], []
                for g, doc in _grams(texts, order):
                    at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
                    seen = keys[at] == g if len(keys) else np.zeros(len(g), dtype=bool)
                    lp += np.bincount(doc[seen], weights=lps[at[seen]], minlength=len(texts)) if seen.any() else 0.0
                    rest_doc.append(doc[~seen])
                    rest_gram.append(g[~seen])
                owner, gram, tf_gram = _per_document(np.concatenate(rest_doc), np.concatenate(rest_gram))
                own, word, tf, of = [], [], [], []
                for k, ((i, h, _), tokens) in enumerate(zip(some, texts)):
                    tokens.append(END)
                    at = np.fromiter((place.get(t, -1) for t in tokens), dtype=np.int64, count=len(tokens))
                    seen = at[at >= 0]
                    rest = Counter([tokens[j] for j in np.flatnonzero(at < 0)])
                    own.append({"id": i, "held": h, "n": len(tokens), "known": len(seen), "base": float(base[seen].sum()), "lp": float(lp[k])})
                    word += rest.keys()
                    tf += rest.values()
                    of += [k] * len(rest)
                n, m, r = len(own), len(word), len(gram)
                rows = np.concatenate([np.arange(n), np.array(of, dtype=np.int64), owner]) + row
                blank = pa.array([SPACE], type=pa.binary()).take(pa.array(np.zeros(r, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), pa.array(own + [None] * (m + r), type=_OWN), pa.concat_arrays([pa.array([SPACE] * n + word, type=pa.binary()), blank]),
                    # a document's own row has a number of its own, which joins nothing
                    pa.array(np.concatenate([-2 - np.arange(row, row + n), np.full(m, -1), gram])), pa.array(np.concatenate([np.zeros(n, dtype=np.int64), np.array(tf, dtype=np.int64), tf_gram])),
                ], names=["row", "own", "word", "gram", "tf"])
                row += n
        give_back()

    return run


def _per_document(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, gram) with their numbers."""
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[at], gram[at], np.diff(np.append(at, len(doc)))


_OWN = pa.struct([("id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, head: int = HEAD, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """docs -> (id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per input row.

    held_out: a boolean column over docs; the model and the base learn from the rows where it is false (null counts as false).
    Null or empty text: only the end is scored. Without any training row every count is zero and the model is uniform over
    bytes. Repeated rows are scored, and learnt from, once each. Scores are log10 probabilities. Other columns are not read.
    """
    if not 0 < order < 7:
        raise ValueError("order must be 1 to 6")
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    counted = cut(count(rows.withColumn("learn", ~F.col("held")), "learn", "text", order), "ppm-counts")
    words, grams = counted.where("gram = -1").select("word", "c"), counted.where("gram <> -1").select("gram", "c")
    total, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    scored = cut(gram_scores(grams, order), "ppm-scores")

    top = _top(words, head).toArrow()
    words_table = spark.sparkContext.broadcast((top.column("word").to_pylist(), np.asarray(top.column("c")).astype(np.float64)))
    top = _top(scored, head_grams).orderBy("gram").select("gram", "lp").toArrow()
    grams_table = spark.sparkContext.broadcast((np.asarray(top.column("gram")).astype(np.int64), np.asarray(top.column("lp")).astype(np.float64)))

    schema = "row long, own struct<id: long, held: boolean, n: long, known: long, base: double, lp: double>, word binary, gram long, tf long"
    seen = rows.mapInArrow(_score_docs(words_table, grams_table, total, vocabulary, order), schema)
    norm = float(np.log10(total + vocabulary + 1))
    base = words.select("word", F.lit(-1).cast("long").alias("gram"), (F.log10(F.col("c") + F.lit(1.0)) - F.lit(norm)).alias("base"), F.lit(0.0).alias("lp"), (F.col("c") > 0).cast("long").alias("known"))
    model = scored.select(F.lit(SPACE).alias("word"), "gram", F.lit(0.0).alias("base"), "lp", F.lit(0).cast("long").alias("known"))
    joined = seen.join(base.unionByName(model), ["word", "gram"], "left")
    tf = F.col("tf")
    sums = joined.groupBy("row").agg(
        F.max("own").alias("own"),
        F.sum(tf * F.coalesce("known", F.lit(0))).alias("known"),
        F.sum(tf * F.coalesce("base", F.lit(0.0))).alias("base"),
        F.sum(tf * F.coalesce("lp", F.lit(0.0))).alias("lp"),
    )
    own = F.col("own")
    return sums.select(
        own["id"].alias(id_col), own["held"].alias("held_out"), own["n"].alias("n_tokens"), (own["known"] + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (own["base"] + F.col("base")).alias("base_score"), (own["lp"] + F.col("lp")).alias("score"),
    )
