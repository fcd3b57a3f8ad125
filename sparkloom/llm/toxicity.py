"""Toxicity by maximum-scoring segments.

Tokens are scored by their log-odds between toxic and other documents under an informative Dirichlet prior (the corpus's own
token frequencies), less one standard deviation; tokens whose odds aren't clearly over `OFFSET` cost `DRIFT`. What is counted
is a token's distinct left neighbours, by label: a document copied a thousand times, or a passage that many share, is evidence
once. A linear scan finds every maximal
scoring segment of a document (Ruzzo and Tompa, 1999). What a clean document of n tokens reaches by chance follows an
extreme-value law: from clean training documents its scale and location are fitted, and a segment's score becomes
-log10 of its expected number in a clean document of that length. Segments expected less than `EXPECT` times are significant.
A logistic model over a document's best segment and the sum of its significant ones gives the score.

The classifier is fitted on `max_labelled` labelled documents at most, chosen by a hash of the id: a documented bound, and with it
the token table is bounded too. Every document is scored, and whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import cut, distinct, give_back

#: Bound of the fit: labelled documents.
MAX_LABELLED = 20_000
#: Weight of the prior against the counts, log-odds that a token must exceed, cost of other tokens, standard deviations of
#: evidence that a token needs.
PRIOR, OFFSET, DRIFT, EVIDENCE = 0.03, 1.5, 0.3, 1.5
EXPECT = 0.05
#: Pairs of words that a task of the fit gathers before it sends them.
TOGETHER = 1 << 21

#: Lower case for A-Z, a space for every other ASCII character that is no letter or digit.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), left to right, in time linear in the scores."""
    total = np.cumsum(scores)
    own: list[list] = []  # start, end, sum before, sum with
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, float(total[i] - scores[i]), float(total[i])]
        while True:
            j = len(own) - 1
            while j >= 0 and own[j][2] >= new[2]:
                j = own[j][4] if len(own[j]) > 4 else j - 1
            if j < 0 or own[j][3] >= new[3]:
                # remember the last segment that begins lower, so that the search doesn't visit those between again
                own.append([*new[:4], j])
                break
            new = [own[j][0], new[1], own[j][2], new[3]]
            del own[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in own]


@dataclass
class Model:
    scores: dict[bytes, float]
    scale: float = 1.0
    place: float = 0.0
    weights: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        words = tokens(text)
        s = np.fromiter(map(self.scores.get, words, repeat(-DRIFT)), dtype=np.float64, count=len(words))
        return maximal_segments(s), len(words)

    def surprise(self, score: float, n: int) -> float:
        """-log10 of the number of segments this good that a clean document of n tokens is expected to hold."""
        return ((score - self.place) / self.scale - np.log(max(n, 1))) / np.log(10)

    def features(self, text: str | None) -> tuple[float, float, int, list[tuple[int, int, float]]]:
        found, n = self.segments(text)
        rated = [(a, b, self.surprise(x, n)) for a, b, x in found]
        significant = [r for r in rated if r[2] >= -np.log10(EXPECT)]
        best = max((r[2] for r in rated), default=-10.0)
        return max(best, -10.0), sum(r[2] for r in significant), len(significant), significant

    def score(self, best: float, whole: float) -> float:
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(whole), -30, 30))))


def token_scores(words: list[bytes], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """Log-odds, less a deviation, of the tokens that are clearly likelier in toxic documents; others aren't in the result.

    toxic, clean: distinct contexts of each token by label; n_toxic, n_clean: their sums over all tokens.
    """
    prior = PRIOR * (toxic + clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / n_toxic) - np.log(b / n_clean)
    deviation = np.sqrt(1 / a + 1 / b)
    order = np.flatnonzero((odds >= EVIDENCE * deviation) & (odds - deviation > OFFSET))
    return {words[i]: float(odds[i] - deviation[i]) for i in order.tolist()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the two classes weigh as they are."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.05
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents for which learn (a column over labels) is true; null labels are left out.

    A document with labels of both kinds is toxic; rows that repeat an id and a text are one document. With no toxic or no clean
    example, a model that scores every text the same, near the share of toxic ones.
    """
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.bool_or(F.col(label_col) > 0).alias("_toxic"))
    chosen = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled), "toxic-labels")
    mine = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    texts = cut(mine.groupBy("_id", "_toxic", "_text").agg(F.count("*").alias("_n")).select("_toxic", "_text"), "toxic-sample")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct (word, word before, label): words by number, a pair in 64 bits, so that a task holds few bytes for each."""
        number: dict[bytes, int] = {b"": 0}
        held, size = [np.zeros(0, dtype=np.int64)], 0

        def out() -> Iterator[pa.RecordBatch]:
            words = pa.array(number, type=pa.binary())
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), dtype=np.uint64, count=len(number)).view(np.int64)
            every = distinct(np.concatenate(held))
            for k in range(0, len(every), 1 << 16):
                part = every[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(part >> 32)), pa.array(hashes[part >> 1 & 0x7FFFFFFF]), pa.array(part & 1 == 1)], names=["w", "before", "toxic"])

        for b in batches:
            for flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = tokens(text)
                for w in set(own).difference(number):
                    number[w] = len(number)
                at = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
                code = at << 32 | int(flag)
                code[1:] |= at[:-1] << 1
                held.append(code)
                size += len(code)
                if size > TOGETHER // 2:
                    held, size = [distinct(np.concatenate(held))], 0
                    if len(held[0]) > TOGETHER or len(number) > TOGETHER:
                        yield from out()
                        held, number = [np.zeros(0, dtype=np.int64)], {b"": 0}
        yield from out()
        held.clear()
        number.clear()
        give_back()

    once = texts.mapInArrow(pairs, "w binary, before long, toxic boolean").distinct()
    counted = cut(once.groupBy("w").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")), "toxic-tokens")
    n_toxic, n_clean = (int(x or 0) for x in counted.agg(F.sum("t"), F.sum("c")).first())
    if not n_toxic or not n_clean:
        toxic_ones, all_ones = chosen.agg(F.count_if("_toxic"), F.count("*")).first()
        share = min(0.99, max(0.01, toxic_ones / max(1, all_ones)))
        return Model({}, weights=(float(np.log(share / (1 - share))), 0.0, 0.0))
    # only tokens over the offset can be kept: few, whatever the sample's vocabulary is
    odds = F.log((F.col("t") + PRIOR * (F.col("t") + F.col("c"))) / n_toxic) - F.log((F.col("c") + PRIOR * (F.col("t") + F.col("c"))) / n_clean)
    table = counted.where((F.col("t") > 1) & (odds > OFFSET)).orderBy("w").toArrow()
    words, t, c = table.column("w").to_pylist(), np.asarray(table.column("t")).astype(float), np.asarray(table.column("c")).astype(float)
    model = Model(token_scores(words, t, c, n_toxic, n_clean))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, n = model.segments(text)
                out.append((flag, n, sorted((x for _, _, x in found), reverse=True)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], type=pa.bool_()), pa.array([o[1] for o in out], type=pa.int64()), pa.array([o[2] for o in out], type=pa.list_(pa.float64()))], names=["toxic", "n", "rates"])

    rated = texts.mapInArrow(rate, "toxic boolean, n long, rates array<double>").toArrow()  # rows of the bounded sample
    toxic, n, rates = np.asarray(rated.column("toxic")).astype(bool), np.asarray(rated.column("n")).astype(float), rated.column("rates").to_pylist()
    best = np.array([r[0] if r else 0.0 for r in rates])
    # Gumbel law of clean documents' best segments, by moments; the length enters as log n
    clean = best[~toxic & (n > 0)]
    logs = np.log(np.maximum(n[~toxic & (n > 0)], 1))
    scale = max(0.25, float(np.std(clean)) * np.sqrt(6) / np.pi) if len(clean) else 1.0
    place = float(np.mean(clean - scale * logs) - 0.5772 * scale) if len(clean) else 0.0
    model.scale, model.place = scale, place
    x = []
    for size, own in zip(n, rates):
        s = [model.surprise(v, int(size)) for v in own]
        x.append((max(max(s, default=-10.0), -10.0), np.log1p(sum(v for v in s if v >= -np.log10(EXPECT)))))
    model.weights = _logistic(np.array(x), toxic.astype(float))
    return model


SEGMENT = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("surprise", DoubleType())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs -> (id, *keep, score, passages): each input row's score from 0 to 1 and its significant passages.

    passages: token positions [start, end) and surprise. Null, empty or wordless texts get the score of a text without any
    segment. Repeated rows stay repeated. `keep` names columns to pass through; others are not read.
    """
    schema = StructType([docs.schema[id_col], *[docs.schema[c] for c in keep], StructField("score", DoubleType()), StructField("passages", ArrayType(SEGMENT))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        m = shared.value
        for b in batches:
            scores, passages = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                best, whole, _, found = m.features(text)
                scores.append(m.score(best, whole))
                passages.append([{"start": a, "end": e, "surprise": v} for a, e, v in found])
            give_back()
            cols = [*b.columns[:-1], pa.array(scores, type=pa.float64()), pa.array(passages, type=arrow.field("passages").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
