"""Approximate nearest neighbours by a hash-prefix forest (after Bawa, Condie and Ganesan, 2005).

Every vector has one long hash string per tree: the sides of random hyperplanes through the vectors' mean. A tree is the sorted
array of its strings. A query descends each tree to its longest matching prefix, and all trees then ascend together, one bit
at a time, until the ranges of strings that share the query's prefix hold enough candidates. Candidates are compared exactly,
in double precision.

Rows are dealt over shards of bounded size by a hash of their id, each with a forest of its own, and queries over blocks of
bounded size; a task holds one shard and one block. What a shard finds is independent of how many shards there are, so recall
doesn't fall as the table grows. Rows with the same vector are one string with a list of ids. No vector is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 64, 32
#: Distinct candidates to gather, as a share of a shard's distinct vectors, and at least: small shards are searched almost whole.
SHARE, LEAST = 0.62, 450
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
SEED = 20240607


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.vectors, self.bits = vectors, bits
        self.mean = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        self.planes = np.random.default_rng(SEED).standard_normal((trees, vectors.shape[1], bits))
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x vectors: hash strings as numbers, the first bit highest."""
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        with np.errstate(all="ignore"):
            return np.array([((vectors - self.mean) @ p > 0).astype(np.uint64) @ weights for p in self.planes])

    def candidates(self, queries: np.ndarray, enough: float) -> list[np.ndarray]:
        """For each query the rows whose strings share its prefix, at the longest prefix that gives enough distinct ones."""
        n, q = len(self.vectors), len(queries)
        asked = self.strings(queries)
        out: list[np.ndarray] = [np.arange(n)] * q
        rising = np.arange(q)
        for length in range(self.bits, 0, -1):
            rest = np.uint64(self.bits - length)
            first = (asked[:, rising] >> rest) << rest
            last = first | ((np.uint64(1) << rest) - np.uint64(1))
            lo = np.array([np.searchsorted(s, f, side="left") for s, f in zip(self.sorted, first)])
            hi = np.array([np.searchsorted(s, f, side="right") for s, f in zip(self.sorted, last)])
            done = np.zeros(len(rising), dtype=bool)
            # a row is met in several trees: there are never more distinct ones than that
            for k in np.flatnonzero((hi - lo).sum(axis=0) >= enough).tolist():
                seen = np.zeros(n, dtype=bool)
                for order, a, b in zip(self.order, lo[:, k].tolist(), hi[:, k].tolist()):
                    seen[order[a:b]] = True
                found = np.flatnonzero(seen)
                if len(found) >= enough:
                    out[rising[k]], done[k] = found, True
            rising = rising[~done]
            if not len(rising):
                break
        return out


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of each query's k nearest found among the rows, its own row left out; ties to smaller ids."""
    distinct, kind = np.unique(vectors, axis=0, return_inverse=True)
    # each id once under each of its vectors
    kind, ids = np.unique(np.column_stack([kind.ravel(), ids]), axis=0).T if len(ids) else (kind, ids)
    starts = np.searchsorted(kind, np.arange(len(distinct) + 1))
    forest = Forest(distinct)
    found_q, found_id, found_d = [], [], []
    for qid, q, rows in zip(query_ids, queries, forest.candidates(queries, min(len(distinct), max(LEAST, share * len(distinct))))):
        d = np.sqrt(((distinct[rows] - q) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        # nearest vectors first, with all that tie, until k other ids are met; of one vector's ids the k + 1 smallest are enough
        got, got_d, met, upto = [], [], set(), 0
        while upto < len(order) and len(met) < k:
            at = order[upto]
            while upto < len(order) and d[order[upto]] == d[at]:
                r = rows[order[upto]]
                own = ids[starts[r] : min(starts[r + 1], starts[r] + k + 1 + len(met))].tolist()
                got += own
                got_d += [d[at]] * len(own)
                upto += 1
            met = set(got) - {qid}
        got, got_d = np.array(got, dtype=np.int64), np.array(got_d)
        best = np.lexsort((got, got_d))
        # an id's nearest vector is what counts
        best = best[np.sort(np.unique(got[best], return_index=True)[1])]
        best = best[got[best] != qid][:k]
        found_q.append(np.full(len(best), qid))
        found_id.append(got[best])
        found_d.append(got_d[best])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(found_q), np.concatenate(found_id), np.concatenate(found_d)


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, share: float = SHARE) -> DataFrame:
    """vectors -> (query_id, rank, <id>, score): each query row's k nearest other rows found, by Euclidean distance.

    is_query: a boolean column over vectors. Vectors that are null, empty, all zero, or hold null or non-finite numbers take no
    part, as queries or as candidates, nor do rows without an id; vectors of different length are never compared. Fewer than
    k candidates: all of them. Rows that repeat an id are one candidate, at the distance of their nearest vectors.
    """
    v = F.col("_v")
    fine = F.size(v) > 0
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")).where(F.col("_id").isNotNull() & v.isNotNull()).where(fine)
    rows = rows.withColumn("_dim", F.size(v))
    n, q = rows.agg(F.count("*"), F.count_if("_q")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-q // BLOCK_QUERIES))
    spread = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    held = rows.select("_dim", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("_shard"), F.explode(spread(blocks)).alias("_block"), "_id", "_v")
    asked = rows.where("_q").select("_dim", F.explode(spread(shards)).alias("_shard"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block"), "_id", "_v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            got = nearest(np.asarray(left.column("_id")), _matrix(left.column("_v")), np.asarray(right.column("_id")), _matrix(right.column("_v")), k, share)
        return pa.table({"query_id": got[0], "_id": got[1], "score": got[2]})

    key = ["_dim", "_shard", "_block"]
    near = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id long, _id long, score double").groupBy("query_id", "_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "score")
