"""Resampling documents towards a target distribution by importance weights over hashed word runs (after Xie et al., 2023).

A feature is a run of 1 to `n` consecutive words; its bucket is the CRC-32 of its bytes modulo `buckets`. Each task keeps a trie over
words for the texts it reads: a node is one feature and holds how often it came and the CRC's state after its bytes, so that a
longer run's CRC goes on from its prefix and no feature is ever joined to a string. The tasks' bucket totals are merged (`buckets`
numbers a task at most), the gains computed from them, and a second pass walks the same tries with a gain at each node.

Weights are exact integers; ranks come from one range-partitioned sort over narrow rows and the sizes of its partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, give_back

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Nodes that a task's trie holds before it is folded into its totals and begun anew.
MAX_NODES = 1 << 18

#: A-Z become small, bytes outside words become spaces: words are runs of 0-9, a-z and of all that isn't ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNT, CRC, BELOW = 0, 1, 2


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()  # no white space but the spaces is left


class Trie:
    """Nodes are [count or gain, CRC state, children by word]."""

    def __init__(self, n: int, buckets: int, gains: list[int] | None = None):
        self.n, self.buckets, self.gains, self.totals = n, buckets, gains, np.zeros(buckets, dtype=np.int64)
        self.root: dict[bytes, list] = {}
        self.size = 0

    def _grow(self, below: dict[bytes, list], word: bytes, state: int, deep: bool) -> list:
        crc = zlib.crc32(word, zlib.crc32(b" ", state) if deep else 0)
        node = below[word] = [0 if self.gains is None else self.gains[crc % self.buckets], crc, {}]
        self.size += 1
        return node

    def _walk(self, found: list[bytes]) -> Iterator[list]:
        """The node of every feature, in turn; what isn't there yet grows."""
        root, n = self.root, self.n
        for at, word in enumerate(found):
            node = root.get(word) or self._grow(root, word, 0, False)
            yield node
            for word in found[at + 1 : at + n] if n > 1 else ():
                node = node[BELOW].get(word) or self._grow(node[BELOW], word, node[CRC], True)
                yield node

    def count(self, found: list[bytes]) -> None:
        for node in self._walk(found):
            node[COUNT] += 1
        if self.size > MAX_NODES:
            self.fold()

    def fold(self) -> None:
        """Add the nodes' counts to the totals and begin anew."""
        level = list(self.root.values())
        while level:
            at = np.fromiter((x[CRC] % self.buckets for x in level), dtype=np.int64, count=len(level))
            np.add.at(self.totals, at, np.fromiter((x[COUNT] for x in level), dtype=np.int64, count=len(level)))
            level = [y for x in level for y in x[BELOW].values()]
        self.root, self.size = {}, 0

    def weigh(self, found: list[bytes]) -> int:
        total = sum(node[COUNT] for node in self._walk(found))
        if self.size > MAX_NODES:
            self.root, self.size = {}, 0
        return total


def n_features(length: int, n: int) -> int:
    return sum(max(0, length - k) for k in range(n))


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bucket_totals(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """docs -> (bucket, total): how many features fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(n, buckets)
        for b in batches:
            for text in _texts(b.column(0)):
                trie.count(words(text))
        trie.fold()
        at = np.flatnonzero(trie.totals)
        give_back()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "total": pa.array(trie.totals[at], pa.int64())})

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's floor(1000 * ln of how much more often the target has it), with one added everywhere: `buckets` numbers, whatever the tables' sizes."""
    at = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = at.join(bucket_totals(docs, text_col, n, buckets).withColumnRenamed("total", "s"), "bucket", "left").join(bucket_totals(target, target_col, n, buckets).withColumnRenamed("total", "t"), "bucket", "left")
    counted = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    own, wanted = sum(r.s for r in counted), sum(r.t for r in counted)
    ordered = sorted(counted)
    s, t = (np.array([r[k] for r in ordered], dtype=np.float64) for k in (1, 2))
    return np.floor(1000 * np.log((t + 1) * (own + buckets) / ((s + 1) * (wanted + buckets)))).astype(np.int64).tolist()


def _ranked(scored: DataFrame) -> tuple[DataFrame, int]:
    """(scored with its place in the order from 1, rows that may be drawn): the sort's partitions number their rows, and their sizes,
    one number each, say where each begins."""
    order = [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("_id"), "_row"]
    placed = cut(scored.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted(placed.groupBy(part).agg(F.count("*").alias("n"), F.count_if("_fit").alias("fit")).collect())
    before, starts = 0, []
    for r in sizes:
        starts.append((r[0], before))
        before += r.n
    begin = placed.sparkSession.createDataFrame(starts, "_part long, _before long")
    out = placed.withColumn("_part", part).join(F.broadcast(begin), "_part")  # a row for each partition of the sort
    return out.withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1), sum(r.fit for r in sizes)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: tuple[str, ...] = (), n: int = 1, buckets: int = BUCKETS,
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED,
) -> DataFrame:
    """docs -> (id, *keep, n_features, weight, score, rank), one row for each row of docs.

    weight: the sum of the gains of the text's features, repeats counted. score: weight plus 1000 times a Gumbel number drawn by the
    id alone (SHA-256 of `seed:id`), so that the highest scores are a sample without replacement by importance. rank: 1, 2, 3 ... for the
    floor(percent * N / 100) highest scores among the N documents of min_words words or more, ties to the smaller id; null for others.

    Null or empty text: no feature, weight 0. A null id is drawn for as an empty one and comes after every other among equal scores;
    rows that repeat an id are ranked each, in any order among themselves. An empty target: every gain is of an empty bucket. Any
    length of text is one list of words in one task. `keep` names further columns to pass through; no other column of docs is read.
    """
    gain = gains(docs, target, text_col, target_col, n, buckets)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_own") if keep else F.lit(None).cast("int").alias("_own"), F.col(text_col).alias("_text"))
    schema = StructType([*own.schema.fields[:2], *[StructField(c, LongType()) for c in ("n_features", "_words", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(n, buckets, gain)
        for b in batches:
            size, weight = [], []
            for text in _texts(b.column(2)):
                found = words(text)
                size.append(len(found))
                weight.append(trie.weigh(found))
            made = [pa.array(x, pa.int64()) for x in ([n_features(k, n) for k in size], size, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=schema.names)
        give_back()

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    # rows are numbered and written once, so that rows alike in everything else keep their places
    scored = cut(own.mapInArrow(run, schema).withColumn("score", F.col("weight") + gumbel).withColumn("_fit", F.col("_words") >= min_words).withColumn("_row", F.monotonically_increasing_id()), "scored")
    ranked, fit = _ranked(scored.select("_id", "score", "_fit", "_row", "_own", "n_features", "weight"))
    drawn = F.when(F.col("_place") <= percent * fit // 100, F.col("_place"))
    return ranked.select(F.col("_id").alias(id_col), *[F.col("_own")[c].alias(c) for c in keep], "n_features", "weight", "score", drawn.cast("long").alias("rank"))


def oracle(buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> str:
    """DuckDB SQL for the registered query. CRC-32 is worked out from its polynomial, once for each distinct word."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all({low}, '{word}') as w from documents),
    f as (select r, unnest(w) as word from d),
    b as (select unnest(regexp_extract_all({low}, '{word}')) as word from benchmark),
    t as (select list(list_reduce([i::bigint] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) as crc from range(256) x(i)),
    v as (select distinct word, hex(encode(word)) as h from (select word from f union all select word from b)),
    k as (select word, xor(list_reduce([4294967295::bigint] || list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint),
        lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % {buckets} as bucket from v, t),
    s as (select bucket, count(*) as s from f join k using (word) group by 1),
    a as (select bucket, count(*) as t from b join k using (word) group by 1),
    n as (select (select count(*) from f) as s_all, (select count(*) from b) as t_all),
    g as (select range as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {buckets}) / ((coalesce(s, 0) + 1)::double * (t_all + {buckets}))))::bigint as gain
        from range({buckets}) left join s on s.bucket = range left join a on a.bucket = range, n),
    w as (select r, sum(gain)::bigint as weight from f join k using (word) join g using (bucket) group by r),
    x as (select r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join w using (r)),
    p as (select r, row_number() over (order by score desc, doc_id nulls last, r) as place from x where n_features >= {min_words})
    select doc_id, n_features, weight, score, case when place <= {percent} * (select count(*) from p) // 100 then place end as rank from x left join p using (r)
    """
