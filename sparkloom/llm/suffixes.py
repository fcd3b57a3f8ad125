"""Exact removal of byte strings that occur more than once, by suffix arrays over shards that hold all that could be equal.

Every window of `window` bytes is represented by its anchor: the leftmost of its `gram`-byte strings with the smallest hash. Equal windows have equal anchors, and
neighbouring windows share one, so a text falls into stretches of windows (about `window` / 2) with one anchor each. A stretch's bytes
are its windows' bytes.

1. Texts are dealt over buckets of bounded size as they are read, and written bucketed: no text is shuffled. A bucket sends a row for
   each anchor it has: hashes of the anchor and of its stretch, and whether there are more of it or different ones in the bucket.
2. An anchor met once is done: its windows are nowhere else. If all its stretches are equal, all their windows repeat. Only where
   stretches of an anchor differ their bytes are needed.
3. The bytes of these, each distinct stretch once, go to shards of bounded size by their anchor. A shard sorts its suffixes by
   external induced sorting (induce.py), which carries the lengths that neighbours have in common: where these reach `window`, a window
   repeats. Bits for each stretch come back to the buckets that hold it.
4. An anchor with more different bytes than `HOT` (a common phrase in ever new surroundings) would make a shard that doesn't end: its
   windows are told apart by 128 bits of hashes, each window a key of its own, counted in the buckets first.

Each bucket then removes what its repeated windows cover. Windows in one stretch differ, since their anchor lies at different places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, give_back, new_folder, salted_join
from .induce import repeated
from .substring import _deal, _mix

WINDOW, GRAM = 200, 64
#: Bytes of text that a bucket holds and that are hashed at once; bytes that a shard sorts, and that one anchor may bring, about.
BUCKET_BYTES, CHUNK, SHARD_BYTES, HOT = 4 << 20, 1 << 20, 2 << 20, 2 << 20
#: Names that a shard's recursion sorts in memory, and bytes that its queues keep there.
MEMORY, HELD = 1 << 22, 64 << 20
#: What is known of an anchor: only equal stretches, different ones, too many different ones (and then: the anchor itself).
EQUAL, MIXED, MANY, COMMON = 0, 1, 2, 3

_rng = np.random.default_rng(20250117)
_TABLE = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_ODD = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(k: int, n: int, inverse: bool) -> np.ndarray:
    """base**i, or base**-i, modulo 2**64 for i < n at least."""
    have = _powers.get((k, inverse))
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK + 1024), pow(_BASES[k], -1, 1 << 64) if inverse else _BASES[k], dtype=np.uint64)
        base[0] = 1
        have = _powers[k, inverse] = np.multiply.accumulate(base)
    return have


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, first byte, bytes) of about CHUNK bytes: long texts in pieces whose windows lie side by side."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - window + 1), CHUNK):
            piece = t[begin : begin + CHUNK + window - 1]
            if held and size + len(piece) > CHUNK + window:
                yield held
                held, size = [], 0
            held.append((k, begin, piece))
            size += len(piece)
    if held:
        yield held


class Stretches:
    """The stretches of a chunk: where their windows begin and end in it, and their anchors' hashes."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], window: int, gram: int):
        self.buf = b"".join(p[2] for p in pieces)
        sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
        self.base = np.cumsum(sizes) - sizes
        flat = np.frombuffer(self.buf, dtype=np.uint8)
        n, self.window = len(flat), window
        none = np.zeros(0, dtype=np.int64)
        self.sums: list[np.ndarray] = []
        if n < window:
            self.start = self.stop = none
            self.anchor = none.view(np.uint64)
            return
        grams = np.zeros(n - gram + 1, dtype=np.uint64)
        for j in range(0, gram, 8):
            words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=self.buf, strides=(1,))[min(j, gram - 8) :][: len(grams)]
            grams += (words ^ (words >> np.uint64(31))) * _ODD[j // 8]
        grams = _mix(grams)
        # the smallest hash, at equal leading bits the leftmost: its place is in the low bits
        key, span, width = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64), window - gram + 1, 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if span > width:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        place = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = np.zeros(n - window + 1, dtype=bool)
        for b, s in zip(self.base.tolist(), sizes.tolist()):
            ok[b : max(b, b + s - window + 1)] = True
        first = np.ones(len(ok), dtype=bool)
        first[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
        # windows of two pieces never share an anchor: one that lies across them isn't ok
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(ok))
        mine = ok[begin]
        self.start, self.stop = begin[mine], end[mine]
        self.anchor = grams[place[self.start]]

    def own(self, which: np.ndarray) -> np.ndarray:
        """Hashes of these stretches' bytes."""
        return self._hash(0, self.start[which], self.stop[which] + self.window - 1)

    def _hash(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        while len(self.sums) <= k:
            flat = np.frombuffer(self.buf, dtype=np.uint8)
            total = np.zeros(len(flat) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[len(self.sums)][flat] * _power(len(self.sums), len(flat), False)[: len(flat)], out=total[1:])
            self.sums.append(total)
        return _mix((self.sums[k][stop] - self.sums[k][start]) * _power(k, len(self.buf) + 1, True)[start] + (stop - start).astype(np.uint64))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each window of these stretches begins, and its two hashes."""
        n = (self.stop - self.start)[which]
        at = np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return at, self._hash(0, at, at + self.window), self._hash(1, at, at + self.window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("_text").cast(pa.binary()).to_pylist()]


def _bucket_of(table: pa.Table) -> int:
    return table.column("_bucket")[0].as_py() if len(table) else 0


def _collapse(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their keys, where each distinct key begins, and how many rows it has."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(order)))


def _emit_anchors(window: int, gram: int):
    def run(t: pa.Table) -> pa.Table:
        anchors, owns, sizes = [], [], []
        for p in _pieces(_texts(t), window):
            s = Stretches(p, window, gram)
            anchors.append(s.anchor)
            owns.append(s.own(np.arange(len(s.start))))
            sizes.append(s.stop - s.start + window - 1)
        a, o, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (anchors, owns, sizes))
        a, o = a.astype(np.uint64, copy=False), o.astype(np.uint64, copy=False)
        order, at, count = _collapse((a, o))
        a, o, n = a[order][at], o[order][at], n[order][at]
        _, first, kinds = _collapse((a,))
        total = np.add.reduceat(count, first) if len(first) else count
        size = np.add.reduceat(n, first) if len(first) else n
        give_back()
        bucket = np.full(len(first), _bucket_of(t), dtype=np.int64)
        return pa.table({"m": _signed(a[first]), "s": _signed(o[first]), "many": total > 1, "mixed": kinds > 1, "size": pa.array(size, pa.int64()), "_bucket": bucket})

    return run


def _emit_stretches(window: int, gram: int):
    """Each distinct stretch of a mixed anchor in the bucket once, with its bytes; of an anchor with too many, its windows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = np.asarray(right.column("kind"))
        m = _unsigned(right.column("m"))
        mixed, many = np.sort(m[kind == MIXED]), np.sort(m[kind == MANY])
        found: dict[tuple[int, int], list] = {}
        hot = []
        for p in _pieces(_texts(left), window) if len(m) else ():
            s = Stretches(p, window, gram)
            some = np.flatnonzero(np.isin(s.anchor, mixed))
            for k, own in zip(some.tolist(), s.own(some).tolist() if len(some) else ()):
                key = int(s.anchor[k]), own
                if key in found:
                    found[key][1] = True
                else:
                    found[key] = [s.buf[s.start[k] : s.stop[k] + window - 1], False]
            some = np.flatnonzero(np.isin(s.anchor, many))
            if len(some):
                hot.append(s.windows(some)[1:])
        h1, h2 = (np.concatenate(x) for x in zip(*hot)) if hot else (np.zeros(0, np.uint64),) * 2
        order, at, count = _collapse((h1, h2))
        keys = np.array(list(found), dtype=np.uint64).reshape(-1, 2)
        n = len(keys) + len(at)
        give_back()
        return pa.table({
            "m": _signed(np.concatenate([keys[:, 0], h1[order][at]])), "s": _signed(np.concatenate([keys[:, 1], h2[order][at]])), "many": np.concatenate([[x[1] for x in found.values()], count > 1]).astype(bool),
            "bytes": pa.array([x[0] for x in found.values()] + [None] * len(at), pa.binary()), "_bucket": np.full(n, _bucket_of(left), dtype=np.int64),
        })

    return run


def _sort_shard(window: int, memory: int, held: int):
    """A shard's distinct stretches -> those with a repeated window, one bit for each window."""

    def run(t: pa.Table) -> pa.Table:
        texts = t.column("bytes").to_pylist()
        hit = repeated(texts, window, memory, held)
        many, bits, at = t.column("many").to_pylist(), [], 0
        for text, twice in zip(texts, many):
            n = len(text) - window + 1
            own = np.ones(n, dtype=bool) if twice else hit[at : at + n]
            bits.append(np.packbits(own).tobytes() if own.any() else None)
            at += len(text) + 1
        out = pa.table({"m": t.column("m"), "s": t.column("s"), "bits": pa.array(bits, pa.binary())})
        give_back()
        return out.filter(out.column("bits").is_valid())

    return run


def _remove(window: int, gram: int, keep: list[str], schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, kind = _texts(left), np.asarray(right.column("kind"))
        m, s2 = _unsigned(right.column("m")), _unsigned(right.column("s"))
        equal, common, many = np.sort(m[kind == EQUAL]), np.sort(m[kind == COMMON]), kind == MANY
        hot = np.unique(np.stack([m[many], s2[many]], axis=1), axis=0)
        marked = {(a, b): x for a, b, x, k in zip(m.tolist(), s2.tolist(), right.column("bits").to_pylist(), kind.tolist()) if k == MIXED}
        mixed = np.array(sorted({a for a, _ in marked}), dtype=np.uint64)
        gone: list[list[tuple[int, int]]] = [[] for _ in texts]
        for p in _pieces(texts, window) if len(m) else ():
            s = Stretches(p, window, gram)
            away = np.zeros(max(0, len(s.buf) - window + 1), dtype=bool)
            for a, b in zip(s.start[w := np.flatnonzero(np.isin(s.anchor, equal))].tolist(), s.stop[w].tolist()):
                away[a:b] = True
            some = np.flatnonzero(np.isin(s.anchor, mixed))
            for k, own in zip(some.tolist(), s.own(some).tolist() if len(some) else ()):
                bits = marked.get((int(s.anchor[k]), own))
                if bits is not None:
                    n = int(s.stop[k] - s.start[k])
                    away[s.start[k] : s.stop[k]] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool)
            some = np.flatnonzero(np.isin(s.anchor, common)) if len(hot) else ()
            if len(some):
                at, h1, h2 = s.windows(some)
                away[at[_pairs_in(h1, h2, hot)]] = True
            edge = np.flatnonzero(np.diff(away.view(np.int8), prepend=0, append=0))
            which = np.searchsorted(s.base, edge[::2], side="right") - 1
            # between the windows of two pieces lie those across them, which aren't any: a run stays in its piece
            for a, b, k in zip(edge[::2].tolist(), edge[1::2].tolist(), which.tolist()):
                text, first, _ = p[k]
                gone[text].append((first + a - int(s.base[k]), first + b - 1 - int(s.base[k]) + window))
        removed, spans, kept = [], [], []
        for text, runs in zip(texts, gone):
            merged: list[list[int]] = []
            for a, b in runs:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            removed.append(sum(b - a for a, b in merged))
            spans.append(len(merged))
            ends = [0, *[x for ab in merged for x in ab], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])) if merged else text)
        cols = {"_id": left.column("_id")} | {c: left.column(c) for c in keep}
        cols |= {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
        out = pa.table(cols).cast(schema)
        give_back()
        return out

    return run


def _pairs_in(h1: np.ndarray, h2: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each (h1, h2) is among the sorted pairs."""
    at, out = np.searchsorted(pairs[:, 0], h1), np.zeros(len(h1), dtype=bool)
    left = np.flatnonzero(at < len(pairs))
    while len(left):
        same = pairs[at[left], 0] == h1[left]
        left = left[same]
        out[left] |= pairs[at[left], 1] == h2[left]
        at[left] += 1
        left = left[at[left] < len(pairs)]
    return out


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT,
    memory: int = MEMORY, held: int = HELD,
) -> DataFrame:
    """docs -> (id, *keep, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those that a string of `window` bytes covers which
    starts more than once in all texts, in the same one or elsewhere.

    No occurrence is spared; strings are judged on the input. kept: the bytes left, which may begin or end inside a character (a
    binary column). n_spans: removed runs. Null or empty texts hold no byte; texts shorter than the window keep all. Rows that repeat
    an id, or lack one, are texts like any other. A text of any length is one row of one bucket, hashed a CHUNK at a time. `keep` names
    further columns to pass through. gram: at least 8, at most the window.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("_id"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_own")] if keep else []), F.col(text_col).alias("_text"))
    name = new_folder(spark, "suffixes").rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.mapInArrow(_deal(0, BUCKET_BYTES), T.StructType([*own.schema.fields, T.StructField("_bucket", T.LongType())])).write.format("parquet").option("path", new_folder(spark, "texts")).bucketBy(parts, "_bucket").sortBy("_bucket").saveAsTable(name)
    texts = spark.table(name)
    by_bucket = texts.select("_text", "_bucket").groupBy("_bucket")

    anchors = cut(by_bucket.applyInArrow(_emit_anchors(window, gram), "m long, s long, many boolean, mixed boolean, size long, _bucket long"), "anchors")
    met = anchors.groupBy("m").agg(F.count("*").alias("n"), F.max("many").alias("many"), (F.max("mixed") | (F.min("s") != F.max("s"))).alias("mixed"), F.sum("size").alias("size")).where("n > 1 or many")
    kind = F.when(~F.col("mixed"), EQUAL).when(F.col("size") > hot, MANY).otherwise(MIXED).cast("int").alias("kind")
    # a commonplace anchor has a row in every bucket: they are spread as they learn its kind
    known = cut(salted_join(anchors.select("m", "_bucket"), met.select("m", kind), "m", "_bucket"), "kinds")

    unsettled = known.where(F.col("kind") != EQUAL)
    sent = cut(by_bucket.cogroup(unsettled.groupBy("_bucket")).applyInArrow(_emit_stretches(window, gram), "m long, s long, many boolean, bytes binary, _bucket long"), "stretches")
    distinct = sent.where("bytes is not null").groupBy("m", "s").agg(F.first("bytes").alias("bytes"), ((F.count("*") > 1) | F.max("many")).alias("many"))
    size = sent.where("bytes is not null").agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    # shards come from other bits of the hash than the shuffle's
    bits = distinct.groupBy(F.pmod(F.shiftright("m", 17), F.lit(shards)).alias("_shard")).applyInArrow(_sort_shard(window, memory, held), "m long, s long, bits binary")
    back = salted_join(sent.where("bytes is not null").withColumn("_key", F.struct("m", "s")).select("_key", "_bucket"), bits.select(F.struct("m", "s").alias("_key"), "bits"), "_key", "_bucket").select("_key.m", "_key.s", "bits", "_bucket")
    windows = sent.where("bytes is null")
    twice = windows.groupBy("m", "s").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many").select(F.struct("m", "s").alias("_key"))
    rest = salted_join(windows.select(F.struct("m", "s").alias("_key"), "_bucket"), twice, "_key", "_bucket").select("_key.m", "_key.s", F.lit(None).cast("binary").alias("bits"), "_bucket")
    settled = known.where(F.col("kind") != MIXED).select("m", F.lit(0).cast("long").alias("s"), F.lit(None).cast("binary").alias("bits"), "_bucket", F.when(F.col("kind") == MANY, COMMON).otherwise(EQUAL).alias("kind"))
    info = settled.unionByName(back.withColumn("kind", F.lit(MIXED))).unionByName(rest.withColumn("kind", F.lit(MANY)))

    names = ["_own"] if keep else []
    schema = T.StructType([texts.schema["_id"], *[texts.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    out = texts.groupBy("_bucket").cogroup(info.groupBy("_bucket")).applyInArrow(_remove(window, gram, names, to_arrow_schema(schema)), schema)
    return out.select(F.col("_id").alias(id_col), *[F.col("_own")[c].alias(c) for c in keep], "n_bytes", "n_removed", "n_spans", "kept")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the registered query: every window by the MD5 of its bytes' hex digits."""
    return rf"""
    with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    c as (select r, b, substr(h, 2 * b + 1, 2 * (1000 + {window - 1})) as h from (select r, h, unnest(range(0, len(h) // 2, 1000)) as b from d)),
    w as (select r, b + i as i, md5_number(substr(h, (2 * i + 1)::int, {2 * window})) as m from (select r, b, h, unnest(range(0, least(1000, len(h) // 2 - {window - 1}))) as i from c)),
    t as (select m from w group by m having count(*) > 1),
    x as (select r, i, coalesce(i - lag(i) over (partition by r order by i) > {window}, true) as new from w semi join t using (m)),
    y as (select r, i, sum(new::int) over (partition by r order by i) as k from x),
    s as (select r, k, min(i) as a, max(i) + {window} as e from y group by r, k),
    n as (select r, sum(e - a) as n_removed, count(*) as n_spans from s group by r),
    g as (select r, a, lag(e, 1, 0) over (partition by r order by a) as b from s union all select r, null, max(e) from s group by r),
    k as (select g.r, string_agg(case when a is null then substr(h, (2 * b + 1)::int) else substr(h, (2 * b + 1)::int, (2 * (a - b))::int) end, '' order by b) as h from g join d using (r) group by g.r)
    select doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
    from d left join n using (r) left join k using (r)
    """
