"""Substring deduplication over a log-structured index of window fingerprints.

A window is `window` consecutive words of one document. A word goes if a window covers it whose word sequence also starts
in a document with a smaller id.

Every window is represented by the smallest hash among the word n-grams inside it (its fingerprint), so equal windows have
equal fingerprints and only about a fifth as many fingerprints as windows are moved. Documents come in batches, in the order of
their ids. A task deals a batch's texts over buckets of bounded size as it reads them, and writes them down bucketed, so that no text is
shuffled. What a bucket sends is one row for each fingerprint or window it holds, so the commonest passage of the corpus gives as many
rows as there are buckets, never as many as documents, and no pairs. A text that a smaller id holds word for word is settled
by a digest of the whole text and sends nothing.

1. A batch's fingerprints become a run: a table with one file for each of its buckets, sorted by fingerprint, never changed again.
2. The run is merge-joined with each older run and with itself: all are bucketed alike and read in their order, so none is shuffled or sorted.
3. Verification: the buckets of the batch and of history that hold a met fingerprint, and only these, send the windows it stands
   for: 64 and 32 bits of two independent hashes over the words, and the bucket's smallest document. Few of them: only their files are opened.
4. Windows whose smallest owner is another come back to the batch's buckets; with a bucket's own order they decide which words go.
5. When a level has `fanout` runs they are merged into one run of the next level, so that a batch meets few runs.
6. A manifest says which tables make up the index: another session, later, goes on from it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, delete, give_back, new_folder, salted_join

WINDOW, GRAM = 13, 4
#: Bytes of text that a bucket holds, about.
BUCKET_BYTES = 4 << 20
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Stands for a null id: after every other.
LAST = (1 << 63) - 1

_rng = np.random.default_rng(20240131)
_TABLES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_PLACES = _rng.integers(0, 1 << 64, (2, 64), dtype=np.uint64) | np.uint64(1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(k: int, n: int, inverse: bool) -> np.ndarray:
    """base**i, or base**-i, modulo 2**64 for i < n at least."""
    have = _powers.get((k, inverse))
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK + 1), pow(_BASES[k], -1, 1 << 64) if inverse else _BASES[k], dtype=np.uint64)
        base[0] = 1
        have = _powers[k, inverse] = np.multiply.accumulate(base)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def _words(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Document of each word (counted within texts), the words' two hashes, words per text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    word = (buf != 32) & ((buf < 9) | (buf > 13))
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    start, stop = edge[::2], edge[1::2]
    doc = np.searchsorted(ends, start, side="right")
    hashes = []
    for k in range(2):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_TABLES[k][buf] * _power(k, len(buf), False)[: len(buf)], out=total[1:])
        hashes.append(_mix((total[stop] - total[start]) * _power(k, len(buf), True)[start] + (stop - start).astype(np.uint64)))
    return doc, hashes, np.bincount(doc, minlength=len(texts))


def _grams(h: np.ndarray, n: int, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * _PLACES[k, j]
    return _mix(out)


def _check(h: np.ndarray, window: int) -> np.ndarray:
    """32 more bits over the window's words, from hashes that are independent of the first ones."""
    return _grams(h, window, 1) >> np.uint64(32)


def _windows(doc: np.ndarray, window: int) -> np.ndarray:
    """Whether a window starts at each word up to the last that could start one."""
    return doc[: len(doc) - window + 1] == doc[window - 1 :] if len(doc) >= window else np.zeros(0, dtype=bool)


def _fingerprint(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest n-gram hash inside the window at each word."""
    g = _grams(h, gram, 0)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    return np.minimum(g[: len(g) - (span - width)], g[span - width :]) if span > width else g


def _runs(fp: np.ndarray, doc: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that begin a stretch of one fingerprint in one document, and the stretch of each window."""
    first = np.ones(len(fp), dtype=bool)
    first[1:] = (fp[1:] != fp[:-1]) | (doc[1 : len(fp)] != doc[: len(fp) - 1]) | (ok[1:] != ok[:-1])
    return np.flatnonzero(first), np.cumsum(first) - 1


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(LAST)).astype(np.int64)


def _smallest(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h1, h2), the smallest id of each, and the class of each input."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], at) if len(at) else np.zeros(0, dtype=np.int64)
    kind = np.empty(len(a), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    return a[at], b[at], least, kind


def _sorted_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h1 = np.asarray(table.column("h1")).astype(np.int64).view(np.uint64)
    h2 = np.asarray(table.column("h2")).astype(np.int32).view(np.uint32).astype(np.uint64)
    order = np.lexsort((h2, h1))
    return h1[order], h2[order]


def _among(h1: np.ndarray, h2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    found = np.zeros(len(h1), dtype=bool)
    if not len(s1):
        return found
    at = np.searchsorted(s1, h1)
    while True:  # once, unless two members share their first hash
        inside = at < len(s1)
        same = np.zeros(len(h1), dtype=bool)
        same[inside] = s1[at[inside]] == h1[inside]
        if not same.any():
            return found
        found[same] |= s2[at[same]] == h2[same]
        if not (same & ~found).any():
            return found
        at = np.where(same, at + 1, len(s1))


def _copies(ids: np.ndarray, texts: list[bytes], info: pa.Table) -> np.ndarray:
    """Which rows are whole copies of a text with a smaller id: info's rows with a tag name them by id and digest."""
    named = set(zip(np.asarray(info.column("_copy")).tolist(), info.column("_tag").to_pylist()))
    held = {i for i, _ in named}
    return np.array([i in held and (i, int(hashlib.sha256(t).hexdigest()[:15], 16)) in named for i, t in zip(ids.tolist(), texts)], dtype=bool)


def _tagged(info: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(rows that name copies, the others)."""
    tag = info.column("_tag").is_valid()
    return info.filter(tag), info.filter(info.column("_tag").is_null())


def _bucket_fingerprints(bucket: int, texts: list[bytes], window: int, gram: int) -> pa.Table:
    fps, docs = [], []
    for first, chunk in _chunks(texts):
        doc, (h, _), _ = _words(chunk)
        if len(doc) < window:
            continue
        fp, ok = _fingerprint(h, window, gram), _windows(doc, window)
        at, _ = _runs(fp, doc, ok)
        at = at[ok[at]]
        fps.append(fp[at])
        docs.append(doc[at] + first)
    fp, doc = (np.concatenate(x) for x in (fps, docs)) if fps else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(fp, kind="stable")
    fp, doc = fp[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, dtype=np.int64)
    many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, dtype=bool)
    return pa.table({"m": fp[at].view(np.int64), "_bucket": np.full(len(at), bucket, dtype=np.int64), "many": many})


def _deal(serial: int, size: int):
    """Rows with the text last -> with a bucket: about `size` bytes of neighbouring texts of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, task = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            buckets = np.empty(len(b), dtype=np.int64)
            for k, n in enumerate(pc.binary_length(b.column(b.num_columns - 1).cast(pa.binary())).fill_null(0).to_pylist()):
                if held and held + n > size:
                    number, held = number + 1, 0
                held += n
                buckets[k] = number
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(buckets + ((serial << 44) + (task << 20)))], names=[*b.schema.names, "_bucket"])

    return run


def _emit_fresh_fingerprints(window: int, gram: int):
    """One bucket and its copies."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _ids(left.column("_id")), _bytes(left.column("_text"))
        fresh = np.flatnonzero(~_copies(ids, texts, right)).tolist()
        give_back()
        return _bucket_fingerprints(left.column("_bucket")[0].as_py() if len(left) else 0, [texts[i] for i in fresh], window, gram)

    return run


def _emit_windows(window: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        named, info = _tagged(right)
        ids, texts = _ids(left.column("_id")), _bytes(left.column("_text"))
        fresh = np.flatnonzero(~_copies(ids, texts, named))
        ids, texts = ids[fresh], [texts[i] for i in fresh.tolist()]
        met = np.sort(np.asarray(info.column("m")).astype(np.int64).view(np.uint64))
        parts = []
        for first, chunk in _chunks(texts) if len(met) else ():
            doc, (h1, h2), _ = _words(chunk)
            if len(doc) < window:
                continue
            fp, ok = _fingerprint(h1, window, gram), _windows(doc, window)
            at, stretch = _runs(fp, doc, ok)
            hit = met[np.minimum(np.searchsorted(met, fp[at]), len(met) - 1)] == fp[at]
            take = np.flatnonzero(hit[stretch] & ok)
            if len(take):
                parts.append((_grams(h1, window, 0)[take], _check(h2, window)[take], ids[doc[take] + first]))
        h1, h2, own = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        a, b, least, _ = _smallest(h1, h2, own)
        give_back()
        bucket = left.column("_bucket")[0].as_py() if len(left) else 0
        return pa.table({"h1": a.view(np.int64), "h2": b.astype(np.uint32).view(np.int32), "least": least, "_bucket": np.full(len(a), bucket, dtype=np.int64)})

    return run


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that go. What stands between words that stay side by side stays; where words went the white space before
    them stays, or that after them if only that ends a line, or a line's end if lines ended among them."""
    spans, out, last = [m.span() for m in WORD.finditer(text)], [], -1
    for i in np.flatnonzero(~gone).tolist():
        begin = spans[i][0]
        if last == i - 1:
            out.append(text[spans[last][1] if i else 0 : begin])
        elif last >= 0:
            before, after = text[spans[last][1] : spans[last + 1][0]], text[spans[i - 1][1] : begin]
            ends = b"\n" in text[spans[last][1] : begin]
            out.append(before if b"\n" in before or not ends else after if b"\n" in after else b"\n")
        out.append(text[begin : spans[i][1]])
        last = i
    if spans and last == len(spans) - 1:
        out.append(text[spans[-1][1] :])
    return b"".join(out)


def _remove(window: int, keep: list[str], schema: pa.Schema, rejoin: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _ids(left.column("_id")), _bytes(left.column("_text"))
        named, info = _tagged(right)
        copy = _copies(ids, texts, named)
        s1, s2 = _sorted_pairs(info)
        parts, counts, docs = [], [], []
        for first, chunk in _chunks(texts):
            doc, (h1, h2), n = _words(chunk)
            counts.append(n)
            docs.append(doc + first)
            ok = _windows(doc, window)
            take = np.flatnonzero(ok & ~copy[doc[: len(ok)] + first])
            offset = sum(map(len, docs[:-1]))
            parts.append((_grams(h1, window, 0)[take], _check(h2, window)[take], ids[doc[take] + first], take + offset))
        n_words = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        total = int(n_words.sum())
        gone = np.zeros(total, dtype=bool)
        if parts:
            h1, h2, own, at = (np.concatenate(x) for x in zip(*parts))
            _, _, least, kind = _smallest(h1, h2, own)
            away = at[(own > least[kind]) | _among(h1, h2, s1, s2)] if len(at) else at
            step = np.zeros(total + window + 1, dtype=np.int32)
            np.add.at(step, away, 1)
            np.add.at(step, away + window, -1)
            gone = np.cumsum(step)[:total] > 0
            # all words of a copy go, if it has a window at all
            gone |= np.repeat(copy & (n_words >= window), n_words)
        ends = np.cumsum(n_words)
        upto = np.concatenate([[0], np.cumsum(gone)])
        n_removed = upto[ends] - upto[ends - n_words]
        kept = []
        whole = left.column("_text").to_pylist() if not rejoin else texts
        for t, e, n, r, own in zip(texts, ends, n_words, n_removed, whole):
            if not r and not rejoin:
                kept.append(own)
                continue
            if rejoin:
                words = t.split()
                kept.append(b" ".join(words if not r else compress(words, ~gone[e - n : e])).decode())
            else:
                kept.append(_without(t, gone[e - n : e]).decode())
        cols = {"_id": left.column("_id")} | {c: left.column(c) for c in keep}
        cols |= {"n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_text": pa.array(kept, type=pa.string())}
        out = pa.table(cols)
        give_back()
        return out.cast(schema)

    return run


#: Buckets of history that are named one by one in a scan; of more, all files are read.
NAMED = 10_000
#: Buckets that may hold a fingerprint before its windows are added up in tasks first.
HOT_BUCKETS = 10_000
#: A scan of a bucketed table with one file a bucket is in the files' order.
_IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class FingerprintIndex:
    """An index that takes batches of documents in the order of their ids; with the path of one that exists, that one.

    Under its folder: `texts<serial>` (the batches' texts, bucketed), `L<level>_<serial>` (the runs: (m, _bucket, many), bucketed and
    sorted by m), `digests<serial>`, `copies<serial>` and `manifest<serial>`. Everything is written once; merged runs are deleted. What a
    batch wrote that failed before its manifest is written again by the next.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, window: int = WINDOW, gram: int = GRAM, parts: int | None = None):
        self.spark, self.path, self.fanout = spark, path or new_folder(spark, "index"), fanout
        self.names = f"sparkloom_{uuid.uuid4().hex}"
        # parts: buckets of the tables, the same for the index's whole life, or they wouldn't join without a shuffle
        self.held = {"serial": 0, "runs": [], "texts": [], "window": window, "gram": gram, "parts": parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "schema": None}
        if done := [f for f in self._folders() if f.startswith("manifest")]:
            self.held = json.loads(spark.read.text(f"{self.path}/{max(done)}").first()[0])
            for name in self.held["texts"]:
                self._register(name, self.held["schema"], "_bucket")
            for name in self.held["runs"]:
                self._register(name, "m BIGINT, _bucket BIGINT, many BOOLEAN", "m")

    window, gram, parts = (property(lambda self, k=k: self.held[k]) for k in ("window", "gram", "parts"))
    serial, runs, texts = (property(lambda self, k=k: self.held[k]) for k in ("serial", "runs", "texts"))

    def _folders(self) -> list[str]:
        """Folders of the index that were written to their end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [e.getPath().getName() for e in (fs.listStatus(root) if fs.exists(root) else []) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(e.getPath(), "_SUCCESS"))]

    def _register(self, name: str, schema: str, by: str) -> None:
        self.spark.sql(f"CREATE TABLE {self.names}_{name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.parts} BUCKETS LOCATION '{self.path}/{name}'")

    def _write(self, rows: DataFrame, name: str, by: str) -> DataFrame:
        delete(self.spark, f"{self.path}/{name}")
        rows.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(self.parts, by).sortBy(by).saveAsTable(f"{self.names}_{name}")
        return self.spark.table(f"{self.names}_{name}")

    def _save(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _saved(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.names}_{name}")
        delete(self.spark, f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.names}_{name}")

    def _meets(self, run: str) -> DataFrame:
        """(_bucket, m) of the run's own fingerprints that are met in it twice or in an older run, and of the older runs' rows that it meets."""
        new = self._table(run)
        twice = new.groupBy("m").agg(F.count("*").alias("n"), F.max("many").alias("any")).where("n > 1 or any").select("m")
        total = new.join(twice, "m", "left_semi").select("_bucket", "m")
        for older in self.runs:
            old = self._table(older)
            total = total.unionByName(new.join(old.select("m"), "m", "left_semi").select("_bucket", "m")).unionByName(old.join(new.select("m"), "m", "left_semi").select("_bucket", "m"))
        return total

    def _met(self, run: str) -> DataFrame:
        before = self.spark.conf.get(_IN_ORDER)
        self.spark.conf.set(_IN_ORDER, "true")
        try:
            return cut(self._meets(run), "met")
        finally:
            self.spark.conf.set(_IN_ORDER, before)

    def _holding(self, name: str, met: DataFrame) -> DataFrame:
        """Texts of the buckets that hold a met fingerprint."""
        rows = self._table(name).select("_id", "_text", "_bucket")
        serial = int(name.removeprefix("texts"))
        buckets = met.where(F.shiftright("_bucket", 44) == serial).select("_bucket").distinct()
        some = [r[0] for r in buckets.limit(NAMED + 1).collect()]
        return rows.where(F.col("_bucket").isin(some)) if len(some) <= NAMED else rows.join(buckets, "_bucket", "left_semi")

    def _windows(self, met: DataFrame, copies: dict[str, DataFrame]) -> DataFrame:
        """(h1, h2, least, _bucket): the windows that met fingerprints stand for, of every bucket that holds one."""
        wins = None
        for held, gone in copies.items():
            sent = self._holding(held, met).groupBy("_bucket").cogroup(met.unionByName(gone, allowMissingColumns=True).groupBy("_bucket")).applyInArrow(_emit_windows(self.window, self.gram), "h1 long, h2 int, least long, _bucket long")
            wins = sent if wins is None else wins.unionByName(sent)
        return wins

    def _away(self, name: str, met: DataFrame) -> DataFrame:
        """(_bucket, h1, h2): windows of the batch that a smaller id owns elsewhere. A window has one row for each bucket that holds it; what
        stands in more than HOT_BUCKETS is added up in each task first, and its rows are dealt anew where a task would get too many."""
        copies = {held: self._saved(f"copies{held.removeprefix('texts')}", "_bucket long, _copy long, _tag long") for held in [name, *self.texts]}
        mine = F.shiftright("_bucket", 44) == self.serial
        hot = cut(met.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKETS).select("m"), "hot")
        if hot.isEmpty():
            rare, common = met, None
        else:
            rare, common = cut(met.join(hot, "m", "left_anti"), "met"), cut(met.join(hot, "m", "left_semi"), "met")
        first = F.min("least").over(Window.partitionBy("h1", "h2"))
        away = self._windows(rare, copies).withColumn("first", first).where(mine & (F.col("first") < F.col("least"))).select("_bucket", "h1", "h2")
        if common is None:
            return away
        wins = cut(self._windows(common, copies), "windows")
        owner = wins.groupBy("h1", "h2").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("h1", "h2", "first")
        return away.unionByName(wins.where(mine).join(owner, ["h1", "h2"]).where("first < least").select("_bucket", "h1", "h2"))

    def _compact(self) -> list[str]:
        """Merge full levels; returns the runs that went into others."""
        level, merged_away = 0, []
        while len(full := [x for x in self.runs if x.startswith(f"L{level}_")]) >= self.fanout:
            merged = self._table(full[0])
            for x in full[1:]:
                merged = merged.unionByName(self._table(x))
            name = f"L{level + 1}_{self.serial}"
            self._write(merged.repartition(self.parts, "m"), name, "m")  # one file a bucket again
            self.held["runs"] = [x for x in self.runs if x not in full] + [name]
            merged_away += full
            level += 1
        return merged_away

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
        """docs -> (id, *keep, n_words, n_removed, kept_text): each input row without the words that repeat a smaller id's of this batch or
        of an earlier one. Its ids must be larger than those of earlier batches; nothing is taken back from these.

        Null or empty text: no words, empty kept_text. Texts shorter than a window keep every word. Rows with the same id don't remove
        each other's words. A null id counts as larger than every other. `keep` names further columns to pass through.
        rejoin: kept words are joined by single spaces in every text; otherwise the white space between words that stay side by side
        stays as it is.
        """
        self.held["serial"] += 1
        own = docs.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
        schema = StructType([*own.schema.fields, StructField("_bucket", LongType())])
        name = f"texts{self.serial}"
        texts = self._write(own.mapInArrow(_deal(self.serial, BUCKET_BYTES), schema), name, "_bucket")

        digest = F.sha2(F.coalesce("_text", F.lit("")), 256)
        marked = self._save(texts.select("_bucket", F.coalesce("_id", F.lit(LAST)).alias("_copy"), F.unhex(F.substring(digest, 1, 40)).alias("_digest"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_tag")), f"digests{self.serial}")
        known = marked.select("_digest", F.col("_copy").alias("_first"))
        for old in self.texts:
            known = known.unionByName(self._saved(f"digests{old.removeprefix('texts')}", "_digest binary, _copy long").select("_digest", F.col("_copy").alias("_first")))
        first = known.groupBy("_digest").agg(F.min("_first").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        copies = self._save(salted_join(marked, first, "_digest", "_copy").where("_copy > _first").select("_bucket", "_copy", "_tag"), f"copies{self.serial}")

        fresh = texts.select("_id", "_text", "_bucket").groupBy("_bucket").cogroup(copies.groupBy("_bucket"))
        run = f"L0_{self.serial}"
        self._write(fresh.applyInArrow(_emit_fresh_fingerprints(self.window, self.gram), "m long, _bucket long, many boolean").repartition(self.parts, "m"), run, "m")
        met = self._met(run)

        away = self._away(name, met).unionByName(copies, allowMissingColumns=True)
        fields = [f for f in texts.schema.fields if f.name == "_id"] + [texts.schema[c] for c in keep]
        schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
        kept = texts.groupBy("_bucket").cogroup(away.groupBy("_bucket")).applyInArrow(_remove(self.window, list(keep), to_arrow_schema(schema), rejoin), schema)

        self.held["texts"].append(name)
        self.held["runs"].append(run)
        # what later batches ask of texts
        self.held["schema"] = "_id BIGINT, _text STRING, _bucket BIGINT"
        away_runs = self._compact()
        self.spark.createDataFrame([(json.dumps(self.held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest{self.serial:08d}")
        for x in away_runs:  # only now does nothing name them
            self._drop(x)
        return kept.toDF(id_col, *keep, "n_words", "n_removed", "kept_text")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), rejoin: bool = True, batches: int = 3) -> DataFrame:
    """All documents through an index in batches of about the same number of rows, by ranges of their ids: see FingerprintIndex.add."""
    node = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    cuts = docs.agg(F.percentile_approx(node, [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] or []
    index, found, low = FingerprintIndex(docs.sparkSession), None, None
    for high in [*sorted({c for c in cuts if c < LAST}), None]:
        part = docs if low is None else docs.where(node > low)
        part = part if high is None else part.where(node <= high)
        own = index.add(part, id_col, text_col, keep, rejoin)
        found, low = own if found is None else found.unionByName(own), high
    return found


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the registered query: each row's words, removed words and the hash of what is kept."""
    return rf"""
    with d as (select row_number() over () as r, coalesce(doc_id, {LAST}) as i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    g as (select r, i, k, array_to_string(list_slice(w, k, k + {window - 1}), ' ') as g from (select r, i, w, unnest(range(1, len(w) - {window - 2})) as k from d)),
    m as (select g, min(i) as first from g group by g),
    x as (select distinct g.r, g.k + t.j as k from g join m using (g), range({window}) t(j) where m.first < g.i),
    s as (select r, unnest(w) as word, generate_subscripts(w, 1) as k from d),
    kept as (select s.r, count(*) as n, string_agg(s.word, ' ' order by s.k) as t from s anti join x on s.r = x.r and s.k = x.k group by s.r)
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
    from d left join kept using (r)
    """
