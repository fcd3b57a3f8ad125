"""Product codes for vectors, trained by Lloyd's rounds whose sums are maintained by differences.

Components become integers, so that sums are exact and may be kept running. A vector is cut into parts, each with a codebook. The
assignments of the last round are kept with the vectors in a written table; a round reads it, assigns every part to the nearest entry
of its codebook, writes the next table, and sends through the shuffle only what changed: for a part that moved, its components
added to the new entry's sum and taken from the old one's, added up in the task first. Later rounds move few parts, so they send few
numbers; the codebooks (parts x entries) and their sums are all that the driver ever holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, give_back, salted_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components beyond this size count as of this size: squares of differences stay exact in 64 bits.
LARGEST = (1 << 28) - 1
NONE = 255  # no entry yet


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row; ties to the lower entry. Through a product of matrices where doubles hold it exactly."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if size * size * 4 * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    else:
        d = np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _parts(v: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width; a length that doesn't divide is filled up with zeros, which are at no distance."""
    width = -(-v.shape[1] // parts)
    return np.pad(v, ((0, 0), (0, parts * width - v.shape[1]))).reshape(len(v), parts, width)


class Codebooks:
    """parts x entries x width integers, with the running count and sum of what is assigned to each."""

    def __init__(self, books: np.ndarray, length: int):
        self.books, self.length = books, length
        self.count = np.zeros(books.shape[:2], dtype=object)
        self.sum = np.zeros(books.shape, dtype=object)  # Python's integers: no bound on rows

    def update(self, moved: list) -> None:
        """moved: (part, entry, place, count, sum) differences; place 0 to width - 1, counts at place 0."""
        for part, entry, place, n, s in moved:
            self.count[part, entry] += n
            self.sum[part, entry, place] += s
        for part, entry in zip(*np.nonzero(self.count)):
            self.books[part, entry] = [s // self.count[part, entry] for s in self.sum[part, entry]]

    def digest(self) -> str:
        flat = [self.books[p, e] for p in range(self.books.shape[0]) for e in range(self.books.shape[1])]
        width = self.books.shape[2]
        real = [min(width, max(0, self.length - p * width)) for p in range(self.books.shape[0]) for _ in range(self.books.shape[1])]
        return hashlib.sha256(",".join(str(int(x)) for row, n in zip(flat, real) for x in row[:n]).encode()).hexdigest()


_DELTA = [T.StructField("_part", T.IntegerType()), T.StructField("_entry", T.IntegerType()), T.StructField("_count", T.LongType()), T.StructField("_sum", T.ArrayType(T.LongType()))]


def _round(books: np.ndarray, parts: int, names: list[str], scale: int | None):
    """Rows (*names, _v, _code) -> the same with the new code and _error, and at the task's end a row for each entry that changed. scale:
    _v still holds the vectors themselves, and there is no code yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, empty = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64), None
        out = [*names, "_v", "_code", "_error", *[f.name for f in _DELTA]]
        for b in batches:
            empty = b.slice(0, 0)
            if not len(b):
                continue
            if scale is None:
                v = np.frombuffer(b"".join(b.column("_v").to_pylist()), dtype="<i4").astype(np.int64).reshape(len(b), -1)
                old = np.frombuffer(b"".join(b.column("_code").to_pylist()), dtype=np.uint8).reshape(len(b), parts)
            else:
                v = integers(np.asarray(b.column("_v").flatten()), scale).reshape(len(b), -1)
                old = np.full((len(b), parts), NONE, dtype=np.uint8)
            cut_up, new, error = _parts(v, parts), np.empty((len(b), parts), dtype=np.uint8), np.zeros(len(b), dtype=np.int64)
            for p in range(parts):
                best, d = nearest(cut_up[:, p], books[p])
                new[:, p] = best
                error += d
                for sign, entry in ((1, new[:, p]), (-1, old[:, p])):
                    moved = np.flatnonzero((new[:, p] != old[:, p]) & (entry != NONE))
                    np.add.at(count[p], entry[moved], sign)
                    np.add.at(total[p], entry[moved], sign * cut_up[moved, p])
            held = b.column("_v") if scale is None else pa.array([row.tobytes() for row in v.astype("<i4")], pa.binary())
            none = [pa.nulls(len(b), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], held, pa.array([row.tobytes() for row in new], pa.binary()), pa.array(error), *none], names=out)
        at = np.argwhere((count != 0) | (total != 0).any(axis=2))
        if empty is not None and len(at):
            nulls = [pa.nulls(len(at), empty.column(c).type) for c in names] + [pa.nulls(len(at), t) for t in (pa.binary(), pa.binary(), pa.int64())]
            sums = pa.array([total[p, e].tolist() for p, e in at], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([int(count[p, e]) for p, e in at], pa.int64()), sums], names=out)
        give_back()

    return run


def train(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """(rows (id, *keep, code, error), the codebooks): every vector's code under codebooks trained on all of them.

    code: a byte for each part. error: the squared distances to the codes' entries, added up. A part's codebook begins as that part of the `entries`
    smallest ids' vectors (of rows that repeat an id, the smaller vectors first); fewer rows give fewer entries, and without rows there
    are no codebooks (None). Rows drop out whose vector is null or empty, holds null or non-finite components, or isn't as long as the
    smallest id's; all-zero vectors and null ids (after all others) take part. Components are floor(scale * x), at most LARGEST in size.
    At most 255 entries.
    """
    if not 0 < entries <= NONE:
        raise ValueError("a code is one byte a part")
    v = F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_own")] if keep else []), F.col(vec_col).cast("array<double>").alias("_v"))
    rows = rows.where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    first = rows.select("_id", "_v").orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).collect()
    names = ["_id", "_own"] if keep else ["_id"]
    own = [F.col("_own")[c].alias(c) for c in keep]
    if not first:
        return rows.select(F.col("_id").alias(id_col), *own, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    length = len(first[0]["_v"])
    begin = _parts(np.array([integers(np.array(r["_v"]), scale) for r in first if len(r["_v"]) == length]), parts)
    books = Codebooks(np.ascontiguousarray(begin.transpose(1, 0, 2)), length)
    state = rows.where(F.size(v) == length)
    schema = T.StructType([*[T.StructField(c, state.schema[c].dataType) for c in names], T.StructField("_v", T.BinaryType()), T.StructField("_code", T.BinaryType()), T.StructField("_error", T.LongType()), *_DELTA])
    written = None
    for k in range(rounds + 1):
        found = state.mapInArrow(_round(books.books.copy(), parts, names, scale if written is None else None), schema)
        if k == rounds and written is not None:
            # the last assignment moves no entry any more and needs the vectors no more
            found = found.drop("_v")
        table = cut(found, f"round{k}")
        if written is not None:
            drop(written)
        written, state = table, table.where(F.col("_part").isNull()).select(*[c for c in (*names, "_v", "_code") if c in table.columns])
        if k < rounds:
            changed = table.where(F.col("_part").isNotNull()).select("_part", "_entry", "_count", F.posexplode("_sum").alias("_place", "_s"))
            moved = changed.groupBy("_part", "_entry", "_place").agg(F.sum(F.when(F.col("_place") == 0, F.col("_count")).otherwise(0)).alias("n"), F.sum("_s").alias("s"))
            books.update([tuple(r) for r in moved.collect()])  # one row for each number of the codebooks at most
    return written.where(F.col("_part").isNull()).select(F.col("_id").alias(id_col), *own, F.col("_code").alias("code"), F.col("_error").alias("error")), books


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with `decoded`: the vectors that the codes stand for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in part]) for part in books.books])
    digits = F.transform(F.sequence(F.lit(0), F.lit(books.books.shape[0] - 1)), lambda p: F.get(F.get(table, p), F.conv(F.substring(F.hex(F.col(code_col)), p * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.withColumn("decoded", F.slice(F.flatten(digits), 1, books.length))


def digests(vectors: DataFrame) -> DataFrame:
    """The columns of the registered query. Errors are summed over each label, and rows of one label are spread as they get theirs."""
    rows, books = train(vectors, keep=("label",))
    rows = rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.struct("label").alias("_label"))
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    out = salted_join(rows, sums, "_label", "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the registered query: every round as two common tables. For vectors of one length that `parts` divides."""
    sql = rf"""
    with e as (select row_number() over () as r, vec_id, label, embedding from embeddings
        where embedding is not null and len(embedding) > 0 and list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')),
    q as materialized (select r, vec_id, label, p, list_slice(list_transform(embedding, lambda x: floor({scale} * x::double)::bigint), p * len(embedding) // {parts} + 1, (p + 1) * len(embedding) // {parts}) as v
        from e, range({parts}) t(p)),
    c0 as materialized (select p, (row_number() over (partition by p order by vec_id, v) - 1)::int as c, v from q qualify row_number() over (partition by p order by vec_id, v) <= {entries})"""
    near = "select r, any_value(q.vec_id) as vec_id, any_value(label) as label, q.p as p, any_value(q.v) as v, min({{'d': list_sum(list_transform(list_zip(q.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'c': c}}) as n from q join c{k} using (p) group by r, q.p"
    for k in range(rounds + 1):
        sql += f",\n    a{k} as materialized ({near.format(k=k)})"
        if k < rounds:
            sql += f""",
    s{k} as (select p, c, i, floor(sum(x)::double / count(*))::bigint as x from (select p, n.c as c, unnest(v) as x, generate_subscripts(v, 1) as i from a{k}) group by p, c, i),
    c{k + 1} as materialized (select c{k}.p, c{k}.c, coalesce(any_value(m.v), any_value(c{k}.v)) as v from c{k} left join (select p, c, list(x order by i) as v from s{k} group by p, c) m on m.p = c{k}.p and m.c = c{k}.c group by c{k}.p, c{k}.c)"""
    return sql + f""",
    f as (select r, any_value(vec_id) as vec_id, any_value(label) as label, string_agg(printf('%02x', n.c), '' order by p) as code, sum(n.d)::bigint as error from a{rounds} group by r),
    h as (select sha256(string_agg(x::varchar, ',' order by p, c, i)) as codebooks_sha256 from (select p, c, unnest(v) as x, generate_subscripts(v, 1) as i from c{rounds}))
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f, h
    """
