"""Selection under a budget: walk a ranking, take what still fits, skip what doesn't and go on.

A row taken makes later, smaller ones fit or not, so this is no prefix sum. The ranking is sorted once over the whole cluster; where they lie sorted, runs
of up to BLOCK rows become one row each: their sizes, the smallest of them and their sum. A group is then walked block by block, as a
stream: a block whose smallest row doesn't fit is passed over, one that fits as a whole is taken whole, and only the others are
looked into. Neither a task nor the driver holds a group, and the number of jobs depends on nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.stores import shared_folder

BITS = 10
BLOCK = 1 << BITS
_FACTS = [T.StructField("_first", T.LongType()), T.StructField("_least", T.LongType()), T.StructField("_sum", T.LongType()), T.StructField("_sizes", T.ArrayType(T.LongType()))]


def _keys(batch: pa.RecordBatch, n: int) -> list[tuple]:
    return list(zip(*[c.to_pylist() for c in batch.columns[:n]])) if n else [()] * len(batch)


def _packed(n: int, schema: pa.Schema):
    """Rows (n group columns, _at, _cost) in order -> a row for each run of one group in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # group, first place, sizes

        def rows(done: list[list]) -> pa.RecordBatch:
            facts = []
            for key, first, sizes in done:
                known = [s for s in sizes if s is not None]
                facts.append([*key, first, min(known, default=None), sum(known), sizes])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*facts) if facts else [[]] * len(schema), schema)], schema=schema)

        for b in batches:
            done = []
            for key, at, cost in zip(_keys(b, n), b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                if open_ is None or open_[0] != key or open_[1] >> BITS != at >> BITS:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [key, at, []]
                open_[2].append(cost)
            yield rows(done)
        if open_ is not None:
            yield rows([open_])

    return run


def _walked(n: int, budget: int, top: int | None):
    """The packed rows of whole groups, in order -> (_at, spent) of what is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent, count = None, 0, 0
        for b in batches:
            at, sums = [], []
            for k, (key, first, least, total) in enumerate(zip(_keys(b, n), *[b.column(n + j).to_pylist() for j in range(3)])):
                if key != now:
                    now, spent, count = key, 0, 0
                if least is None or spent + least > budget or count == top:
                    continue
                sizes = b.column(n + 3)[k].as_py()
                if spent + total <= budget and (top is None or count + len(sizes) <= top):
                    where = [i for i, s in enumerate(sizes) if s is not None]
                    paid = (spent + np.cumsum([sizes[i] for i in where], dtype=np.int64)).tolist()
                    spent = paid[-1]
                else:
                    where, paid = [], []
                    for i, s in enumerate(sizes):
                        if s is not None and spent + s <= budget and (top is None or count + len(where) < top):
                            spent += s
                            where.append(i)
                            paid.append(spent)
                count += len(where)
                at += [first + i for i in where]
                sums += paid
            yield pa.RecordBatch.from_pydict({"_at": pa.array(at, pa.int64()), "spent": pa.array(sums, pa.int64())})

    return run


def greedy(rows: DataFrame, group: list[str], order: list[str | Column], size: str, budget: int, top: int | None = None, free: str | None = None) -> DataFrame:
    """rows with `taken` and `spent` (after the row; null where it isn't taken), each group walked in its order; `top` rows of a group at most.

    A null size is never taken. `free`: a boolean column of rows that are passed over at no cost. Rows equal in group and order are walked
    in any order, the same for all of them. The sorted rows are written to the shared folder once.
    """
    spark = rows.sparkSession
    cost = F.col(size).cast("long")
    cost = F.when(~F.coalesce(F.col(free), F.lit(False)), cost) if free else cost
    at = f"{shared_folder(spark)}/sparkloom-{spark.sparkContext.applicationId}-ranking-{uuid.uuid4().hex}"
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_own")
    ranked = rows.orderBy(*group, *order).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.monotonically_increasing_id().alias("_at"), cost.alias("_cost"), own)
    ranked.write.parquet(at)
    held = spark.read.schema(ranked.schema).parquet(at)
    keys = [f"_g{i}" for i in range(len(group))]
    schema = T.StructType([*[T.StructField(c, held.schema[c].dataType) for c in keys], *_FACTS])
    # within a file rows are in order; files are read whole or in splits that keep it
    blocks = held.select(*keys, "_at", "_cost").mapInArrow(_packed(len(group), to_arrow_schema(schema)), schema)
    walk = blocks.repartition(*keys) if keys else blocks.coalesce(1)
    picks = walk.sortWithinPartitions(*keys, "_first").mapInArrow(_walked(len(group), budget, top), "_at long, spent long")
    out = held.select("_at", "_own").join(picks, "_at", "left")
    return out.select("_own.*", F.col("spent").isNotNull().alias("taken"), "spent")


def pick(ranked: DataFrame, score: str, key: str, size: str, budget: int, top: int) -> list[dict]:
    """The picks, `top` at most, of the same walk over one ranking (score descending, then key) of any length, in order."""
    picks = greedy(ranked, [], [F.desc(score), F.asc(key)], size, budget, top).where("taken").drop("taken").collect()
    for by, down in ((key, False), (score, True), ("spent", False)):  # rows of no size share what is spent
        picks.sort(key=lambda r: r[by], reverse=down)
    return [{k: v for k, v in r.asDict().items() if k != "spent"} for r in picks]
