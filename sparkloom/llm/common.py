"""Helpers shared by the training-data operators: table access, shared storage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name under the shared folder, marked with the application."""
    return f"{shared_folder(spark)}/sparkloom-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    if _scratch:
        _scratch[-1].add(path)
    return table


_scratch: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stretch of work whose tables by cut() are deleted at its end, but for those handed to what this yields: the only ones that results may
    still read."""
    _scratch.append(set())
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_written[table])
        return table

    try:
        yield keep
    finally:
        made = _scratch.pop()
        for path in made - kept:
            delete(spark, path)
        if _scratch:
            _scratch[-1].update(kept)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table that cut() wrote and nothing reads any more."""
    delete(df.sparkSession, _written.pop(df))


def salted_join(rows: DataFrame, once: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """rows joined with once, which holds a key once at most: a key's rows are spread by another column, and once is repeated for that."""
    spread = once.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(spread, [key, "_salt"]).drop("_salt")


def give_back() -> None:
    """Hand free memory of this Python worker back to the system: workers live on between tasks, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps its memory
        pass


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; np.unique takes many times as long for 64-bit ones."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def crc_bucket(column: str, mod: int):
    """crc32 of an id written as text, modulo mod."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application left in the shared folder; those of others stay. Call it once no result that reads
    one is still to be computed."""
    for t in spark.catalog.listTables():
        if t.name.startswith("sparkloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        if entry.getPath().getName().startswith(f"sparkloom-{spark.sparkContext.applicationId}-"):
            fs.delete(entry.getPath(), True)
