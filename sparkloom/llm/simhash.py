"""SimHash near-duplicates, linked through a pigeonring filter.

Fingerprints are 64-bit SimHashes over word shingles hashed with XXH64. The 64 bits lie on a ring of five segments. Two
fingerprints that differ in at most two bits leave a chain of consecutive segments, beginning at some segment i, whose
cumulative differences stay within the proportional budgets 2*l/5 for every length l: that is 0, 0, 1, 1, 2. So segments i and
i+1 agree, and of i+2 and i+3 at most one bit differs, hence one of them agrees too. Ten keys (five starts, two choices of
the third clean segment, 38 or 39 bits each) therefore reach every link. Pairs met under a key must pass the whole chain's
budgets before the full Hamming check.

Only distinct fingerprints are linked; copies follow their fingerprint. A key with few fingerprints is joined with itself. A
key with many takes a way that is linear in its size: within a key only the 25 or 26 free bits differ, and two
fingerprints are within two bits exactly if flipping at most one free bit in each can make them equal; each is hung on the
smallest fingerprint that shares such a value. Both ways are exact and neither emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back
from .components import connected_components

#: Bit widths of the ring's segments, from the lowest bit.
WIDTHS = (13, 13, 13, 13, 12)
#: Largest key that is joined with itself; beyond it the linear way is cheaper.
PAIR_LIMIT = 32
#: Shingles hashed at once, so that a very long text needs bounded memory.
BLOCK = 1 << 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment_masks() -> list[int]:
    masks, low = [], 0
    for w in WIDTHS:
        masks.append(((1 << w) - 1) << low)
        low += w
    return masks


SEGMENTS = _segment_masks()
#: (start segment, mask of the three clean segments) of each key.
KEYS = [(i, SEGMENTS[i] | SEGMENTS[(i + 1) % 5] | SEGMENTS[(i + j) % 5]) for i in range(5) for j in (2, 3)]


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; zero without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    total = max(1, n - shingle + 1)
    counts = np.zeros((8, 8), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        end = min(total, at + BLOCK)
        if n <= shingle:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[at + k : end + k] for k in range(shingle))))
        h = np.fromiter((digest(g, seed) for g in grams), dtype="<u8", count=end - at).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(h[:, k], minlength=256) @ _BYTE_BITS
    bits = (2 * counts > total).reshape(64)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs -> (id, fp): one row per document, fp the SimHash as a signed long. Null text counts as no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[id_col, "fp"])
        give_back()

    schema = f"{id_col} long, fp long"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, schema)


def links(classes: DataFrame) -> DataFrame:
    """classes(fp, rep), one row per distinct fingerprint -> edges(u, v) between representatives that reach every link."""
    spark = classes.sparkSession
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (_, m) in enumerate(KEYS)])
    rows = classes.select("fp", "rep", F.explode(keys).alias("x")).select("fp", "rep", "x.k", "x.key")
    size = rows.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(rows.join(size, ["k", "key"]), "simhash-keys")

    small = met.where(F.col("n") <= PAIR_LIMIT)
    a = small.select("k", "key", F.col("fp").alias("fa"), F.col("rep").alias("u"))
    b = small.select("k", "key", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    pairs = a.join(b, ["k", "key"]).where("u < v").withColumn("x", F.col("fa").bitwiseXOR(F.col("fb")))
    chain = F.lit(False)
    for start in range(5):
        ok, reach = F.lit(True), 0
        for length in range(1, 6):
            reach |= SEGMENTS[(start + length - 1) % 5]
            ok = ok & (F.bit_count(F.col("x").bitwiseAND(F.lit(_signed(reach)))) <= 2 * length // 5)
        chain = chain | (F.col("k").isin(2 * start, 2 * start + 1) & ok)
    near = pairs.where(chain).where(F.bit_count("x") <= 2).select("u", "v")

    flips = []
    for _, m in KEYS:
        free = [F.lit(0).cast("long")] + [F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]
        flips.append(F.array(*free))
    wide = met.where(F.col("n") > PAIR_LIMIT)
    flip = F.element_at(F.array(*flips), F.col("k") + 1)
    marks = wide.select("k", "rep", "fp", F.explode(flip).alias("bit")).select("k", "rep", F.col("fp").bitwiseXOR(F.col("bit")).alias("mark"))
    least = marks.groupBy("k", "mark").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    hung = marks.join(least, ["k", "mark"]).where("rep <> u").select("u", F.col("rep").alias("v"))
    return near.unionByName(hung)


def near_pairs(docs: DataFrame, without: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs -> pairs (u, v) of long ids, u < v, that reach every link of at most two differing bits; ids beyond longs and those in without(id) take
    no part."""
    largest = F.lit((1 << 63) - 1)
    fps = cut(fingerprints(docs.where(F.col(id_col) <= largest), id_col, text_col, shingle), "simhash-fp")
    if without is not None:
        fps = fps.join(without.select(F.col(id_col).try_cast("long").alias(id_col)), id_col, "left_anti")  # others are in neither
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("rep"))
    same = fps.join(classes, "fp").where(F.col(id_col) > F.col("rep")).select(F.col("rep").alias("u"), F.col(id_col).alias("v"))
    found = links(classes).select("u", "v").unionByName(same).distinct()
    kind = docs.schema[id_col].dataType
    return found.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs -> (id, fp, fingerprint, component_id): every input row with its class of near-duplicates.

    Class: the smallest id reachable over links of at most two differing bits. Null or wordless texts have fingerprint zero
    and link like any other. Repeated rows stay repeated. Null ids get a null class if nothing else shares their fingerprint.
    Other columns of docs are not looked at. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("rep"))
    # a fingerprint of which every id is null has no representative and takes no part in links
    known = classes.where("rep is not null")
    comp = connected_components(links(known)).withColumnRenamed("node", "rep")
    named = classes.join(comp, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
