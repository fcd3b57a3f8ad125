"""Packing into training windows by lexical retrieval (after Staniszewski et al., 2023).

Documents become token ids; the lexical terms are the ids themselves, so corpus statistics have at most one row per vocabulary
entry. Each document is routed by its heaviest BM25 term to a shard of bounded size (a term with more tokens than a
shard holds is spread over several), which brings lexical neighbours together. In a shard, an inverted index with BM25 weights
(document frequencies of the whole corpus) ranks all unused documents that share a term with a seed document, asked with all of its
terms; they fill the seed's window greedily, best first, until it is full or none is left. Then the next unused document is a
seed in the same window. A document that the window's end cuts goes on in the next window and is its seed, so every window but
a shard's last is full. All ids are placed, each once.

Neighbours are looked for in the seed's own shard: the greedy fill needs one owner of what is unused.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from sys import maxunicode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back, new_folder

WINDOW, END_ID = 2048, 1
#: Tokens that a shard holds, about; neighbours that are put in order at a time.
SHARD_TOKENS, FETCH = 1_000_000, 16
#: Weights that a shard's index holds as a table of terms by documents; larger ones are held as lists.
TABLE = 1 << 22
K1, B = 1.2, 0.75


class Table(dict):
    """Remembers a function's values for keys up to LONG characters, REMEMBERED at most; a full table is emptied."""

    LONG, REMEMBERED = 48, 1_000_000

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        self.remember(key, value)
        return value

    def remember(self, key, value) -> None:
        if len(key) <= self.LONG:
            if len(self) >= self.REMEMBERED:
                self.clear()
            self[key] = value


class Coder:
    """Ids of whole texts by a byte-level BPE tokenizer, which works each distinct word out once.

    No token and no special token reaches over a space or a line's end that follows a character that is no white space, and nothing
    before such a place depends on what follows it: texts are cut there. A word of Latin letters is one stretch to the
    tokenizer, with the space before it; its merges are asked for directly. All else goes through the whole tokenizer.
    """

    LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+")
    MARKS = ".,;:!?#*$%&|<>"
    CUT, UNEVEN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s\s")
    #: Characters of texts that are looked at together; words that are kept from task to task, of each table.
    TOGETHER, KEPT = 8 << 20, 150_000

    def __init__(self, tokenizer_file: str):
        # a task has one core: the library's own threads would take those of others
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.merges = self.tokenizer.model
        # how the tokenizer writes bytes down as characters, learnt from the tokenizer
        written = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {c: "".join(x for x, _ in written(c)) for c in [" ", *map(chr, range(0x41, 0x2B0))] if c == " " or self.LETTERS.fullmatch(c)}
        self.mark = Table(self._marks)
        blank = "".join(c for c in map(chr, range(maxunicode + 1)) if c.isspace())
        self.uneven = f"[{blank}][{blank}]"
        self.line = self._whole("\n")
        self.stretch, self.first, self.spaced = Table(self._whole), Table(self._first), Table(self._spaced)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _word(self, lead: str, word: str, table: Table) -> bytes:
        letters = word.rstrip(self.MARKS)
        if letters != word:
            if letters and letters[-1] in self.letters and (ids := self.mark[word[len(letters) :]]) is not None and self.LETTERS.fullmatch(letters):
                return table[letters] + ids
        elif self.LETTERS.fullmatch(word):
            return self._letters("".join(map(self.letters.__getitem__, lead + word)))
        return self._whole(lead + word)

    def _letters(self, written: str) -> bytes:
        return array("H", [t.id for t in self.merges.tokenize(written)]).tobytes()

    def _marks(self, marks: str) -> bytes | None:
        """Ids of marks after letters, if the tokenizer parts them from these as one stretch."""
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + marks)
        return self._whole(marks) if len(parts) == 2 and parts[0][1] == (0, 1) else None

    def _first(self, word: str) -> bytes:
        return self._word("", word, self.first)

    def _spaced(self, word: str) -> bytes:
        return self._word(" ", word, self.spaced)

    def forget(self) -> None:
        """Empty the tables but for the words that were met first, mostly the commonest: a worker lives on, and so would they."""
        for table in (self.stretch, self.first, self.spaced):
            kept = [*islice(table.items(), self.KEPT)]
            table.clear()
            table.update(kept)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 16-bit numbers."""
        if self.UNEVEN.search(text):
            return b"".join(map(self.stretch.__getitem__, self.CUT.split(text)))
        out = []
        for line in text.split("\n"):
            first, *words = line.split(" ")
            out += (self.line, self.first[first])
            out += map(self.spaced.__getitem__, words)
        return b"".join(out[1:])


    def _units(self, units: list[str]) -> pa.Array:
        """Ids of words as they follow a space or, with a line's end before them, a line's end."""
        found, space = list(map(self.spaced.get, units)), self.letters[" "]
        for k, ids in enumerate(found):
            if ids is None:
                u = units[k]
                if u.isascii() and u.isalpha():  # letters of ASCII are written as themselves
                    found[k] = ids = self._letters(space + u)
                    self.spaced.remember(u, ids)
                else:
                    found[k] = self.line + self.first[u[1:]] if u[:1] == "\n" else self.spaced[u]
        return pa.array(found, type=pa.binary())

    def _together(self, texts: pa.Array) -> list[bytes]:
        """encode() of texts without white space in a row: each distinct word is looked up once, by its place among them."""
        # one character begins each unit but those that follow a space
        lines = pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n"), "\n")
        parts = pc.split_pattern(lines, " ")
        words = parts.flatten().dictionary_encode()
        ids = self._units(words.dictionary.to_numpy(zero_copy_only=False).tolist()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[np.asarray(parts.offsets)].tolist()
        flat = ids.buffers()[2].to_pybytes()
        return [flat[a + len(self.line) : b] for a, b in zip(ends, ends[1:])]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of many texts; nulls as empty."""
        texts = pc.fill_null(texts, "")
        out: list[bytes] = []
        size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.TOGETHER, side="right")))
            some = texts.slice(at, end - at)
            uneven = pc.match_substring_regex(some, self.uneven)
            even = iter(self._together(some.filter(pc.invert(uneven))) if not pc.all(uneven).as_py() else [])
            out += [self.encode(some[k].as_py()) if odd else next(even) for k, odd in enumerate(uneven.to_pylist())]
            at = end
        return out


@lru_cache(maxsize=2)
def coder(tokenizer_file: str) -> Coder:
    return Coder(tokenizer_file)


def tokenize(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, ids, n): ids as little-endian unsigned 16-bit numbers, the end id last. Null text: as empty.

    Ids are those of `tokenizers` for the whole text, without special tokens added.
    """
    end = END_ID.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer_file)
        for b in batches:
            ids = [x + end for x in c.encode_all(b.column(1))]
            n = [len(x) // 2 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.binary()), pa.array(n, type=pa.int64())], names=["_id", "ids", "n"])
        c.forget()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(run, "_id long, ids binary, n long")


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts; the end id is no term."""
    s = np.sort(ids[:-1], kind="stable")
    if not len(s):
        return s.astype(np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at].astype(np.int64), np.diff(np.append(at, len(s)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << 16, dtype=np.int64), 0
    for b in batches:
        for raw in b.column(0).to_pylist():
            terms, _ = _terms(np.frombuffer(raw, dtype="<u2"))
            df[terms] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "df"])


def _weights(counts: np.ndarray, length: int, mean: float) -> np.ndarray:
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / mean))


def _head_term(idf, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = []
            for raw in b.column(1).to_pylist():
                terms, counts = _terms(np.frombuffer(raw, dtype="<u2"))
                w = idf.value[terms] * _weights(counts, len(raw) // 2, mean)
                head.append(int(terms[np.argmax(w)]) if len(terms) else -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, type=pa.int64())], names=["_id", "ids", "n", "row", "head"])

    return run


class Index:
    """Inverted index of one shard with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, weights, owner, self.queries = [], [], [], []
        for k, ids in enumerate(docs):
            t, c = _terms(ids)
            terms.append(t.astype(np.uint16))
            weights.append(idf[t] * _weights(c, len(ids), mean))
            owner.append(np.full(len(t), k, dtype=np.int64))
            self.queries.append(terms[-1])
        t = np.concatenate(terms) if terms else np.zeros(0, dtype=np.uint16)
        order = np.argsort(t, kind="stable")
        self.owner = np.concatenate(owner)[order] if terms else np.zeros(0, dtype=np.int64)
        self.weight = np.concatenate(weights)[order] if terms else np.zeros(0)
        start = np.searchsorted(t[order], np.arange((1 << 16) + 1))
        # a term of one document finds no other
        shared = np.diff(start) > 1
        self.spans = [slice(a, b) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        self.queries = [own[shared[own]] for own in self.queries]
        self.n = len(docs)
        self.table = None
        if int(shared.sum()) * self.n <= TABLE:
            row = np.cumsum(shared) - 1
            held = shared[t[order]]
            self.table = np.zeros((int(shared.sum()), self.n))
            self.table[row[t[order][held]], self.owner[held]] = self.weight[held]
            self.queries = [row[own] for own in self.queries]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of the shard's documents for all terms of the seed that another document holds too."""
        if self.table is not None:  # rows are added in the order of terms, as below
            return self.table[self.queries[seed]].sum(axis=0)
        spans = [self.spans[t] for t in self.queries[seed].tolist()]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.owner[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Documents that share a term with the seed and are unused now, best first, all of them; ties to the earlier document."""
        score = self.scores(seed)
        score[~unused] = 0
        some = np.flatnonzero(score > 0)
        if len(some) > FETCH:  # mostly few are wanted: only those are put in order
            least = np.partition(score[some], len(some) - FETCH)[len(some) - FETCH]
            first, some = some[score[some] >= least], some[score[some] < least]
            yield from first[np.lexsort((first, -score[first]))].tolist()
        yield from some[np.lexsort((some, -score[some]))].tolist()


def fill(lengths: list[int], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window number, offset) that place every token of the shard's documents."""
    unused = np.ones(len(lengths), dtype=bool)
    pieces, number, offset, order = [], 0, 0, 0
    near: Iterator[int] = iter(())
    for _ in lengths:
        # the neighbours of the window's seed are used up or there is no seed: the next document is one
        doc = next(near, None) if offset < window else None
        if offset == window:
            number, offset = number + 1, 0
        seed = doc is None
        if seed:
            while not unused[order]:
                order += 1
            doc = order
        unused[doc] = False
        start = 0
        while start < lengths[doc]:
            if offset == window:
                # the window is full: what is left of this document seeds the next
                number, offset, seed = number + 1, 0, True
            take = min(window - offset, lengths[doc] - start)
            pieces.append((doc, start, take, number, offset))
            start, offset = start + take, offset + take
        if seed:
            near = index.neighbours(doc, unused)
    return pieces


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs -> (id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every document's ids.

    ids: the piece's own, as little-endian unsigned 32-bit numbers. A sequence's pieces lie gaplessly from offset 0; its length is
    `window` except for the last of a shard. Null or empty text: one piece with the end id alone. Repeated rows are placed once
    each, wherever their shard is; ids may be null. An empty table gives no pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    # the row's number is written down: rows that repeat each other are told apart by it, whichever task reads them
    tokenize(docs, tokenizer_file, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    coded = spark.read.schema("_id long, ids binary, n long, row long").parquet(path)

    stats = coded.select("ids").mapInArrow(_count_terms, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row per vocabulary entry
    df = np.zeros(1 << 16)
    term, counts = np.asarray(stats.column("term")), np.asarray(stats.column("df"))
    df[term[term >= 0]] = counts[term >= 0]
    n_docs = int(counts[term < 0].sum())
    mean = max(1.0, float(coded.agg(F.sum("n")).first()[0] or 0) / max(1, n_docs))
    idf = spark.sparkContext.broadcast(np.log(1 + (n_docs - df + 0.5) / (df + 0.5)))

    headed = coded.mapInArrow(_head_term(idf, mean), "_id long, ids binary, n long, row long, head long")
    size = {r["head"]: r["n"] for r in headed.groupBy("head").agg(F.sum("n").alias("n")).collect()}  # a row per vocabulary entry
    first, spread, shard, room = {}, {}, 0, shard_tokens
    for head in sorted(size):
        if size[head] > shard_tokens:  # shards of its own
            shard += room < shard_tokens
            spread[head] = -(-size[head] // shard_tokens)
            first[head] = shard
            shard, room = shard + spread[head], shard_tokens
        else:
            if size[head] > room:
                shard, room = shard + 1, shard_tokens
            first[head], spread[head] = shard, 1
            room -= size[head]
    table = spark.createDataFrame([(h, first[h], spread[h]) for h in first], "head long, first long, spread long")
    routed = headed.join(F.broadcast(table), "head").select((F.col("first") + F.pmod(F.xxhash64("row"), "spread")).alias("shard"), "_id", "ids", "row")

    def run(part: pa.Table) -> pa.Table:
        ids = np.asarray(part.column("_id").fill_null(-(1 << 63)))
        order = np.lexsort((np.asarray(part.column("row")), ids)).tolist()
        raw = part.column("ids").to_pylist()
        coded_ids = [np.frombuffer(raw[k], dtype="<u2") for k in order]
        pieces = fill([len(x) for x in coded_ids], Index(coded_ids, idf.value, mean), window)
        base = part.column("shard")[0].as_py() << 32
        at = pa.array([order[d] for d, *_ in pieces], type=pa.int64())
        cols = list(zip(*pieces))
        out = pa.table({
            "_id": part.column("_id").take(at), "start": pa.array(cols[1], type=pa.int64()), "length": pa.array(cols[2], type=pa.int64()),
            "piece": pa.array([coded_ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces], type=pa.binary()),
            "doc_tokens": pa.array([len(coded_ids[d]) for d in cols[0]], type=pa.int64()), "sequence_id": pa.array([base + k for k in cols[3]], type=pa.int64()), "offset": pa.array(cols[4], type=pa.int64()),
        })
        give_back()
        return out

    schema = "_id long, start long, length long, piece binary, doc_tokens long, sequence_id long, offset long"
    return routed.groupBy("shard").applyInArrow(run, schema).withColumnsRenamed({"_id": id_col, "piece": "ids"})


def digests(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pack's pieces with ids_crc32 in place of the ids."""
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
