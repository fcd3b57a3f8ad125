"""SentencePiece BPE encoding by a prefix table, and decoding.

A prefix of a text has exactly one encoding, and so exactly one last token. The table holds that token for every prefix: of the
pieces that an Aho-Corasick automaton finds to end at a position, it is the one that is compatible with the last token
of the prefix before it. Two tokens are compatible if the merge rules, run over their joint characters, give just these two
(tests are remembered). The ids are then read off backwards from the last prefix. Every position is visited once, however
long a text is.

Pieces never join a space mark to what stands before it, nor cross a character that no piece holds, so a text is cut there and
a stretch's ids are remembered for its next occurrence, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Stretches and pairs that a worker remembers at most, and characters of a stretch that it remembers; a full table is emptied.
REMEMBERED, LONG = 300_000, 64


class Table(dict):
    """Remembers a function's values, REMEMBERED at most, and none for texts over LONG characters."""

    def __init__(self, function, most: int | None = None):
        super().__init__()
        self.function, self.most = function, most or REMEMBERED

    def __missing__(self, key):
        value = self.function(key)
        if isinstance(key, str) and len(key) > LONG:
            return value
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        joined = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            raise ValueError("a piece joins a space mark to what stands before it")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # a line's end is cut at in encode()
        if any("\n" in p for p in joined):
            raise ValueError("a piece joins a line's end to other characters")
        #: Characters that some piece holds with others, and the pairs of characters that some piece holds side by side.
        self.inner = {c for p in joined for c in p}
        self.side = {p[i : i + 2] for p in joined for i in range(len(p) - 1)}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.tokens: list[str] = []
        self.own: list[bytes] = []
        automaton = ahocorasick.Automaton()
        for p in [*self.inner, *joined]:
            if len(p) == 1 or self.merge(p) == [p]:
                automaton.add_word(p, (len(self.tokens), len(p)))
                self.tokens.append(p)
                self.own.append(self._ids(p))
        automaton.make_automaton()
        self.automaton = automaton
        #: Whether two tokens (one number: first << 16 | second) stay apart.
        self.pair = Table(self._apart, 1_000_000)
        self.run = Table(self._run)
        self.chunk = Table(self.stretch_of)
        self.word = Table(lambda w: self.stretch_of(SPACE + w))
        self.newline = self.stretch_of("\n")

    def merge(self, text: str) -> list[str]:
        """The merge rules over a few characters: the best-ranked adjacent pair is joined first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, i = min(ranked)
            if best == np.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _apart(self, pair: int) -> bool:
        a, b = self.tokens[pair >> 16], self.tokens[pair & 0xFFFF]
        return self.merge(a + b) == [a, b]

    def _ids(self, token: str) -> bytes:
        found = self.ids.get(token)
        return np.array([found] if found is not None else [self.bytes[b] for b in token.encode()], dtype="<u4").tobytes()

    def _run(self, text: str) -> bytes:
        """Ids of characters that pieces may join, as little-endian 32-bit numbers, by the prefix table."""
        if len(text) == 1 and text not in self.inner:
            return self._ids(text)
        last, pair = [-1] * (len(text) + 1), self.pair
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = end - size
                if not before or (last[before] >= 0 and pair[last[before] << 16 | token]):
                    last[end] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(self.own[token])
            at -= len(self.tokens[token])
        out.reverse()
        return b"".join(out)

    def stretch_of(self, chunk: str) -> bytes:
        """Ids of any characters: cut wherever no piece holds the two characters side by side."""
        side, out, start = self.side, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in side:
                out.append(self.run[chunk[start:i]])
                start = i
        if not start:
            return self._run(chunk) if chunk else b""
        out.append(self.run[chunk[start:]])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids with the begin and end ids, as little-endian unsigned 32-bit numbers."""
        out = [self.bos.to_bytes(4, "little")]
        if not text:
            pass
        elif text[0] == " " or "  " in text or SPACE in text:
            out += map(self.chunk.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))[:-1])
        else:
            # single spaces only: what stands between two of them is encoded with the mark before it; lines end by a token of their own
            lines = text.split("\n")
            out += map(self.word.__getitem__, lines[0].split(" "))
            for line in lines[1:]:
                words = line.split(" ")
                out.append(self.newline)
                out.append(self.chunk[words[0]])
                out += map(self.word.__getitem__, words[1:])
        out.append(self.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, ids): ids as the sentencepiece library gives them, with the begin and end ids. Null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            ids = [np.frombuffer(c.encode(t or ""), dtype="<i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) -> (id, text). Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} long, text string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, n_tokens, ids_sha256, decoded_sha256): a round trip through encode and decode, one row per input row.

    Null text: as empty. Repeated rows stay repeated; null ids stay null. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                raw = c.encode(t or "")
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(np.frombuffer(raw, dtype="<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
