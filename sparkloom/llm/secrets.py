"""Secret scans: fixed patterns, and novelty under a primed zstandard compressor.

The novelty scan looks at long runs of key characters that begin soon after a sensitive word. A run's marginal size is what it adds to a
zstandard frame whose dictionary is a list of common identifiers, those of the corpus, and the text around the run. Words,
paths, names and repeats of their surroundings compress to a few bytes; keys don't. A run is reported where its marginal bytes are at
least `NOVELTY` of its length and it mixes letters with digits.

The corpus's identifiers are the letter sequences inside such runs, wherever no sensitive word stands before them, that occur in
`COMMON_DOCS` documents or more, counted over all documents; the commonest of them fill the dictionary. Copies of a leaked key
can't teach the dictionary that key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import give_back

#: Fixed patterns; of assign, the value must have 6 characters; access is 20 characters at least, hex 24.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api[_-]?key|credential|bearer|private[_ -]?key|access[_ -]?key|authorization|signature", re.I | re.A)
SENSITIVE_WORDS = (*ASSIGN_WORDS, "pwd", "credential", "bearer", "private", "access", "authorization", "signature", "api-key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LETTERS = re.compile(r"[A-Za-z]{5,}")
#: Characters after a sensitive word in which a run may begin, characters around a run that prime the compressor.
REACH, AROUND = 64, 512
#: Size of the dictionary of the corpus's identifiers, documents that an identifier must stand in.
DICTIONARY_BYTES, COMMON_DOCS = 1 << 14, 5
#: Marginal bytes per character from which a run counts as incompressible: zstandard stores short unmatched runs as they are.
NOVELTY = 0.85
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 username password secret token access_key api_key client_id client_secret "
    "authorization bearer private_key public_key certificate configuration environment connection_string database repository organization "
    "application production development localhost endpoint https://www.example.com/index.html function return import export default "
    "aws prod staging cluster main master region us-east-1 eu-west-1 service account session request response header version release build "
    "undefined required optional description placeholder example changeme your-token-here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456"
).encode()


def marginal_bytes(run: str, before: str, after: str, identifiers: bytes = b"") -> int:
    """Bytes that the run adds to a frame primed with the identifiers and the text around it."""
    around = b"\n".join([identifiers, IDENTIFIERS, after.encode(), before.encode()])
    primed = zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(c.compress(run.encode())) - len(c.compress(b""))


def exposed(text: str) -> Iterator[tuple[int, int]]:
    """Runs that begin within REACH characters after a sensitive word, left to right, each once. Time is linear in the text."""
    upto = 0
    for word in SENSITIVE.finditer(text):
        last = word.end() + REACH
        at = max(upto, word.end())
        # a run that begins in reach shows its first 16 characters there; its end may lie anywhere
        while at <= last and (m := RUN.search(text, at, last + 16)):
            at = upto = RUN.match(text, m.start()).end()
            yield m.start(), at


def _novel(text: str, taken: list[tuple[int, int]], identifiers: bytes) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    taken, k, covered = sorted(taken), 0, 0
    for start, end in exposed(text):
        while k < len(taken) and taken[k][0] < end:
            covered = max(covered, taken[k][1])
            k += 1
        run = text[start:end]
        if covered > start or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        if marginal_bytes(run, text[max(0, start - AROUND) : start], text[end : end + AROUND], identifiers) >= NOVELTY * len(run):
            found.append((start, end))
    return found


def find(text: str, identifiers: bytes = b"") -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by start and then kind."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in SENSITIVE_WORDS):
        spans += [(a, 3, b) for a, b in _novel(text, [(a, b) for a, _, b in spans], identifiers)]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def identifiers(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_BYTES, common: int = COMMON_DOCS) -> bytes:
    """The commonest identifiers of all documents, the commonest last, `size` bytes at most. Ties to the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], names=["name", "n"])
            seen.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                low = text.lower()
                hidden = set(exposed(text)) if any(w in low for w in SENSITIVE_WORDS) else ()
                seen.update({x for m in RUN.finditer(text) if m.span() not in hidden for x in LETTERS.findall(m[0][:256])})
                if len(seen) > 500_000:
                    yield from out()
        yield from out()
        give_back()

    counts = docs.select(text_col).mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= common)
    rows = counts.orderBy(F.desc("n"), "name").limit(size // 6).collect()  # a name and a space are 6 bytes at least
    names, room = [], size
    for r in rows:
        room -= len(r["name"]) + 1
        if room < 0:
            break
        names.append(r["name"])
    return " ".join(reversed(names)).encode()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: bool = False, known: bytes | None = None) -> DataFrame:
    """docs -> (id, *keep, spans[, redacted_text]): each input row with its spans, an array of (kind, start, end).

    known: the identifiers that prime the compressor; by default those of docs. Null text: as empty, no spans. Repeated rows stay
    repeated. `keep` names columns to pass through; others are not read.
    """
    names = identifiers(docs, text_col) if known is None else known
    fields = [StructField(id_col, docs.schema[id_col].dataType), *[docs.schema[c] for c in keep], StructField("spans", ArrayType(SPAN))]
    if redacted:
        fields.append(StructField("redacted_text", StringType()))
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            spans = [find(t, names) for t in texts]
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in spans]
            cols = [*b.columns[:-1], pa.array(rows, type=arrow.field("spans").type)]
            if redacted:
                cols.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], type=pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, spans) -> (id, n_assign, n_access, n_hex, base_sha256, spans): counts and texts of the spans."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "novel")
    return scanned.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )
