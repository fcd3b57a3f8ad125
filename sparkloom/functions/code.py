"""Text operators whose semantics need a scan: masking and symbol slices. Arrow-batched where they run in a query."""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .content import INDENTED_SUFFIXES

# Strings keep their quotes, comments keep nothing; line ends stay, so that lines keep their numbers.
_BRACED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<q>["'`])(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z)""", re.S)
_HASHED = re.compile(r"""(?P<c>\#[^\n]*)|(?P<q>["'])(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z)""", re.S)
_STRING_PART = re.compile(r"\\.|\\\Z|[^\n]", re.S)
_NOT_NEWLINE = re.compile(r"[^\n]")

# Words that declare a symbol, what an arrow function's and a method's declaration look like (NAME is the symbol's), operators
# after which a line goes on.
_MODIFIERS = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:public\s+|private\s+|protected\s+|static\s+|final\s+)*"
_DECLARERS = r"(?:function|class|interface|type|enum|struct|trait|impl|module|namespace|def|fn|func|const|let|var)"
_ARROW = r"NAME\s*[:=]\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"
_METHOD = r"NAME\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::[^={]+)?\{"
_GOES_ON = re.compile(r"[=,(\[{|&+\-.<]\s*$")
#: Lines after a declaration in which its brace may open; lines that a declaration without one may take.
OPENS_WITHIN, CONTINUES_WITHIN = 8, 40


def is_indented(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in INDENTED_SUFFIXES


def _blank_string(quoted: str) -> str:
    quote = quoted[0]
    closed = len(quoted) > 1 and quoted.endswith(quote) and not (len(quoted) - len(quoted[:-1].rstrip("\\")) - 1) % 2
    inner = quoted[1 : -1 if closed else None]
    return quote + _STRING_PART.sub(lambda m: " " * len(m[0]) if len(m[0]) > 1 else " ", inner) + (quote if closed else "")


def mask(text: str, path: str) -> str:
    """The text with the contents of strings and comments blanked, as the path's language family writes them."""
    if is_indented(path):
        return _HASHED.sub(lambda m: "" if m["c"] else _blank_string(m[0]), text)
    return _BRACED.sub(lambda m: _blank_string(m[0]) if m["q"] else _NOT_NEWLINE.sub(" ", m[0]), text)


def _indent(line: str) -> int:
    return len(re.match(r"[ \t]*", line)[0].replace("\t", "    "))


def _indented_end(lines: list[str], at: int) -> int:
    base, end = _indent(lines[at]), at
    for j, line in enumerate(lines[at + 1 :], at + 1):
        if line.strip():
            if _indent(line) <= base:
                break
            end = j
    return end


def _goes_on(line: str) -> bool:
    return line.count("(") > line.count(")") or line.count("[") > line.count("]") or bool(_GOES_ON.search(line))


def _braced_end(lines: list[str], at: int) -> int:
    opening = None
    for j in range(at, min(len(lines), at + OPENS_WITHIN)):
        if "{" in lines[j]:
            opening = j
            break
        if re.search(r";\s*$", lines[j]):
            return j
    if opening is None:
        ahead = range(at, min(len(lines) - 1, at + CONTINUES_WITHIN))
        return next((j for j in ahead if not _goes_on(lines[j])), ahead.stop)
    depths = accumulate(line.count("{") - line.count("}") for line in lines[opening:])
    return next((j for j, depth in enumerate(depths, opening) if depth <= 0), len(lines) - 1)


def find_symbol(text: str, name: str, path: str) -> tuple[str, int, int] | None:
    """(text, first line, last line) of the first declaration of name, counted from 1; None without one."""
    forms = "|".join([rf"{_MODIFIERS}{_DECLARERS}\s+NAME\b", _ARROW, _METHOD])
    declares = re.compile(rf"(?:^|[^\w$])(?:{forms})".replace("NAME", re.escape(name)), re.A)
    masked = mask(text, path).split("\n")
    at = next((i for i, line in enumerate(masked) if declares.search(line)), None)
    if at is None:
        return None
    end = _indented_end(masked, at) if is_indented(path) else _braced_end(masked, at)
    return "\n".join(text.split("\n")[at : end + 1]), at + 1, end + 1


_SLICE = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_SLICE)
def _symbols(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, names, paths in batches:
        found = [find_symbol(t, n, p) if isinstance(t, str) else None for t, n, p in zip(texts, names, paths)]
        yield pd.DataFrame([f or (None, None, None) for f in found], columns=["text", "start", "end"]).astype({"start": "Int32", "end": "Int32"})


def symbol_slice(content: Column, name: Column, path: Column) -> Column:
    """struct(text, start, end) of a symbol's declaration, nulls where there is none."""
    return _symbols(content, name, path)


def token_counter(ranks_file: str, pattern: str):
    """A column function that counts real tokens with a byte-level vocabulary file; its path is a parameter."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(x)) if isinstance(x, str) else None for x in s], dtype="Int64")

    return count
