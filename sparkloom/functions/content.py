"""Content columns: hashes, sizes, token estimates, lines, outlines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at, and the share of control bytes above which they are binary.
SNIFFED, CONTROL_SHARE = 8192, 0.3

# Patterns of lines that declare something.
DECLARATION = r"^\s*(export\s+)?(default\s+)?(public\s+|private\s+|protected\s+|static\s+|async\s+)*(function|class|interface|type|enum|struct|trait|impl|module|namespace|def|fn|func|val|var|let|const)\b"
ARROW = r"^\s*(export\s+)?(public\s+|private\s+|protected\s+|static\s+)*[A-Za-z_$][\w$]*\s*[:=]\s*(async\s*)?(\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"
METHOD = r"^\s*(public\s+|private\s+|protected\s+|static\s+|async\s+)*[A-Za-z_$][\w$]*\s*\([^)]*\)\s*(:\s*[\w<>\[\].,\s|&]+)?\s*\{"
INDENTED_SUFFIXES = [".py", ".pyi", ".pyw", ".coffee"]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def git_blob_sha1(content: Column) -> Column:
    """The id that git gives a blob of this content."""
    header = F.concat(F.encode(F.lit("blob "), "UTF-8"), F.encode(F.octet_length(content).cast("string"), "UTF-8"), F.lit(b"\x00"))
    return F.sha1(F.concat(header, F.encode(content, "UTF-8")))


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def utf16_length(content: Column) -> Column:
    return (F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("long")


def approx_tokens(content: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded up."""
    return F.ceil(utf16_length(content) / 4).cast("long")


def approx_tokens_of_size(size: Column) -> Column:
    return F.ceil(size / 4).cast("long")


def looks_binary(data: Column) -> Column:
    """A NUL, or too many control bytes, among the first bytes. Empty data is text."""
    head = F.substring(data, 1, SNIFFED)
    # a byte each as a Latin-1 character, so that control bytes can be counted by removal
    chars = F.decode(head, "ISO-8859-1")
    control = F.length(chars) - F.length(F.regexp_replace(chars, r"[\x01-\x08\x0e-\x1f]", ""))
    size = F.length(head)
    return F.when(size == 0, False).otherwise(F.contains(head, F.lit(b"\x00")) | (control / F.greatest(size, F.lit(1)) > CONTROL_SHARE))


def slice_lines(content: Column, first: Column, last: Column) -> Column:
    """struct(text, start, end): lines first to last, counted from 1, clamped to the text."""
    lines = F.split(content, "\n")
    start = F.greatest(F.lit(1), F.least(first, F.size(lines)))
    end = F.greatest(start, F.least(last, F.size(lines)))
    return F.struct(F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("text"), start.alias("start"), end.alias("end"))


def outline(content: Column) -> Column:
    """array(line, text): the lines that declare something, right-trimmed and cut to 200 characters."""
    numbered = F.transform(F.split(content, "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    declares = f"{DECLARATION}|{ARROW}|{METHOD}"
    kept = F.filter(numbered, lambda x: x["text"].rlike(declares))
    return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), F.substring(F.regexp_replace(x["text"], r"\s+$", ""), 1, 200).alias("text")))


def language_family(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(suffix.isin(INDENTED_SUFFIXES), "indent").otherwise("brace")


def quoted(name: str) -> str:
    """The name as a regular expression that matches it literally."""
    return re.escape(name)


def usd(tokens: Column, per_million: float = 3.0) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.4f", tokens / F.lit(1e6) * F.lit(per_million)))


def saved_percent(baseline: Column, sent: Column) -> Column:
    return F.when(baseline == 0, F.lit(0.0)).otherwise(F.round((baseline - sent) * 100.0 / baseline, 1))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def age_text(age_ms: Column) -> Column:
    """Seconds below two minutes, one at least; else minutes."""
    seconds = F.greatest(F.lit(1), half_up(age_ms / 1000)).cast("string")
    return F.when(age_ms < 120_000, F.concat(seconds, F.lit("s ago"))).otherwise(F.concat(half_up(age_ms / 60_000).cast("string"), F.lit("min ago")))


def staleness(hash_: Column, readable: Column, current: Column) -> Column:
    return (
        F.when(hash_ == "", "not archived (secret-pattern)")
        .when(~F.coalesce(readable, F.lit(False)), "missing on disk")
        .when(current == hash_, "current")
        .otherwise("CHANGED on disk since last seen")
    )
