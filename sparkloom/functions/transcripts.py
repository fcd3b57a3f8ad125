"""What transcript lines say: touches, exact versions, marks of what was seen, landed edits.

Lines are JSON text; one that can't be parsed gives no rows and fails nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TRANSCRIPT_LINE
from .content import content_hash
from .paths import path_key

# Tools that read and change files, tools that the guard checks.
READS = ["Read"]
WRITES = ["Write"]
EDITS = ["Edit", "MultiEdit", "NotebookEdit"]
GUARDED = ["Edit", "MultiEdit", "Write"]
#: The word in the names of the reader's own tools, and the tag that begins what they show: the deployment's own.
TOOL_WORD, TAG = "reader", "context-reader"
PART_BREAK = "\n\n---\n\n"


def tool_op(name: Column) -> Column:
    return F.when(name.isin(READS), "read").when(name.isin(WRITES), "write").when(name.isin(EDITS), "edit")


def is_guarded(name: Column) -> Column:
    return name.isin(GUARDED)


def is_own_tool(name: Column, word: str = TOOL_WORD) -> Column:
    return name.rlike(rf"^mcp__[^_]*{re.escape(word)}[^_]*__")


def complete_read(file: Column) -> Column:
    """Whether a read result holds the whole file."""
    whole = F.coalesce(file["numLines"] == file["totalLines"], F.lit(True))
    return F.coalesce(file["filePath"].isNotNull() & file["content"].isNotNull() & F.coalesce(file["startLine"] == 1, F.lit(True)) & whole, F.lit(False))


def parsed(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """lines with `j` (the fields that are looked at), `ts` (its timestamp's milliseconds) and `ok` (whether it is an object)."""
    out = lines.withColumn("j", F.from_json(text_col, TRANSCRIPT_LINE))
    ms = F.expr("unix_millis(try_to_timestamp(j.timestamp))")
    return out.withColumn("ok", F.try_parse_json(text_col).isNotNull() & F.trim(text_col).startswith("{")).withColumn("ts", ms)


def _blocks(lines: DataFrame, keep: list[str]) -> DataFrame:
    return lines.where("ok").select(*keep, "ts", "j.timestamp", F.coalesce("j.isSidechain", F.lit(False)).alias("sidechain"), F.posexplode("j.message.content").alias("pos", "b"))


def touches(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., pos, path, op, sidechain, ts): file tools that a line calls. A missing timestamp is the first of 1970."""
    path = F.coalesce("b.input.file_path", "b.input.notebook_path")
    calls = _blocks(lines, keep).where("b.type = 'tool_use'").withColumn("op", tool_op(F.col("b.name"))).withColumn("path", path)
    calls = calls.where("op is not null and path <> ''")
    return calls.select(*keep, "pos", "path", "op", "sidechain", F.coalesce("timestamp", F.lit("1970-01-01T00:00:00.000Z")).alias("ts"))


def exact_versions(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., path, content, sidechain, ts): whole files that read results hold."""
    file = F.col("j.toolUseResult.file")
    whole = lines.where("ok").where(complete_read(file))
    return whole.select(*keep, file["filePath"].alias("path"), file["content"].alias("content"), F.coalesce("j.isSidechain", F.lit(False)).alias("sidechain"), F.coalesce("j.timestamp", F.lit("1970-01-01T00:00:00.000Z")).alias("ts"))


def rendered_paths(text: Column, tag: str = TAG) -> Column:
    """Paths that the reader's own output names: in the first three lines of each of its parts."""
    head = rf"^\[{re.escape(tag)}\] (.+?)(?: \((?:symbol|lines)[^)]*\))? (?:— full content|is byte-identical|changed since your last read)"
    heads = F.flatten(F.transform(F.split(text, PART_BREAK.replace("-", "\\-")), lambda part: F.slice(F.split(part, "\n"), 1, 3)))
    found = F.filter(F.transform(heads, lambda h: F.regexp_extract(h, head, 1)), lambda p: p != "")
    return F.when(text.startswith(f"[{tag}]"), found).otherwise(F.array().cast("array<string>"))


def seen_marks(lines: DataFrame, keep: list[str], word: str = TOOL_WORD, tag: str = TAG) -> DataFrame:
    """(keep..., pos, key, ts, hash): what each line proves to have been seen; a null hash: seen, but not as a whole.

    Results mark files; calls of file-changing tools never do. Lines without a timestamp prove nothing.
    """
    dated = lines.where("ok and ts is not null")
    tur = F.col("j.toolUseResult")
    file = tur["file"]
    path = F.when(file["filePath"].isNotNull(), file["filePath"]).when(tur["filePath"].isNotNull(), tur["filePath"])
    whole = F.when(complete_read(file), content_hash(file["content"])).when(file["filePath"].isNull() & tur["content"].isNotNull(), content_hash(tur["content"]))
    results = dated.select(*keep, F.lit(-1).alias("pos"), path.alias("path"), "ts", whole.alias("hash"))
    blocks = _blocks(dated, keep)
    given = F.array_compact(F.concat(F.array("b.input.path"), F.coalesce("b.input.paths", F.array()), F.coalesce("b.input.files", F.array())))
    asked = blocks.where("b.type = 'tool_use'").where(is_own_tool(F.col("b.name"), word)).select(*keep, "pos", F.explode(given).alias("path"), "ts")
    shown = blocks.where("b.type = 'tool_result'")
    # a result's content is a text, or an array of texts that from_json keeps as JSON
    inner = F.from_json("b.content", "array<struct<type: string, text: string>>")
    texts = F.coalesce(F.transform(F.filter(inner, lambda x: x["type"] == "text"), lambda x: x["text"]), F.array("b.content"))
    heads = shown.select(*keep, "pos", F.explode(texts).alias("text"), "ts").select(*keep, "pos", F.explode(rendered_paths(F.col("text"), tag)).alias("path"), "ts")
    named = asked.unionByName(heads).withColumn("hash", F.lit(None).cast("string"))
    return results.unionByName(named).where("path <> ''").select(*keep, "pos", path_key(F.col("path")).alias("key"), "ts", "hash")


def landed_edits(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., path, ts, hash): results of file-changing tools; the hash where the result holds the written content."""
    tur = F.col("j.toolUseResult")
    done = lines.where("ok and ts is not null").where(tur["file"].isNull() & tur["filePath"].isNotNull())
    return done.select(*keep, tur["filePath"].alias("path"), "ts", F.when(tur["content"].isNotNull(), content_hash(tur["content"])).alias("hash"))
