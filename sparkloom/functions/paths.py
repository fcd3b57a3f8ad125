"""Path columns: keys, secret patterns, views, writers, repositories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and patterns of paths whose content is secret.
SECRET_NAMES = [".npmrc", ".netrc", ".pgpass", ".git-credentials", ".htpasswd", "credentials", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml"]
SECRET_FOLDERS = [".ssh", ".aws", ".gnupg", ".kube"]
SECRET_PATTERNS = [
    r"(^|/)\.env($|\.)",
    r"\.(pem|key|p12|pfx|keystore|jks|asc)$",
    r"(^|/)id_(rsa|dsa|ecdsa|ed25519)[^/]*$",
    r"secret[^/]*\.(json|ya?ml|toml|txt)$",
    r"credential",
]


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_key(path: Column, ignore_case: bool = False) -> Column:
    """Identity of a path: forward slashes, and lower case on file systems that ignore case."""
    return F.lower(slashed(path)) if ignore_case else slashed(path)


def glob_patterns(globs: str | None) -> list[str]:
    """Regular expressions for comma-separated globs in which * stands for anything but a slash."""
    out = []
    for glob in (globs or "").split(","):
        if glob := glob.strip():
            out.append("(^|/)" + "[^/]*".join(re.escape(part) for part in glob.split("*")) + "$")
    return out


def is_secret(path: Column, globs: str | None = None, real_path: Column | None = None) -> Column:
    """Whether content at the path (or at the path it links to) must not be kept. Null paths are not."""

    def by_name(p: Column) -> Column:
        parts = F.filter(F.split(F.lower(slashed(p)), "/"), lambda s: s != "")
        named = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).isin(SECRET_NAMES)
        inside = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SECRET_FOLDERS]))
        pattern = "(?i)" + "|".join(f"(?:{x})" for x in [*SECRET_PATTERNS, *glob_patterns(globs)])
        return named | inside | slashed(p).rlike(pattern)

    found = F.coalesce(by_name(path), F.lit(False))
    return found if real_path is None else found | F.coalesce(by_name(real_path), F.lit(False))


def mask_secret(events: DataFrame, excluded: Column) -> DataFrame:
    """Events whose path is secret keep their counts and lose everything that tells about content."""
    out = events.withColumn("excluded", excluded)
    for name, empty in (("hash", F.lit("")), ("bytes", F.lit(0)), ("approx_tokens", F.lit(0)), ("git_blob_sha1", F.lit(None)), ("base_hash", F.lit(None))):
        if name in events.columns:
            out = out.withColumn(name, F.when(F.col("excluded"), empty.cast(events.schema[name].dataType)).otherwise(F.col(name)))
    return out


def view_key(symbol: Column, lines: Column, total: Column) -> Column:
    """`full`, `sym:<name>`, or `lines:<a>-<b>` with the range clamped to the file; a range that can't be read is full."""
    a = F.regexp_extract(lines, r"^(\d+)\s*-\s*(\d+)$", 1)
    b = F.regexp_extract(lines, r"^(\d+)\s*-\s*(\d+)$", 2)
    start = F.greatest(F.lit(1), F.least(a.try_cast("long"), total))
    end = F.greatest(start, F.least(b.try_cast("long"), total))
    ranged = F.concat(F.lit("lines:"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(symbol.isNotNull(), F.concat(F.lit("sym:"), symbol)).when(a != "", ranged).otherwise("full")


def replay_view_key(offset: Column, limit: Column) -> Column:
    whole = offset.isNull() & limit.isNull()
    ranged = F.concat(F.lit("lines:"), F.coalesce(offset.cast("string"), F.lit("0")), F.lit("-"), F.coalesce(limit.cast("string"), F.lit("")))
    return F.when(whole, "full").otherwise(ranged)


def _safe(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def writer_key(sid: Column, agent: Column) -> Column:
    return F.concat(_safe(sid), F.lit("__"), _safe(F.coalesce(F.nullif(agent, F.lit("")), F.lit("main"))))


def safe_name(name: Column) -> Column:
    return _safe(name)


def agent_transcript(parent: Column, agent: Column) -> Column:
    """Where a sub-agent's transcript lies beside its parent's."""
    return F.concat(F.regexp_replace(parent, r"(?i)\.jsonl$", ""), F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))


def guard_state_key(sid: Column, agent: Column) -> Column:
    return F.when(agent.isNull() | (agent == ""), sid).otherwise(F.concat(sid, F.lit("-"), agent))


def short_id(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def ancestors(path: Column) -> Column:
    """Every folder above a path, the root last."""
    parts = F.split(slashed(path), "/")
    depth = F.size(parts)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), depth - 1)), lambda n: F.array_join(F.slice(parts, 1, depth - n), "/"))
    return F.transform(above, lambda p: F.when(p == "", "/").otherwise(p))


def attribute_repo(files: DataFrame, roots: DataFrame, path_col: str = "path", root_col: str = "root") -> DataFrame:
    """files with `repo`: the deepest of the roots above the path, else the first folder's root.

    Each path is joined on its own ancestors, so the join is an equality and never a scan of all roots.
    """
    above = files.select(path_col).distinct().withColumn("_folder", F.explode(ancestors(F.col(path_col))))
    found = above.join(roots.select(F.col(root_col).alias("_folder")).distinct(), "_folder")
    deepest = found.groupBy(path_col).agg(F.max_by("_folder", F.length("_folder")).alias("repo"))
    return files.join(deepest, path_col, "left").withColumn("repo", F.coalesce("repo", F.when(slashed(F.col(path_col)).startswith("/"), "/").otherwise(F.regexp_extract(slashed(F.col(path_col)), r"^([A-Za-z]:/|[^/]*)", 1))))
