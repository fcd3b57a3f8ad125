r"""Quality rules over lines: cross-document line frequency per host, on DataFrame and SQL functions only.

A line is what stands between \n; its normal form has A-Z lower-cased, digits as 0 and white space runs as one space, ends
trimmed. Lines without a word don't count. A line is boilerplate where its normal form stands in more than `LIMIT` distinct documents
of one host (documents with the same text are one); it is removed. A document is depleted where more than half of its words went,
or fewer than `LEAST_WORDS` are left, and is rejected.

One pass over the texts writes each document's base counts and its lines' hashes and words. The count is over distinct (host, line,
document) before it is over (host, line), so no line is a hot key; the lines above the limit are few and come back by a join
on (host, line) that AQE splits where one line is in a large share of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LIMIT, LEAST_WORDS = 10, 10
WHITE = r"[\\x20\\x09-\\x0D]+"

#: Words of a text (SQL over _text), and what the base rules count.
_WORDS = f"filter(split(_text, '{WHITE}'), w -> w <> '')"
_LINES = f"filter(split(_text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
_DROP_WHITE = "translate(_text, ' \\t\\n\\u000b\\u000c\\r', '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL that works the value out once for all its uses in body."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def repeat_words(words: str = "_words", n: int = 5) -> str:
    """SQL: words of an array that stand in a window of n words found twice or more in it, each counted once.

    The windows' 64-bit hashes are sorted; only where two are equal are their places looked at. What a place adds is the
    distance to the next one, n at most.
    """
    hashes = f"transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(n))}))"
    same = "exists(sequence(1, size(s) - 1), k -> s[k] = s[k - 1])"
    placed = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    twice = "sort_array(transform(filter(transform(z, (e, k) -> struct(e.i as i, (k > 0 and get(z, k - 1).x = e.x) or coalesce(get(z, k + 1).x = e.x, false) as d)), e -> e.d), e -> e.i))"
    total = f"aggregate(transform(p, (x, k) -> least({n}, coalesce(get(p, k + 1) - x, {n}))), 0L, (a, b) -> a + b)"
    count = _let(placed, "z", _let(twice, "p", total))
    found = _let(hashes, "h", _let("sort_array(h)", "s", f"case when size(s) > 1 and {same} then {count} else 0L end"))
    return f"case when size({words}) > {n} then {found} else 0L end"


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lines (lines with a word) added."""
    d = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_words", F.expr(_WORDS)).withColumn("_lines", F.expr(_LINES))
    d = d.select(
        *[c for c in d.columns if c not in ("_words",)],
        F.size("_words").cast("long").alias("n_words"),
        F.expr(f"cast(length({_DROP_WHITE}) as long)").alias("word_chars"),
        F.expr("cast(length(_text) - length(translate(_text, '#*$%&|<>', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)").alias("n_dup_lines"),
        F.expr(repeat_words()).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("_text")


def _normal(line: str) -> str:
    lowered = f"translate({line}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"
    return f"trim(regexp_replace({lowered}, '{WHITE}', ' '))"


def line_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, least_words: int = LEAST_WORDS, cleaned: bool = False
) -> DataFrame:
    """docs -> (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words[, clean_text]): one row per row.

    n_line_words: words in removed lines. cleaned: with the text that is left, lines without a word included. Null text: as empty
    (no words, base_failed; an empty clean_text). A null host is a host of its own. Repeated rows are one document in the count
    and a row each in the result. Other columns are not read. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), F.col(host_col).isNull().alias("_none"), F.col(text_col).alias("_raw"))
    own = own.withColumn("_row", F.monotonically_increasing_id())
    line = f"struct(xxhash64({_normal('l')}) as hash, cast(size(filter(split(l, '{WHITE}'), w -> w <> '')) as long) as n)"
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    texts = ["_raw"] if cleaned else []
    base = base_rules(own, "_raw").select("_row", "_id", "_host", "_none", F.xxhash64("_raw").alias("_doc"), *columns, F.expr(f"transform(_lines, l -> {line})").alias("lines"), *texts)
    base = cut(base, "lines")

    once = base.select("_host", "_none", "_doc", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    common = once.groupBy("_host", "_none", "hash").agg(F.count_distinct("_doc").alias("n_docs")).where(F.col("n_docs") > limit).drop("n_docs")
    hit = base.select("_row", "_host", "_none", F.explode("lines").alias("line")).select("_row", "_host", "_none", "line.hash", "line.n").join(common, ["_host", "_none", "hash"])
    gone = hit.groupBy("_row").agg(F.sum("n").alias("n_line_words"), F.collect_set("hash").alias("_gone"))  # of the document's own lines
    done = base.join(gone, "_row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_line_words")
    kept = ~F.col("base_failed") & ~((2 * F.col("n_line_words") > F.col("n_words")) | (left < least_words))
    out = [F.col("_id").alias(id_col), *columns, kept.alias("kept"), "n_line_words"]
    if cleaned:
        # only where lines went is the text taken apart again; a line without a word is never among them
        words = "l rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
        rest = F.expr(f"array_join(filter(split(_raw, '\\n'), l -> not ({words} and array_contains(_gone, xxhash64({_normal('l')})))), '\\n')")
        out.append(F.when(F.col("_gone").isNull(), F.coalesce("_raw", F.lit(""))).otherwise(rest).alias("clean_text"))
    return done.select(*out)


def oracle(limit: int = LIMIT, least_words: int = LEAST_WORDS) -> str:
    """DuckDB SQL for line_quality over documents."""
    word = r"[^\x20\x09-\x0D]+"
    white = r"[\x20\x09-\x0D]+"
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, source from documents),
    w as (select r, regexp_extract_all(t, '{word}') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) as l from d),
    g as (select r, i, list_slice(w, i, i + 4) as g from (select r, w, unnest(range(1, len(w) - 3)) as i from w)),
    f as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
    p as (select r, sum(least(5, coalesce(nxt - i, 5))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from f) group by r),
    s as (select r, line, len(regexp_extract_all(line, '{word}')) as n,
          trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '{white}', ' ', 'g'), ' ') as k
          from (select r, unnest(l) as line from w)),
    c as (select source, k, count(distinct t) as n from s join d using (r) group by 1, 2 having count(distinct t) > {limit}),
    x as (select s.r, sum(s.n) as n from s join d using (r) join c on c.k = s.k and c.source is not distinct from d.source group by 1),
    b as (select d.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
          cast(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
          cast(len(w.l) - len(list_distinct(w.l)) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words, cast(coalesce(x.n, 0) as bigint) as n_line_words
          from d join w using (r) left join p using (r) left join x using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
      not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (2 * n_line_words > n_words or n_words - n_line_words < {least_words}) as kept, n_line_words
    from b
    """
