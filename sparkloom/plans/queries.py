"""The registered queries over the driver's tables, each with the DuckDB SQL it is held against where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attest, code, content, patches, paths, transcripts
from ..operators import analytics as A
from ..operators import budget, delivery, guard, replay, retention
from ..operators import presence as P
from ..sources import stores
from . import api
from .views import SQL_BASE, SQL_METER, SQL_REQUESTS, SQL_SECRET, archive_events, base_events, meter_events, presence_rows, raw_events, read_requests, sql_events, sql_presence, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86_400_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def with_now(rows: DataFrame, column: str = "ts_ms") -> DataFrame:
    """rows with `_now`, the latest time in them: a scalar subquery."""
    return rows.withColumn("_now", rows.agg(F.max(column)).scalar())


# --- packs ------------------------------------------------------------------------------------------------------------

_PACK_SQL = f"""with {sql_events("user")}, nw as (select max(ts_ms) as n from ev),
st as (select path, count(distinct session) as sessions, count(*) as reads, count(distinct hash) as versions, any_value(approx_tokens order by seq desc) as tok,
  (count(distinct session) * 10 + count(*)) / count(distinct hash) as score from ev, nw where not excluded and ts_ms >= n - {14 * DAY} group by path)"""


@query(_PACK_SQL + " select path, sessions, reads, versions, round(score, 6) as score from st order by st.score desc, path limit 8")
def pack_rank(spark, sf):
    ev = with_now(archive_events(spark, sf, "user"))
    stats = A.pack_stats(ev.where(F.col("ts_ms") >= F.col("_now") - 14 * DAY))
    return stats.orderBy(*A.pack_order()).limit(8).select("path", "sessions", "reads", "versions", F.round("score", 6).alias("score"))


def _pack_candidates(spark, sf):
    ev = with_now(archive_events(spark, sf, "user")).where(F.col("ts_ms") >= F.col("_now") - 14 * DAY)
    last = ev.groupBy("path").agg(F.max_by("approx_tokens", "seq").alias("tok"))
    return A.pack_stats(ev).join(last, "path").withColumn("all", F.lit(1))


_GREEDY_SQL = """, rk as (select *, row_number() over (order by score desc, path) as rn from st),
g as (with recursive g(rn, path, tok, spent, n, taken) as (
  select cast(0 as bigint), cast('' as varchar), cast(0 as bigint), cast(0 as bigint), 0, false
  union all select rk.rn, rk.path, rk.tok, case when g.n < 8 and g.spent + rk.tok <= {budget} then g.spent + rk.tok else g.spent end,
    case when g.n < 8 and g.spent + rk.tok <= {budget} then g.n + 1 else g.n end, g.n < 8 and g.spent + rk.tok <= {budget} from g join rk on rk.rn = g.rn + 1)
  select * from g)"""


@query(_PACK_SQL + _GREEDY_SQL.format(budget=1500) + " select path, tok, spent from g where taken")
def pack_budget(spark, sf):
    return _picked(spark, budget.pick(_pack_candidates(spark, sf), "score", "path", "tok", 1500, 8))


def _picked(spark, picks):
    spent = accumulate(p["tok"] for p in picks)
    return spark.createDataFrame([(p["path"], p["tok"], total) for p, total in zip(picks, spent)], "path string, tok long, spent long")


@query(_PACK_SQL + _GREEDY_SQL.format(budget=700).replace("g.n < 8", "g.n < 30") + " select path, tok, spent from g where taken")
def pack_budget_scans(spark, sf):
    """A smaller budget and no end of picks but the budget's: what is big is passed over."""
    return _picked(spark, budget.pick(_pack_candidates(spark, sf), "score", "path", "tok", 700, 30))


@query(_PACK_SQL + _GREEDY_SQL.format(budget=1500).replace("g.n < 8 and ", "") + " select path, tok, spent from g where taken")
def pack_budget_folded(spark, sf):
    """The same walk without a number of picks, over the whole ranking."""
    return budget.greedy(_pack_candidates(spark, sf), ["all"], [F.desc("score"), F.asc("path")], "tok", 1500).where("taken").select("path", "tok", "spent")


# --- archive ----------------------------------------------------------------------------------------------------------


@query(f"with {sql_events()}, nw as (select max(ts_ms) as n from ev), l as (select session, max(ts_ms) as m from ev group by 1) select session, count(*) as events, min(ts_ms) as first_ms from ev join l using (session), nw where m >= n - 1800000 or session = '3' group by 1")
def events_retained(spark, sf):
    ev = archive_events(spark, sf)
    kept = retention.retained_events(ev, _scalar_now(ev), own="3", days=1800 / 86400)
    return kept.groupBy("session").agg(F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"))


def _scalar_now(rows: DataFrame) -> int:
    return rows.agg(F.max("ts_ms")).first()[0] or 0


@query(f"with {sql_events()}, nw as (select max(ts_ms) as n from ev) select seq, ts_ms, path, hash from ev, nw where ts_ms >= n - {7 * DAY}")
def events_since(spark, sf):
    ev = with_now(archive_events(spark, sf))
    return stores.oldest_first(ev.where(F.col("ts_ms") >= F.col("_now") - 7 * DAY).withColumnRenamed("ts_ms", "ts")).select("seq", F.col("ts").alias("ts_ms"), "path", "hash")


_URLS = "regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '')"
_ODD = """case page_id % 8 when 0 then '\\.env.local' when 1 then '/ID_RSA.pub' when 2 then '/App-Secret.YAML' when 3 then '/.ssh/config' when 4 then '/notes.sql' when 5 then '/Credentials' when 6 then '/my.KEY' else '/secretary.md' end"""


@query(f"with p as (select page_id, {_URLS} || {_ODD} as path from pages) select page_id, path, coalesce({SQL_SECRET.format(p='path')}, false) or regexp_matches(path, '(^|/)[^/]*\\.sql$', 'i') as secret from p")
def excluded_paths(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", ""), F.expr(_ODD.replace("\\", "\\\\"))).alias("path"))
    return p.withColumn("secret", paths.is_secret(F.col("path"), "*.sql, ,private-notes.md"))


@query(f"with {sql_events()} select excluded, count(*) as events, sum(bytes) as bytes, sum(approx_tokens) as tokens, count(distinct hash) as hashes, count(git_blob_sha1) as gits from ev group by 1")
def masked_events(spark, sf):
    return archive_events(spark, sf).groupBy("excluded").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.sum("approx_tokens").alias("tokens"), F.countDistinct("hash").alias("hashes"), F.count("git_blob_sha1").alias("gits"))


@query(r"select page_id, replace(replace(url, '/', '\'), '\', '/') as key, lower(replace(url, '/', '\')) as folded from pages")
def normalized_paths(spark, sf):
    back = F.translate("url", "/", "\\")
    return table(spark, sf, "pages").select("page_id", paths.path_key(back).alias("key"), F.translate(paths.path_key(back, True), "/", "\\").alias("folded"))


@query("""with b as (select event_id as seq, user_id, cast(json_extract_string(props, '$.k') as int) as k from events)
select seq, case when k % 3 = 0 then 'sym:f' || k when k % 3 = 1 and k + user_id % 40 - 5 >= 0 then 'lines:' || greatest(1, least(k, 60)) || '-' || greatest(greatest(1, least(k, 60)), least(k + user_id % 40 - 5, 60)) else 'full' end as view,
case when k % 4 = 0 then 'full' else 'lines:' || coalesce(case when k % 4 <> 1 then k end, 0) || '-' || coalesce(cast(case when k % 4 <> 2 then user_id end as varchar), '') end as replay_view from b""")
def view_keys(spark, sf):
    b = base_events(spark, sf)
    k, u = F.col("k"), F.col("user_id")
    lines = F.when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" - "), (k + u % 40 - 5).cast("string"))).when(k % 3 == 2, F.lit("1-x")).otherwise(F.lit(""))
    view = paths.view_key(F.when(k % 3 == 0, F.concat(F.lit("f"), k.cast("string"))), lines, F.lit(60))
    whole = k % 4 == 0
    again = paths.replay_view_key(F.when(~whole & (k % 4 != 1), k), F.when(~whole & (k % 4 != 2), u))
    return b.select("seq", view.alias("view"), again.alias("replay_view"))


@query("""select page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') || '__' || case page_id % 3 when 0 then 'main' when 1 then 'main' else 'a_' || page_id end as writer,
regexp_replace(url, '(?i)\\.jsonl$', '') || '/subagents/agent-' || page_id || '.jsonl' as transcript, case page_id % 3 when 2 then 'a/' || page_id else '' end as agent,
case page_id % 3 when 2 then url || '-a/' || page_id else url end as guard_key, substr(url, 1, 8) as short from pages""")
def writer_keys(spark, sf):
    p = table(spark, sf, "pages")
    agent = F.when(F.col("page_id") % 3 == 2, F.concat(F.lit("a/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit(""))
    return p.select(
        "page_id", paths.writer_key(F.col("url"), agent).alias("writer"), paths.agent_transcript(F.col("url"), F.col("page_id").cast("string")).alias("transcript"),
        F.coalesce(agent, F.lit("")).alias("agent"), paths.guard_state_key(F.col("url"), agent).alias("guard_key"), paths.short_id(F.col("url"), 8).alias("short"),
    )


# --- contents ---------------------------------------------------------------------------------------------------------


@query("select doc_id, sha256(text) as hash, strlen(text) as bytes, substr(sha256(text), 1, 12) as short from documents")
def content_hashes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", content.content_hash(t).alias("hash"), content.byte_size(t).alias("bytes"), paths.short_id(content.content_hash(t), 12).alias("short"))


@query("select doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::blob || encode(text)) as git_sha1 from documents")
def git_blob_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content.git_blob_sha1(F.col("text")).alias("git_sha1"))


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents")
def approx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content.approx_tokens(F.col("text")).alias("tokens"))


@query("select hash, bytes, mtime, doc_ids from (select sha256(text) as hash, any_value(strlen(text)) as bytes, min(doc_id) as mtime, count(*) as doc_ids from documents group by 1)")
def blob_store(spark, sf):
    docs = table(spark, sf, "documents").withColumn("content", F.col("text"))
    n = docs.groupBy(content.content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("doc_ids"))
    return stores.as_blobs(docs, F.col("doc_id")).select("hash", "bytes", "mtime").join(n, "hash")


_NEW_SQL = "with b as (select sha256(text) as hash, min(doc_id) as mtime from documents group by 1), h as (select distinct sha256(text) as hash from documents where doc_id % 3 = 0)"


@query(_NEW_SQL + " select hash, mtime from b where hash not in (select hash from h)")
def blob_new(spark, sf):
    docs = table(spark, sf, "documents").withColumn("content", F.col("text"))
    stored = stores.as_blobs(docs.where("doc_id % 3 = 0"), F.col("doc_id"))
    return stores.new_blobs(stores.as_blobs(docs, F.col("doc_id")), stored).select("hash", "mtime")


@query(_NEW_SQL + " select doc_id, hash in (select hash from h) as in_archive, case when hash in (select hash from h) then strlen(text) end as bytes from (select doc_id, text, sha256(text) as hash from documents)")
def blob_lookup(spark, sf):
    docs = table(spark, sf, "documents").withColumn("content", F.col("text"))
    stored = stores.as_blobs(docs.where("doc_id % 3 = 0"), F.col("doc_id"))
    wanted = docs.select("doc_id", content.content_hash(F.col("text")).alias("hash"))
    return stores.has_blob(stores.lookup_blobs(wanted, stored), stored).select("doc_id", "in_archive", F.octet_length("content").cast("long").alias("bytes"))


@query("select hash, mtime from (select hash, mtime, sum(bytes) over (order by mtime desc, hash desc) as s from (select sha256(text) as hash, any_value(strlen(text)) as bytes, min(doc_id) as mtime from documents group by 1)) where s > 1000000")
def blob_eviction(spark, sf):
    blobs = stores.as_blobs(table(spark, sf, "documents").withColumn("content", F.col("text")), F.col("doc_id"))
    return retention.evicted_blobs(blobs, 1_000_000, bucket=100).select("hash", "mtime")


@query("select sum(bytes) as bytes, count(*) as blobs from (select distinct sha256(text) as hash, strlen(text) as bytes from documents)")
def archive_size(spark, sf):
    return retention.archive_bytes(stores.as_blobs(table(spark, sf, "documents").withColumn("content", F.col("text")), F.col("doc_id")))


@query("""with st as (select source, doc_id, strlen(text) as tok, row_number() over (partition by source order by doc_id) as rn from documents),
g as (with recursive g(source, rn, doc_id, spent, taken) as (select source, cast(0 as bigint), cast(-1 as bigint), cast(0 as bigint), false from (select distinct source from st)
 union all select st.source, st.rn, st.doc_id, case when g.spent + st.tok <= 20000 then g.spent + st.tok else g.spent end, g.spent + st.tok <= 20000 from g join st on st.source = g.source and st.rn = g.rn + 1) select * from g)
select source, doc_id, taken from g where rn > 0""")
def exact_budget(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return budget.greedy(docs, ["source"], ["doc_id"], "size", 20_000).select("source", "doc_id", "taken")


_BIN = "case doc_id % 10 when 1 then 'ab' || chr(1) || chr(2) || chr(3) || substr(text, 1, 3) when 2 then 'a' || chr(9) || chr(10) || chr(14) || substr(text, 1, 9) else text end"


@query(f"""with d as (select doc_id, {_BIN} as t from documents), h as (select doc_id, regexp_extract_all(substr(hex(encode(t)), 1, 16384), '..') as b from d)
select doc_id, coalesce(doc_id % 10 = 3 and len(b) < 8192 or (len(b) > 0 and len(list_filter(b, lambda x: x between '01' and '08' or x between '0E' and '1F')) / len(b) > 0.3), false) as is_binary from h""")
def binary_flag(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_BIN).alias("t"))
    data = F.encode("t", "UTF-8")
    data = F.when(F.col("doc_id") % 10 == 3, F.concat(data, F.lit(b"\x00"))).otherwise(data)
    return docs.select("doc_id", F.coalesce(content.looks_binary(data), F.lit(False)).alias("is_binary"))


@query("""with d as (select doc_id, string_split(text, chr(10)) as l, doc_id % 7 as a, doc_id % 11 as b from documents),
c as (select *, greatest(1, least(a, len(l))) as s from d), e as (select *, greatest(s, least(b, len(l))) as z from c)
select doc_id, cast(s as int) as first, cast(z as int) as last, sha256(array_to_string(list_slice(l, s, z), chr(10))) as hash from e""")
def line_slice(spark, sf):
    s = content.slice_lines(F.col("text"), (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 11).cast("int"))
    out = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return out.select("doc_id", F.col("s.start").alias("first"), F.col("s.end").alias("last"), content.content_hash(F.col("s.text")).alias("hash"))


@query("""with l as (select doc_id, i, case when i % 5 = 1 then 'function f' || i || '(' || t || '  ' when i % 7 = 2 then '  export const v' || i || ' = ' || t when i % 9 = 4 then 'run_' || i || '(a, b): void { ' || t when i % 11 = 5 then 'h' || i || ' = async (x) => ' || t else t end as t
 from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
k as (select doc_id, i, rtrim(t, ' ') as t from l where regexp_matches(t, '^\\s*(export\\s+)?(default\\s+)?(public\\s+|private\\s+|protected\\s+|static\\s+|async\\s+)*(function|class|interface|type|enum|struct|trait|impl|module|namespace|def|fn|func|val|var|let|const)\\b')
 or regexp_matches(t, '^\\s*(export\\s+)?(public\\s+|private\\s+|protected\\s+|static\\s+)*[A-Za-z_$][\\w$]*\\s*[:=]\\s*(async\\s*)?(\\([^)]*\\)|[A-Za-z_$][\\w$]*)\\s*=>')
 or regexp_matches(t, '^\\s*(public\\s+|private\\s+|protected\\s+|static\\s+|async\\s+)*[A-Za-z_$][\\w$]*\\s*\\([^)]*\\)\\s*(:\\s*[\\w<>\\[\\].,\\s|&]+)?\\s*\\{'))
select doc_id, cast(i as int) as line, substr(t, 1, 200) as text from k""")
def outline(spark, sf):
    code_line = "case when i % 5 = 0 then 'function f' || (i + 1) || '(' || t || '  ' when i % 7 = 1 then '  export const v' || (i + 1) || ' = ' || t when i % 9 = 3 then 'run_' || (i + 1) || '(a, b): void { ' || t when i % 11 = 4 then 'h' || (i + 1) || ' = async (x) => ' || t else t end"
    docs = table(spark, sf, "documents").select("doc_id", F.expr(f"array_join(transform(split(text, '\\n'), (t, i) -> {code_line}), '\\n')").alias("t"))
    return docs.select("doc_id", F.explode(content.outline(F.col("t"))).alias("o")).select("doc_id", F.col("o.line").alias("line"), F.col("o.text").alias("text"))


# --- metering and delivery --------------------------------------------------------------------------------------------


@query(f"with {SQL_METER} select count(*) as reads, count(*) filter (kind = 'full') as n_full, count(*) filter (kind = 'diff') as n_diff, count(*) filter (kind = 'unchanged') as n_unchanged, cast(sum(baseline_tokens) as bigint) as baseline_tokens, cast(sum(sent_tokens) as bigint) as sent_tokens, cast(sum(baseline_tokens) - sum(sent_tokens) as bigint) as saved_tokens from mt")
def meter_totals(spark, sf):
    return A.meter_totals(meter_events(spark, sf))


@query(f"with {SQL_METER} select repo, count(*) as reads, count(distinct path) as files, cast(sum(baseline_tokens) as bigint) as baseline_tokens, cast(sum(sent_tokens) as bigint) as sent_tokens, cast(sum(baseline_tokens) - sum(sent_tokens) as bigint) as saved_tokens from mt group by 1")
def meter_by_repo(spark, sf):
    return A.meter_by_repo(meter_events(spark, sf))


@query(f"with {SQL_METER} select path, count(*) as reads, cast(sum(sent_tokens) as bigint) as sent_tokens, cast(sum(baseline_tokens) as bigint) as baseline_tokens from mt group by 1 order by 3 desc, 1 limit 8")
def meter_top_files(spark, sf):
    return A.top_files(meter_events(spark, sf), 8)


@query(f"with {SQL_METER} select path, '$' || cast((sum(sent_tokens) * 3 + 50) // 1000000 as bigint) || '.' || lpad(cast(cast((sum(sent_tokens) * 3 + 50) // 100 as bigint) % 10000 as varchar), 4, '0') as usd, round((sum(baseline_tokens) - sum(sent_tokens)) * 100.0 / sum(baseline_tokens), 1) as saved_pct from mt group by 1")
def cost(spark, sf):
    sums = meter_events(spark, sf).groupBy("path").agg(F.sum("sent_tokens").alias("s"), F.sum("baseline_tokens").alias("b"))
    return sums.select("path", content.usd(F.col("s")).alias("usd"), content.saved_percent(F.col("b"), F.col("s")).alias("saved_pct"))


@query(f"with {SQL_REQUESTS} select session, seq, path, kind, first_read, case when kind <> 'full' then base end as base_hash, run as epoch_run from dl")
def delivery_kinds(spark, sf):
    return delivery.decide(read_requests(spark, sf)).select("session", "seq", "path", "kind", "first_read", "base_hash", F.coalesce("epoch_run", F.lit(0)).alias("epoch_run"))


@query(f"""with {SQL_REQUESTS}, o as (select *, row_number() over (partition by session order by seq) as rn, coalesce(run, 0) as r from runs),
g as (with recursive g(session, rn, seq, r, led, kind, base) as (
  select session, cast(0 as bigint), cast(-1 as bigint), cast(-1 as bigint), cast([] as struct(k varchar, h varchar, s bigint)[]), '', cast(null as varchar) from (select distinct session from o)
  union all select session, rn, seq, r, case when kind = 'unchanged' then l0 else list_filter(l1, lambda x, i: i = len(l1) or list_sum(list_transform(l1[i:], lambda y: y.s)) <= 4000) end, kind, case when kind <> 'full' then prev.h end
  from (select *, list_append(list_filter(l0, lambda x: x.k <> path), struct_pack(k := path, h := hash, s := bytes)) as l1,
    case when prev is null then 'full' when prev.h <> hash then 'changed' when bytes > 256 then 'unchanged' else 'full' end as kind
    from (select *, list_filter(l0, lambda x: x.k = path)[1] as prev from (select o.session, o.rn, o.seq, cast(o.r as bigint) as r, o.path, o.hash, o.bytes, case when o.r <> g.r then [] else g.led end as l0 from g join o on o.session = g.session and o.rn = g.rn + 1))))
  select * from g)
select session, seq, kind, base as base_hash from g where rn > 0""")
def ledger_kinds(spark, sf):
    """Delivery under a ledger of 4000 bytes, which holds a few files."""
    return delivery.decide(read_requests(spark, sf), ledger_bytes=4000).select("session", "seq", "kind", "base_hash")


@query(f"with {SQL_METER}, m as (select *, case kind when 'diff' then 'changed' else kind end as k from mt) select count(*) as reads, count(*) filter (first_read) as first_reads, count(*) filter (k = 'unchanged') as unchanged, count(*) filter (k = 'changed') as changed, round(count(*) filter (not first_read) * 100.0 / count(*), 6) as reread_pct, cast(sum(baseline_tokens) as bigint) as baseline_tokens, cast(sum(sent_tokens) as bigint) as sent_tokens, round((sum(baseline_tokens) - sum(sent_tokens)) * 100.0 / sum(baseline_tokens), 6) as saved_pct from m")
def replay_summary(spark, sf):
    m = meter_events(spark, sf)
    return replay.replay_summary(m.withColumn("kind", F.when(F.col("kind") == "diff", "changed").otherwise(F.col("kind"))))


@query(f"with {SQL_REQUESTS}, s as (select session, count(*) filter (not first_read) / count(*) as share from dl group by 1) select round((list_sort(list(share)))[cast(floor(count(*) / 2) as int) + 1], 6) as median_reread_share, count(*) as sessions from s")
def reread_median(spark, sf):
    return replay.reread_median(delivery.decide(read_requests(spark, sf)))


@query("""with c as (select conv_id, turn, turn // 4 as id from conversations where role = 'user' and (conv_id % 2 = 0 or turn % 4 < 2)),
r as (select conv_id, turn, turn // 4 as id, text, (turn + conv_id) % 3 = 0 as err from conversations where role = 'assistant'),
m as (select r.conv_id, r.id, r.turn, r.text, r.err, max(c.turn) as call_line from r join c on c.conv_id = r.conv_id and c.id = r.id and c.turn <= r.turn group by all)
select m.conv_id, call_line, m.turn as result_line from m where not err and text <> '' and not exists (select 1 from r o where o.conv_id = m.conv_id and o.id = m.id and o.turn >= m.call_line and o.turn < m.turn)""")
def calls_with_results(spark, sf):
    """Ids stand for up to two calls and two results each; a third of the results are errors, which answer their call all the same."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / 4).alias("id"))
    calls = c.where("role = 'user' and (conv_id % 2 = 0 or turn % 4 < 2)").select(F.col("conv_id").alias("file"), "id", F.col("turn").alias("call_line"))
    results = c.where("role = 'assistant'").select(F.col("conv_id").alias("file"), "id", F.col("turn").alias("result_line"), F.col("text").alias("body"), ((F.col("turn") + F.col("conv_id")) % 3 == 0).alias("is_error"))
    return replay.calls_with_results(calls, results).select(F.col("file").alias("conv_id"), "call_line", "result_line")


@query(f"with {sql_events()}, r as (select * from raw where event_type in ('view', 'click')), f as (select session, k, ver, arg_min(user_id, seq) as a from r group by 1, 2, 3) select session, count(*) as reads, count(*) filter (user_id <> a) as duplicates, cast(sum(approx_tokens) as bigint) as tokens, cast(sum(case when user_id <> a then approx_tokens else 0 end) as bigint) as duplicate_tokens from r join f using (session, k, ver) group by 1")
def cross_agent_overlap(spark, sf):
    r = raw_events(spark, sf).where("event_type in ('view', 'click')")
    return replay.sibling_overlap(r, "session", "user_id", ["k", "ver"])


# --- transcripts ------------------------------------------------------------------------------------------------------


def _lines(spark, sf):
    """Transcript lines made of conversations: user turns call tools, assistant turns are read results, the rest is noise."""
    c = table(spark, sf, "conversations")
    path = F.concat(F.lit("/w\\c"), (F.col("conv_id") % 20).cast("string"), F.lit(".ts"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    side = F.when(F.col("role") == "system", True)
    name = F.element_at(F.array(*[F.lit(x) for x in ("Read", "Edit", "Write", "NotebookEdit", "Bash")]), (F.col("turn") % 5 + 1).cast("int"))
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), name.alias("name"), F.struct(path.alias("file_path")).alias("input"))
    user = F.to_json(F.struct(stamp.alias("timestamp"), side.alias("isSidechain"), F.struct(F.array(call).alias("content")).alias("message")))
    n = (F.col("turn") % 3 + 1).cast("long")
    file = F.struct(path.alias("filePath"), F.col("text").alias("content"), n.alias("startLine"), F.lit(5).cast("long").alias("numLines"), F.lit(5).cast("long").alias("totalLines"))
    result = F.to_json(F.struct(stamp.alias("timestamp"), F.struct(file.alias("file")).alias("toolUseResult")))
    value = F.when(F.col("role") == "assistant", result).when((F.col("role") == "system") & (F.col("turn") % 2 == 1), "{{{").otherwise(user)
    return transcripts.parsed(c.select("conv_id", "turn", value.alias("value")))


_T_SQL = """c as (select conv_id, turn, role, text, '/w\\c' || (conv_id % 20) || '.ts' as path, '/w/c' || (conv_id % 20) || '.ts' as key, conv_id * 100000 + turn as seq from conversations),
tc as (select * from (select *, case turn % 5 when 0 then 'read' when 1 then 'edit' when 2 then 'write' when 3 then 'edit' end as op from c where role <> 'assistant' and not (role = 'system' and turn % 2 = 1)) where op is not null),
ex as (select *, sha256(text) as hash from c where role = 'assistant' and turn % 3 = 0)"""


@query(f"with {_T_SQL} select key, path, reads, edits, last_op from (select key, any_value(path) as path, count(*) filter (op = 'read') as reads, count(*) filter (op <> 'read') as edits, arg_max(op, seq) as last_op from tc where role <> 'system' group by 1)")
def sweep_touches(spark, sf):
    t = transcripts.touches(_lines(spark, sf), ["conv_id", "turn"]).withColumn("seq", F.col("conv_id") * 100000 + F.col("turn"))
    return A.touch_fold(t).select("key", "path", "reads", "edits", "last_op")


@query(f"with {_T_SQL} select (select count(*) from c) as lines, (select count(*) from (select conv_id, turn from tc union select conv_id, turn from ex)) as parsed_lines, (select count(*) from tc where op = 'read') as reads_seen, (select count(*) from tc where op <> 'read') as edits_seen")
def sweep_stats(spark, sf):
    lines = _lines(spark, sf).withColumn("line", F.struct("conv_id", "turn"))
    return A.sweep_stats(lines, transcripts.touches(lines, ["line"]), transcripts.exact_versions(lines, ["line"]))


@query(f"with {_T_SQL} select key, hash, conv_id, turn from (select *, row_number() over (partition by key, hash order by seq) as n from ex) where n = 1")
def exact_versions(spark, sf):
    ex = transcripts.exact_versions(_lines(spark, sf), ["conv_id", "turn"]).withColumn("hash", content.content_hash(F.col("content"))).withColumn("seq", F.col("conv_id") * 100000 + F.col("turn"))
    return A.first_versions(ex).select(paths.path_key(F.col("path")).alias("key"), "hash", "conv_id", "turn")


@query(f"with {_T_SQL} select conv_id, key, arg_max(case when turn % 3 = 0 then sha256(text) else 'none' end, seq) as hash from c where role = 'assistant' group by 1, 2")
def seen_state(spark, sf):
    marks = transcripts.seen_marks(_lines(spark, sf), ["conv_id", "turn"])
    return guard.latest_seen(marks.withColumn("seq", F.col("turn")), ["conv_id"]).select("conv_id", "key", F.coalesce("hash", F.lit("none")).alias("hash"))


@query("""select conv_id, turn, '/w\\e' || (conv_id % 9) as path, case when turn % 4 = 1 then sha256(text) end as hash from conversations where role = 'assistant' and turn % 4 <> 3 and turn % 5 <> 2""")
def landed_edits(spark, sf):
    """Results that name a file and hold no read: some hold the written content, some lines have no time, some are reads."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    path = F.concat(F.lit("/w\\e"), (F.col("conv_id") % 9).cast("string"))
    stamp = F.when(F.col("turn") % 5 != 2, F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    read = F.when(F.col("turn") % 4 == 3, F.struct(path.alias("filePath"), F.col("text").alias("content")))
    result = F.struct(read.alias("file"), path.alias("filePath"), F.when(F.col("turn") % 4 == 1, F.col("text")).alias("content"))
    lines = transcripts.parsed(c.select("conv_id", "turn", F.to_json(F.struct(stamp.alias("timestamp"), result.alias("toolUseResult"))).alias("value")))
    return transcripts.landed_edits(lines, ["conv_id", "turn"]).select("conv_id", "turn", "path", "hash")


@query("""select conv_id, turn, '/own/' || (conv_id % 9) || case when turn % 6 = 4 then '/b' else '' end as key from conversations where turn % 6 in (0, 4)
union all select conv_id, turn, '/shown/' || i from conversations, range(3) t(i) where turn % 6 = 5 and i < 2""")
def own_reader_marks(spark, sf):
    """What calls of the reader's own tools ask for, and what its results show, beside other tools and other texts."""
    c = table(spark, sf, "conversations")
    turn, n = F.col("turn") % 6, (F.col("conv_id") % 9).cast("string")
    name = F.when(turn == 0, "mcp__my-reader-2__read_file").when(turn == 4, "mcp__reader__read_files").when(turn == 1, "mcp__other__read_file").otherwise("mcp__a_reader__x")
    asked = F.struct(F.when(turn != 4, F.concat(F.lit("/own/"), n)).alias("path"), F.when(turn == 4, F.array(F.concat(F.lit("/own/"), n, F.lit("/b")))).alias("paths"))
    shown = F.concat_ws("\n\n---\n\n", *[F.concat(F.lit(f"[context-reader] /shown/{i} — full content, hash "), n, F.lit("\n[context-reader] not a head\n"), F.col("text")) for i in (0, 1)], F.lit("\n\n\n[context-reader] /shown/2 — full content"))
    call = F.struct(F.lit("tool_use").alias("type"), name.alias("name"), asked.alias("input"), F.lit(None).cast("string").alias("content"))
    result = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<path: string, paths: array<string>>").alias("input"), F.when(turn == 5, shown).otherwise(F.concat(F.lit("seen: "), shown)).alias("content"))
    line = F.struct(F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), F.struct(F.array(F.when(turn.isin(0, 1, 2, 4), call).otherwise(result)).alias("content")).alias("message"))
    lines = transcripts.parsed(c.select("conv_id", "turn", F.to_json(line).alias("value")))
    return transcripts.seen_marks(lines, ["conv_id", "turn"]).select("conv_id", "turn", "key")


_HEAT_SQL = f"""with {sql_events()}, nw as (select max(ts_ms) as n from ev), t as (select path, count(*) filter (op = 'read') as reads, count(*) filter (op <> 'read') as edits, arg_max(op, seq) as last_op, max(ts_ms) as last_ts from ev where not sidechain group by 1)"""


def _heat(spark, sf):
    ev = archive_events(spark, sf).withColumn("ts", F.col("ts_ms"))
    return A.touch_fold(ev)


@query(_HEAT_SQL + " select path, reads, edits, last_op, last_ts, row_number() over (order by edits > 0 desc, reads + edits desc, last_ts desc, path) as place from t order by place limit 12")
def heat_rank(spark, sf):
    top = _heat(spark, sf).orderBy(*A.heat_order()).limit(12)
    return top.select("path", "reads", "edits", "last_op", "last_ts", F.row_number().over(Window.orderBy(*A.heat_order())).alias("place"))


@query(_HEAT_SQL + ", s as (select path, length(path) * 1000 as size, length(path) % 3 = 0 as bin, path not like '%7.ts' as ok from t) select t.path, ok and size <= 11000 and not bin as usable from t join s using (path)")
def touched_on_disk(spark, sf):
    t = _heat(spark, sf)
    size = (F.length("path") * 1000).cast("long")
    snapshot = t.select("path", (~F.col("path").endswith("7.ts")).alias("exists"), size.alias("size"), (F.length("path") % 3 == 0).alias("binary"), F.sha2("path", 256).alias("hash"))
    there, gone = A.on_disk(t, snapshot, 11_000)
    return there.select("path", F.lit(True).alias("usable")).unionByName(gone.select("path", F.lit(False).alias("usable")))


@query(_HEAT_SQL + ", r as (select path, reads, edits, row_number() over (order by edits > 0 desc, reads + edits desc, last_ts desc, path) as p from t) select 's_1' as file, cast(count(*) as bigint) as entries, string_agg(path, ',' order by p) as paths from r where p <= 12")
def manifest_topk(spark, sf):
    m = stores.manifest(_heat(spark, sf), A.heat_order(), "s/1", "2024-01-31T00:00:00.000Z")
    return m.select("file", F.size("entries").cast("long").alias("entries"), F.array_join(F.transform("entries", lambda e: e["path"]), ",").alias("paths"))


@query("""with m as (select cast(conv_id as varchar) as session, max(turn) * 3600000 + conv_id as mtime from conversations group by conv_id), q as (select unnest(['5', 'none', '']) as ask)
select ask, session, mtime from (select *, row_number() over (partition by ask order by session = ask desc, mtime desc, session) as n from q, m where session = ask or (20000000 + 3600000 - mtime <= 10000000 and mtime <= 23600000)) where n = 1""")
def manifest_asof(spark, sf):
    m = table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") * 3_600_000 + F.col("conv_id")).alias("mtime")).select(F.col("conv_id").cast("string").alias("session"), "mtime")
    out = [stores.manifest_as_of(m, ask, 23_600_000, 10_000_000).select(F.lit(ask).alias("ask"), "session", "mtime") for ask in ("5", "none", "")]
    return out[0].unionByName(out[1]).unionByName(out[2])


_WS_SQL = f"""with {sql_events()}, nw as (select max(ts_ms) as n from ev),
man as (select path, count(*) as touches, arg_max(approx_tokens, seq) as tok, arg_max(hash, seq) as hash, max(ts_ms) as ts from ev, nw where not sidechain and ts_ms < n - 43200000 and k % 3 = 0 group by 1),
r as (select path, touches, tok, hash, 'sweep' as source, n - 43200000 as ts, -1 as s from man, nw union all select path, 1, approx_tokens, hash, source, ts_ms, seq from ev, nw where ts_ms >= n - 86400000),
g as (select path, sum(touches) as touches, arg_max(hash, ts * 1000000 - s) as hash, arg_max(tok, ts * 1000000 - s) as tok, max(ts) as last_ms from r group by 1),
src as (select path, string_agg(source, '+' order by f) as sources from (select path, source, min(s) as f from r group by 1, 2) group by 1)"""


def _working_set(spark, sf):
    ev = archive_events(spark, sf)
    now = _scalar_now(ev)
    old = ev.where(~F.col("sidechain") & (F.col("ts_ms") < now - 43_200_000) & (F.col("k") % 3 == 0))
    man = old.groupBy("path").agg(F.count("*").alias("touches"), F.max_by("approx_tokens", "seq").alias("approx_tokens"), F.max_by("hash", "seq").alias("hash")).withColumn("ts_ms", F.lit(now - 43_200_000))
    return A.working_set(ev, man, now)


@query(_WS_SQL + " select path, cast(touches as bigint) as touches, hash, cast(tok as bigint) as approx_tokens, sources, last_ms from g join src using (path) order by g.touches desc, last_ms desc, path limit 15")
def working_set(spark, sf):
    return _working_set(spark, sf).orderBy(F.desc("touches"), F.desc("last_ms"), "path").limit(15).select("path", "touches", "hash", "approx_tokens", "sources", "last_ms")


@query(_WS_SQL + """ select path, case when hash = '' then 'not archived (secret-pattern)' when path like '%7.ts' then 'missing on disk' when path like '%2.ts' then 'CHANGED on disk since last seen' else 'current' end as state from g""")
def staleness(spark, sf):
    ws = _working_set(spark, sf)
    disk = ws.where(~F.col("path").endswith("7.ts")).select("path", F.when(F.col("path").endswith("2.ts"), "other").otherwise(F.col("hash")).alias("disk"))
    joined = ws.join(disk, "path", "left")
    return joined.select("path", content.staleness(F.col("hash"), F.col("disk").isNotNull(), F.col("disk")).alias("state"))


@query(_HEAT_SQL.replace("max(ts_ms) as last_ts from ev", "max(ts_ms) as last_ts, arg_max(approx_tokens, seq) as tok, bool_or(excluded) as x from ev") + """,
rk as (select path, tok, x, row_number() over (order by edits > 0 desc, reads + edits desc, last_ts desc, path) as rn from t), k as (select * from rk where rn <= 12),
g as (with recursive g(rn, path, spent, taken) as (select cast(0 as bigint), cast('' as varchar), cast(0 as bigint), false union all
 select k.rn, k.path, case when not k.x and g.spent + k.tok <= 900 then g.spent + k.tok else g.spent end, not k.x and g.spent + k.tok <= 900 from g join k on k.rn = g.rn + 1) select * from g)
select path, taken, case when taken then spent end as spent from g where rn > 0""")
def restore_budget(spark, sf):
    ev = archive_events(spark, sf).withColumn("ts", F.col("ts_ms"))
    last = ev.where("not sidechain").groupBy("path").agg(F.max_by("approx_tokens", "seq").alias("tok"), F.bool_or("excluded").alias("x"))
    top = A.touch_fold(ev).join(last, "path").orderBy(*A.heat_order()).limit(12)
    keys = [(F.col("edits") == 0).alias("a"), (-(F.col("reads") + F.col("edits"))).alias("b"), (-F.col("last_ts")).alias("c"), F.col("path").alias("d")]
    ranked = top.withColumn("rank", F.struct(*keys)).withColumn("one", F.lit(1))
    return budget.greedy(ranked, ["one"], ["rank"], "tok", 900, free="x").select("path", "taken", "spent")


# --- blame ------------------------------------------------------------------------------------------------------------

_FOCUS = "/r0/f10.ts"


@query(f"""with {sql_events()}, m as (select * from ev where path = '{_FOCUS}' and not excluded and hash <> ''),
s as (select hash, string_agg(session, ',' order by f) as sessions from (select hash, session, min(seq) as f from m group by 1, 2) group by 1),
o as (select hash, string_agg(source, ',' order by f) as sources from (select hash, source, min(seq) as f from m group by 1, 2) group by 1),
p as (select hash, string_agg(op, ',' order by f) as ops from (select hash, op, min(seq) as f from m group by 1, 2) group by 1),
g as (select hash, min(ts_ms) as first_ms, max(ts_ms) as last_ms, count(*) as events, arg_min(bytes, seq) as bytes, arg_max(git_blob_sha1, seq) filter (git_blob_sha1 is not null) as git_blob_sha1 from m group by 1)
select * from g join s using (hash) join o using (hash) join p using (hash)""")
def blame_versions(spark, sf):
    return A.blame_versions(archive_events(spark, sf), _FOCUS)


@query(f"with {sql_events()} select 'a' as which, count(*) as total_events, count(*) filter (excluded) as excluded_events from ev where path = '{_FOCUS}' union all select 'b', count(*), count(*) filter (excluded) from ev where path = '/r0/.env.p25'")
def blame_counters(spark, sf):
    ev = archive_events(spark, sf)
    out = [A.blame_counters(ev, p).select(F.lit(w).alias("which"), "*") for w, p in (("a", _FOCUS), ("b", "/r0/.env.p25"))]
    return out[0].unionByName(out[1])


@query(f"""with {sql_events()}, f as (select max(ts_ms) as moment from ev where path = '{_FOCUS}'), fs as (select distinct session from ev, f where path = '{_FOCUS}' and abs(ts_ms - moment) <= 43200000)
select path, count(*) as events, count(distinct session) as sessions from ev, f where path <> '{_FOCUS}' and not excluded and abs(ts_ms - moment) <= 43200000 and session in (select session from fs) group by 1 order by 2 desc, min(seq) limit 20""")
def co_context(spark, sf):
    return A.co_context(archive_events(spark, sf), _FOCUS, window_minutes=720)


@query(f"""with {sql_events()}, f as (select path as focus, max(ts_ms) as moment from ev group by 1), fs as (select distinct focus, moment, session from ev join f on ev.path = f.focus where abs(ts_ms - moment) <= 10800000),
m as (select focus, path, count(*) as events, count(distinct ev.session) as sessions, min(seq) as first from fs join ev on ev.session = fs.session and path <> focus and not excluded and abs(ts_ms - moment) <= 10800000 group by 1, 2)
select focus, path, events, sessions, place from (select *, row_number() over (partition by focus order by events desc, first) as place from m) where place <= 20""")
def co_context_all(spark, sf):
    return A.co_context_all(archive_events(spark, sf), window_minutes=180)


@query("""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') as path from pages), r as (select distinct '/' || string_split(path, '/')[2] as root from p where page_id % 2 = 0 union select distinct '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] from p where page_id % 3 = 0)
select page_id, coalesce(arg_max(root, length(root)), '/') as repo from p left join r on starts_with(p.path, r.root || '/') group by 1""")
def repo_attribution(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "").alias("path"))
    part = F.split("path", "/")
    roots = p.where("page_id % 2 = 0").select(F.concat(F.lit("/"), part[1]).alias("root")).unionByName(p.where("page_id % 3 = 0").select(F.concat(F.lit("/"), part[1], F.lit("/"), F.try_element_at(part, F.lit(3))).alias("root")))
    return paths.attribute_repo(p, roots.where("root is not null")).select("page_id", "repo")


# --- receipts ---------------------------------------------------------------------------------------------------------


def _receipt_meter(spark, sf):
    return meter_events(spark, sf).withColumn("excluded", F.col("path") == "/r1/f4")


_RC_SQL = SQL_METER + ", rm as (select *, path = '/r1/f4' as excluded from mt)"


@query(f"""with {_RC_SQL}, h as (select path, view, string_agg(hash, ',' order by f) as hs from (select path, view, hash, min(seq) as f from rm group by 1, 2, 3) group by 1, 2)
select path, view, count(*) as reads, count(*) filter (kind = 'full') as n_full, count(*) filter (kind = 'diff') as n_diff, count(*) filter (kind = 'unchanged') as n_unchanged,
case when bool_or(excluded) then '' else arg_max(hash, seq) end as final_hash, case when bool_or(excluded) then null else arg_max(git_blob_sha1, seq) filter (git_blob_sha1 is not null) end as git_blob_sha1,
bool_or(excluded) as excluded, case when bool_or(excluded) then '' else any_value(hs) end as hashes_seen from rm join h using (path, view) group by 1, 2""")
def receipt_files(spark, sf):
    return A.receipt_files(_receipt_meter(spark, sf))


@query(f"with {_RC_SQL} select count(*) as reads, count(distinct path || '|' || view) as files, cast(sum(baseline_tokens) as bigint) as baseline_tokens, cast(sum(sent_tokens) as bigint) as sent_tokens, (select string_agg(epoch, ',' order by epoch) from (select distinct epoch from rm)) as epochs, (select string_agg(repo, ',' order by repo) from (select distinct repo from rm)) as repos from rm")
def receipt_totals(spark, sf):
    return A.receipt_totals(_receipt_meter(spark, sf))


@query(f"""with {sql_events()}, s as (select * from ev where source = 'sweep' and not excluded and hash <> ''), h as (select path, string_agg(hash, ',' order by f) as hashes_seen from (select path, hash, min(seq) as f from s group by 1, 2) group by 1)
select path, count(*) as reads, any_value(hashes_seen) as hashes_seen, arg_max(git_blob_sha1, seq) filter (git_blob_sha1 is not null) as git_blob_sha1 from s join h using (path) group by 1""")
def receipt_swept(spark, sf):
    return A.receipt_swept(archive_events(spark, sf))


_KEY = "a key for tests only"


def _padded(x: int) -> str:
    return "'" + "".join(f"\\x{b ^ x:02X}" for b in _KEY.encode().ljust(64, b"\0")) + "'::blob"


@query(f"select doc_id, sha256({_padded(0x5C)} || unhex(sha256({_padded(0x36)} || encode(text)))) as signature from documents")
def receipt_hmac(spark, sf):
    return table(spark, sf, "documents").select("doc_id", attest.hmac_sha256(F.col("text"), _KEY).alias("signature"))


_FILE_JSON = """'{"excluded":' || excluded || ',"final_hash":"' || final_hash || '"' || coalesce(',"git_blob_sha1":"' || git || '"', '') || ',"hashes_seen":"' || hashes || '","n_diff":' || n_diff || ',"n_full":' || n_full || ',"n_unchanged":' || n_same || ',"path":"' || path || '","reads":' || reads || ',"view":"' || view || '"}'"""


@query(f"""with {_RC_SQL}, h as (select path, view, string_agg(hash, ',' order by f) as hs from (select path, view, hash, min(seq) as f from rm group by 1, 2, 3) group by 1, 2),
f as (select path, view, count(*) as reads, count(*) filter (kind = 'full') as n_full, count(*) filter (kind = 'diff') as n_diff, count(*) filter (kind = 'unchanged') as n_same, bool_or(excluded) as excluded,
  case when bool_or(excluded) then '' else arg_max(hash, seq) end as final_hash, case when bool_or(excluded) then null else arg_max(git_blob_sha1, seq) filter (git_blob_sha1 is not null) end as git, case when bool_or(excluded) then '' else any_value(hs) end as hashes from rm join h using (path, view) group by 1, 2),
m as (select '{{"artifact":"a","epochs":[' || (select string_agg(epoch, ',' order by epoch) from (select distinct epoch from rm)) || '],"files":[' || (select string_agg({_FILE_JSON}, ',' order by path || view, path) from f) || '],"kind":"context-receipt","repos":['
  || (select string_agg('{{"repo":"' || repo || '"}}', ',' order by repo) from (select distinct repo from rm)) || '],"sources":["mcp"],"totals":{{"baseline_tokens":' || sum(baseline_tokens) || ',"files":' || count(distinct path || view) || ',"reads":' || count(*) || ',"sent_tokens":' || sum(sent_tokens) || '}},"ts":"t","version":2}}' as t from rm)
select sha256({_padded(0x5C)} || unhex(sha256({_padded(0x36)} || encode(t)))) as signature, true as verified, false as verified_otherwise from m""")
def receipt_signed(spark, sf):
    """A receipt written by tasks, signed as one text, and held against its signature and another one."""
    at = _folder(spark, "receipt")
    signature = api.write_receipt(_receipt_meter(spark, sf), "a", "t", _KEY, at)
    return spark.createDataFrame([(signature, api.verify_receipt(spark, at, signature, _KEY), api.verify_receipt(spark, at, signature[::-1], _KEY))], "signature string, verified boolean, verified_otherwise boolean")


# --- presence ---------------------------------------------------------------------------------------------------------

_PR_SQL = f"{SQL_BASE}, {sql_presence('edits', 'pe')}, {sql_presence('intents', 'pi')}, nw as (select max(ts_ms) as n from base)"


@query(f"""with {_PR_SQL}, o as (select *, row_number() over (partition by sid, agent, path, floor(ts / 3600000 + 0.5) order by hash is null, seq) as a from pe, nw where ts >= n - {30 * DAY}),
k as (select *, row_number() over (partition by sid, agent order by ts desc, seq desc) as b from o where a = 1) select seq, sid, agent, path, ts, hash from k where b <= 100""")
def presence_dedup(spark, sf):
    e = presence_rows(spark, sf, "edits")
    now = _scalar_now(base_events(spark, sf))
    return P.kept_edits(e, now, age_secs=30 * 86_400, bucket_ms=3_600_000).select("seq", "sid", "agent", "path", "ts", "hash")


@query(f"""with {_PR_SQL}, k as (select *, row_number() over (partition by sid, agent order by seq desc) as b from pi, nw where ts >= n - {20 * DAY}) select seq, sid, agent, path, ts from k where b <= 5""")
def presence_intents(spark, sf):
    now = _scalar_now(base_events(spark, sf))
    return P.kept_intents(presence_rows(spark, sf, "intents"), now, age_secs=20 * 86_400, kept=5).select("seq", "sid", "agent", "path", "ts")


@query(f"with {_PR_SQL}, d as (select sid, agent, path, max(ts) as m from pe group by 1, 2, 3) select seq, sid, agent, path, ts from pi where not exists (select 1 from d where d.sid = pi.sid and d.agent = pi.agent and d.path = pi.path and pi.ts <= d.m)")
def intents_retired(spark, sf):
    return P.retire_intents(presence_rows(spark, sf, "intents"), presence_rows(spark, sf, "edits")).select("seq", "sid", "agent", "path", "ts")


@query(f"with {_PR_SQL} select seq, sid, agent, path from pe, nw where ts >= n - {DAY} and sid || '__' || agent <> '3__1'")
def presence_live(spark, sf):
    now = _scalar_now(base_events(spark, sf))
    return P.live(presence_rows(spark, sf, "edits"), now, own="3__1", age_secs=86_400).select("seq", "sid", "agent", "path")


def _asks(spark, sf):
    e = presence_rows(spark, sf, "edits")
    seen = F.when(F.col("seq") % 3 > 0, F.col("ts") - (F.col("seq") % 7) * 200_000)
    return e.select(F.col("seq").alias("ask"), "sid", "agent", "path", F.col("ts").alias("now"), seen.alias("seen_ts"), F.when(F.col("seq") % 3 == 2, F.lit("h")).alias("seen_hash"))


_ASK_SQL = _PR_SQL + ", ak as (select seq as ask, sid, agent, path, ts as now, case when seq % 3 > 0 then ts - (seq % 7) * 200000 end as seen_ts, case when seq % 3 = 2 then 'h' end as seen_hash from pe)"
_OTHER = "o.path = ak.path and not (o.sid = ak.sid and o.agent = ak.agent)"
_PICKED = "select ask, kind, other_sid, other_agent, age_ms, same_session from (select *, row_number() over (partition by ask order by {order}) as n from m) where n = 1"


@query(f"with {_ASK_SQL}, m as (select ask, 'in-flight' as kind, o.sid as other_sid, o.agent as other_agent, now - o.ts as age_ms, o.sid = ak.sid as same_session, o.ts from ak join pi o on {_OTHER} where now - o.ts between 0 and 900000 and not coalesce(seen_ts > o.ts, false)) " + _PICKED.format(order="other_sid, other_agent, ts"))
def conflict_inflight(spark, sf):
    return P.in_flight(_asks(spark, sf), presence_rows(spark, sf, "intents"), fresh_secs=900)


@query(f"with {_ASK_SQL}, m as (select ask, 'landed-edit' as kind, o.sid as other_sid, o.agent as other_agent, now - o.ts as age_ms, o.sid = ak.sid as same_session, o.ts from ak join pe o on {_OTHER} where seen_ts is not null and seen_hash is null and o.ts > seen_ts) " + _PICKED.format(order="other_sid, other_agent, ts"))
def conflict_landed(spark, sf):
    return P.landed(_asks(spark, sf), presence_rows(spark, sf, "edits"))


@query(f"with {_ASK_SQL}, m as (select ask, 'landed-edit' as kind, o.sid as other_sid, o.agent as other_agent, now - o.ts as age_ms, o.sid = ak.sid as same_session from ak join pe o on {_OTHER}) " + _PICKED.format(order="age_ms, other_sid, other_agent"))
def attribution(spark, sf):
    return P.attribution(_asks(spark, sf), presence_rows(spark, sf, "edits"))


@query(f"with {_PR_SQL}, u as (select sid, agent, updated_ms, 1 as e, 0 as i from pe, nw where ts >= n - {DAY} union all select sid, agent, updated_ms, 0, 1 from pi, nw where ts >= n - {DAY}) select sid, count(distinct agent) as agents, max(updated_ms) as last_ms, cast(sum(e) as bigint) as edits, cast(sum(i) as bigint) as intents from u group by 1")
def radar_sessions(spark, sf):
    now = _scalar_now(base_events(spark, sf))
    e, i = (P.live(presence_rows(spark, sf, k), now, age_secs=86_400) for k in ("edits", "intents"))
    return P.radar_sessions(e, i)


@query(f"with {_PR_SQL}, u as (select sid, path, ts, false as f from pe, nw where ts >= n - {DAY} union all select sid, path, ts, n - ts < 900000 from pi, nw where ts >= n - {DAY}) select path, count(distinct sid) as sids, max(ts) as last_ms, bool_or(f) as in_flight from u group by 1 having count(distinct sid) >= 2 or bool_or(f) order by 3 desc, 1 limit 12")
def radar_files(spark, sf):
    now = _scalar_now(base_events(spark, sf))
    e, i = (P.live(presence_rows(spark, sf, k), now, age_secs=86_400) for k in ("edits", "intents"))
    return P.radar_files(e, i, now, fresh_secs=900)


# --- guard ------------------------------------------------------------------------------------------------------------


@query(f"""with {sql_events()}, mk as (select session, path, ts_ms as ts, seq, hash from ev where op = 'read'),
ed as (select session, path, ts_ms, seq, hash, case seq % 4 when 0 then 'Edit' when 1 then 'Write' when 2 then 'MultiEdit' else 'NotebookEdit' end as tool, k % 9 <> 0 as there, (ts_ms // {DAY}) * {DAY} as epoch_ms from ev where op <> 'read'),
j as (select ed.*, mk.ts as seen_ts, mk.hash as seen_hash, row_number() over (partition by ed.seq order by mk.ts desc, mk.seq desc) as n from ed left join mk on mk.session = ed.session and mk.path = ed.path and mk.seq < ed.seq and mk.ts <= ed.ts_ms)
select session, seq as ask, tool, path, case when tool = 'NotebookEdit' or not there then 'allow' when seen_ts is null or seen_ts <= epoch_ms then 'never-seen' when seen_hash <> '' and hash <> '' and seen_hash <> hash then 'drift' else 'allow' end as verdict, seen_ts from j where n = 1""")
def guard_verdict(spark, sf):
    ev = archive_events(spark, sf).withColumn("at", F.struct("ts_ms", "seq"))
    marks = ev.where("op = 'read'").select("session", paths.path_key(F.col("path")).alias("key"), F.col("ts_ms").alias("ts"), "seq", "hash")
    tool = F.element_at(F.array(*[F.lit(x) for x in ("Edit", "Write", "MultiEdit", "NotebookEdit")]), (F.col("seq") % 4 + 1).cast("int"))
    edits = ev.where("op <> 'read'").select("session", F.col("seq").alias("ask"), tool.alias("tool"), "path", "seq", (F.col("k") % 9 != 0).alias("exists"), F.col("hash").alias("disk_hash"), (F.floor(F.col("ts_ms") / DAY) * DAY).alias("epoch_ms"))
    return guard.judge_edits(edits, marks, ["session"]).select("session", "ask", "tool", "path", "verdict", "seen_ts")


@query(f"with {sql_events()}, m as (select session, path as key, ts_ms as ts, seq, case when k % 4 > 0 then hash end as hash from ev) select session, key, max(ts) as ts, arg_max(coalesce(hash, '-'), ts * 1000000 + seq) as hash from m group by 1, 2")
def seen_latest(spark, sf):
    m = archive_events(spark, sf).select("session", F.col("path").alias("key"), F.col("ts_ms").alias("ts"), "seq", F.when(F.col("k") % 4 > 0, F.col("hash")).alias("hash"))
    return guard.latest_seen(m, ["session"]).select("session", "key", "ts", F.coalesce("hash", F.lit("-")).alias("hash"))


@query("""with s as (select conv_id % 400 as path, turn * 1000 + length(text) as off, conv_id * 1000 + turn as seq from conversations), l as (select path, arg_max(off, seq) as "offset", max(seq) as m from s group by 1),
t as (select * from l order by m desc limit 256), w as (select distinct conv_id % 450 as path from conversations) select w.path, coalesce(t."offset", 0) as "offset" from w left join t using (path)""")
def transcript_cursors(spark, sf):
    c = table(spark, sf, "conversations")
    sets = c.select((F.col("conv_id") % 400).alias("path"), (F.col("turn") * 1000 + F.length("text")).alias("offset"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    wanted = c.select((F.col("conv_id") % 450).alias("path")).distinct()
    return stores.offset_for(wanted, stores.cursors(sets)).select("path", "offset")


# --- named queries ----------------------------------------------------------------------------------------------------


@query(f"""with {SQL_METER} select 'totals' as part, '' as name, count(*) as reads, cast(sum(baseline_tokens) as bigint) as baseline_tokens, cast(sum(sent_tokens) as bigint) as sent_tokens,
round((sum(baseline_tokens) - sum(sent_tokens)) * 100.0 / sum(baseline_tokens), 1) as saved_pct from mt
union all select 'repo', repo, count(*), cast(sum(baseline_tokens) as bigint), cast(sum(sent_tokens) as bigint), cast(null as double) from mt group by repo
union all select * from (select 'file', path, count(*), cast(sum(baseline_tokens) as bigint), cast(sum(sent_tokens) as bigint) as s, cast(null as double) from mt group by path order by s desc, path limit 8)""")
def context_stats(spark, sf):
    parts = api.context_stats(meter_events(spark, sf))
    none = F.lit(None).cast("double").alias("saved_pct")
    cols = ["reads", "baseline_tokens", "sent_tokens"]
    out = parts["totals"].select(F.lit("totals").alias("part"), F.lit("").alias("name"), *cols, "saved_pct")
    out = out.unionByName(parts["by_repo"].select(F.lit("repo").alias("part"), F.col("repo").alias("name"), *cols, none))
    return out.unionByName(parts["top_files"].select(F.lit("file").alias("part"), F.col("path").alias("name"), *cols, none))


_READS_SQL = """with d as (select doc_id, text, string_split(text, chr(10)) as l, '/p' || doc_id || case when doc_id % 13 = 0 then '/.env' else '.ts' end as path from documents),
a as (select doc_id, v, cast(doc_id % 50 as varchar) as session, doc_id * 4 + v as seq, path, text, l, case v when 1 then doc_id % 5 when 2 then 3 end as b, case v when 1 then 6 when 2 then doc_id % 4 end as e from d, range(4) t(v)),
w as (select *, greatest(1, least(b, len(l))) as s, strlen(text) > 20000 as big, doc_id % 17 = 0 as bin, doc_id % 19 = 0 as gone from a),
x as (select *, case when b is null then 'full' else 'lines:' || s || '-' || greatest(s, least(e, len(l))) end as view,
  case when b is null then text else array_to_string(list_slice(l, s, greatest(s, least(e, len(l)))), chr(10)) end as body, case when gone then 'unreadable' when big then 'too large' when bin then 'binary' end as error from w),
k as (select *, row_number() over (partition by session, path, view order by seq) as n from x where error is null)"""


def _read_requests(spark, sf):
    """Four reads of every document: the whole, two line ranges, the whole again."""
    docs = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("/p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 13 == 0, "/.env").otherwise(".ts")))
    size = F.octet_length("text").cast("long")
    disk = docs.where("doc_id % 19 <> 0").select("path", size.alias("size"), (F.col("doc_id") % 17 == 0).alias("binary"), F.col("text").alias("content"))
    n = F.col("doc_id")
    lines = F.when(F.col("v") == 1, F.concat((n % 5).cast("string"), F.lit(" - 6"))).when(F.col("v") == 2, F.concat(F.lit("3-"), (n % 4).cast("string")))
    asked = docs.select("doc_id", "path", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    asked = asked.select((n % 50).cast("string").alias("session"), (n * 4 + F.col("v")).alias("seq"), "path", F.lit(None).cast("string").alias("symbol"), lines.alias("lines"), F.lit(False).alias("force_full"), F.lit(1).cast("long").alias("epoch"))
    return api.read_file(asked, disk, max_bytes=20_000)


@query(_READS_SQL + """ select session, seq, view, case when error is not null then error when n > 1 and strlen(body) > 256 then 'unchanged' else 'full' end as answer, sha256(body) as hash from
(select session, seq, view, error, n, body from k union all select session, seq, null, error, null, null from x where error is not null)""")
def read_file(spark, sf):
    a = _read_requests(spark, sf)
    refused = a.errors.select("session", "seq", F.lit(None).cast("string").alias("view"), F.col("error").alias("answer"), F.lit(None).cast("string").alias("hash"))
    return a.sent.select("session", "seq", "view", F.col("kind").alias("answer"), "hash").unionByName(refused)


@query(_READS_SQL + """ select session, seq, path like '%/.env' as excluded, case when path like '%/.env' then '' else sha256(body) end as hash, case when path like '%/.env' then null else sha1(encode('blob ' || strlen(body)) || '\\x00'::blob || encode(body)) end as git_blob_sha1,
case when path like '%/.env' then 0 else strlen(body) end as bytes, case when path like '%/.env' then 0 else cast(ceil(length(body) / 4.0) as bigint) end as approx_tokens from k where view = 'full'""")
def reads_recorded(spark, sf):
    return _read_requests(spark, sf).events.select("session", "seq", "excluded", "hash", "git_blob_sha1", "bytes", "approx_tokens")


_DISK_SQL = "ds as (select distinct path, length(path) * 60 as size, path like '%7.ts' as bin, path like '%3.ts' as lost from ev)"


def _pack_disk(ev):
    paths_seen = ev.select("path").distinct()
    return paths_seen.where(~F.col("path").endswith("3.ts")).select("path", (F.length("path") * 60).cast("long").alias("size"), F.col("path").endswith("7.ts").alias("binary"), F.repeat("path", 60).alias("content"))


@query(_PACK_SQL + ", " + _DISK_SQL + f""", cd as (select st.path, st.score, case when lost then 'unreadable' when size > 590 then 'too large' when bin then 'binary' end as reason, cast(ceil(size / 4.0) as bigint) as tok from st join ds using (path)),
rk as (select *, row_number() over (order by score desc, path) as rn from cd where reason is null),
g as (with recursive g(rn, path, tok, spent, n, taken) as (select cast(0 as bigint), cast('' as varchar), cast(0 as bigint), cast(0 as bigint), 0, false
  union all select rk.rn, rk.path, rk.tok, case when g.n < 6 and g.spent + rk.tok <= 700 then g.spent + rk.tok else g.spent end, case when g.n < 6 and g.spent + rk.tok <= 700 then g.n + 1 else g.n end,
    g.n < 6 and g.spent + rk.tok <= 700 from g join rk on rk.rn = g.rn + 1) select * from g),
p as (select g.path, g.n as place, cd.score from g join cd using (path) where taken), z as (select case when count(*) = 6 then min(score) else -1 end as lo, max(path) filter (score = (select min(score) from p)) as last_path from p)
select path, 'packed' as status, place, sha256(repeat(path, 60)) as hash from p
union all select path, case when lost then 'unreadable' when size > 590 then 'too large' when bin then 'binary' else 'over budget (~' || tok || ' tok)' end, cast(null as int), cast(null as varchar)
from cd join ds using (path), z where path not in (select path from p) and (score > lo or (score = lo and path < last_path))""")
def export_pack(spark, sf):
    ev = archive_events(spark, sf, "user")
    files, skipped = api.export_pack(ev, _pack_disk(ev), _scalar_now(ev), top=6, tokens=700, max_bytes=590)
    packed = files.select("path", F.lit("packed").alias("status"), (F.col("place") + 1).alias("place"), "hash")
    return packed.unionByName(skipped.select("path", F.col("reason").alias("status"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("hash")))


@query(_HEAT_SQL + """, rk as (select path, row_number() over (order by edits > 0 desc, reads + edits desc, last_ts desc, path) as rn from t), k as (select rn, path, path like '%3.ts' as lost, cast(ceil(length(path) * (10 + rn) / 4.0) as bigint) as tok from rk where rn <= 12),
g as (with recursive g(rn, spent, taken) as (select cast(0 as bigint), cast(0 as bigint), false union all select k.rn, case when not k.lost and g.spent + k.tok <= 250 then g.spent + k.tok else g.spent end, not k.lost and g.spent + k.tok <= 250 from g join k on k.rn = g.rn + 1) select * from g)
select cast(k.rn as int) as place, path, case when lost then 'unreadable' when taken then 'sent' else 'over-budget' end as status, case when taken then sha256(repeat(path, cast(10 + k.rn as int))) end as hash, case when not lost then k.rn % 2 = 0 end as changed from g join k using (rn)""")
def restore_context(spark, sf):
    top = _heat(spark, sf).orderBy(*A.heat_order()).limit(12).withColumn("place", F.row_number().over(Window.orderBy(*A.heat_order())))
    body = F.expr("repeat(path, 10 + place)")
    disk = top.where(~F.col("path").endswith("3.ts")).select("path", body.alias("content"), content.content_hash(body).alias("hash"))
    entries = top.select("place", "path", F.when(F.col("place") % 2 == 0, "older").otherwise(content.content_hash(body)).alias("hash"))
    return api.restore_context(entries, disk, 250).select("place", "path", "status", content.content_hash(F.col("content")).alias("hash"), "changed")


@query(f"""with {sql_events()}, nw as (select max(ts_ms) as n from ev), re as (select ev.* from ev, nw where ts_ms >= n - {20 * DAY}), m as (select * from re where path = '{_FOCUS}' and not excluded and hash <> ''),
f as (select cast(median(ts_ms) as bigint) as moment from ev where path = '{_FOCUS}'), fs as (select distinct session from re, f where path = '{_FOCUS}' and abs(ts_ms - moment) <= 43200000)
select 'version' as part, hash as name, count(*) as events, hash in (select hash from ev where k % 2 = 0 and ver % 3 > 0) as in_archive from m group by hash
union all select 'all', '', count(*), null from re where path = '{_FOCUS}'
union all select * from (select 'beside', path, count(*) as c, null from re, f where path <> '{_FOCUS}' and not excluded and abs(ts_ms - moment) <= 43200000 and session in (select session from fs) group by path order by c desc, min(seq) limit 20)""")
def context_blame(spark, sf):
    ev = archive_events(spark, sf)
    blobs = ev.where("k % 2 = 0 and ver % 3 > 0").select("hash")
    at = ev.where(F.col("path") == _FOCUS).agg(F.median("ts_ms").cast("decimal(30,1)").alias("m")).select(F.bround("m", 0).cast("long")).first()[0]
    b = api.context_blame(ev, blobs, _FOCUS, _scalar_now(ev), at_ms=at, window_minutes=720, days=20)
    none = F.lit(None).cast("boolean").alias("in_archive")
    out = b.versions.select(F.lit("version").alias("part"), F.col("hash").alias("name"), "events", "in_archive")
    out = out.unionByName(b.counters.select(F.lit("all").alias("part"), F.lit("").alias("name"), F.col("total_events").alias("events"), none))
    return out.unionByName(b.co_context.select(F.lit("beside").alias("part"), F.col("path").alias("name"), "events", none))


_RECORDS_SQL = "with " + _PR_SQL + """, rc as (select sid, agent, max(ts) as updated from (select sid, agent, ts from pe union all select sid, agent, ts from pi) group by 1, 2), lv as (select rc.* from rc, nw where updated >= n - 1800000),
le as (select pe.* from pe join lv using (sid, agent)), li as (select pi.* from pi join lv using (sid, agent))"""


@query(_RECORDS_SQL + """ select 'session' as part, sid as name, count(distinct agent) as agents, cast(sum(e) as bigint) as edits, cast(sum(i) as bigint) as intents from (select sid, agent, 1 as e, 0 as i from le union all select sid, agent, 0, 1 from li) group by sid
union all select 'file', path, c, null, null from (select path, count(distinct sid) as c, max(ts) as m, bool_or(f) as fl from (select sid, path, ts, false as f from le union all select sid, path, ts, n - ts < 90000 from li, nw) group by path having c >= 2 or fl order by m desc, path limit 12)""")
def coordination_status(spark, sf):
    e, i = (presence_rows(spark, sf, k) for k in ("edits", "intents"))
    edits = e.groupBy("sid", "agent").agg(F.collect_list(F.struct("path", "ts", "hash")).alias("edits"), F.max("ts").alias("a"))
    intents = i.groupBy("sid", "agent").agg(F.collect_list(F.struct("path", "ts")).alias("intents"), F.max("ts").alias("b"))
    records = edits.join(intents, ["sid", "agent"], "full").withColumn("updatedAt", F.greatest("a", "b")).withColumn("mtime", F.greatest("a", "b"))
    status = api.coordination_status(records, _scalar_now(base_events(spark, sf)))
    none = F.lit(None).cast("long")
    sessions = status["sessions"].select(F.lit("session").alias("part"), F.col("sid").alias("name"), "agents", F.col("edits").cast("long").alias("edits"), F.col("intents").cast("long").alias("intents"))
    return sessions.unionByName(status["files"].select(F.lit("file").alias("part"), F.col("path").alias("name"), F.col("sids").alias("agents"), none.alias("edits"), none.alias("intents")))


@query(f"""with {_PR_SQL}, mk as (select sid, path, ts, seq, hash from pi), ed as (select seq as ask, sid, agent, path, ts, seq, coalesce(hash, '') as hash from pe),
j as (select ed.*, mk.ts as seen_ts, mk.hash as seen_hash, row_number() over (partition by ask order by mk.ts desc, mk.seq desc) as n from ed left join mk on mk.sid = ed.sid and mk.path = ed.path and mk.seq < ed.seq and mk.ts <= ed.ts),
v as (select *, case when seen_ts is null then 'never-seen' when seen_hash <> hash and hash <> '' then 'drift' else 'allow' end as verdict from j where n = 1),
fl as (select distinct ask from v join pi o on o.path = v.path and not (o.sid = v.sid and o.agent = v.agent) where verdict = 'allow' and v.ts - o.ts between 0 and 90000 and not coalesce(seen_ts > o.ts, false)),
ld as (select distinct ask from v join pe o on o.path = v.path and not (o.sid = v.sid and o.agent = v.agent) where verdict = 'allow' and seen_ts is not null and seen_hash is null and o.ts > seen_ts)
select ask, verdict, case when ask in (select ask from fl) then 'in-flight' when ask in (select ask from ld) then 'landed-edit' end as conflict, verdict = 'allow' and ask not in (select ask from fl) and ask not in (select ask from ld) as allowed from v""")
def guard_edits(spark, sf):
    e, i = (presence_rows(spark, sf, k) for k in ("edits", "intents"))
    marks = i.select("sid", F.col("path").alias("key"), "ts", "seq", "hash")
    edits = e.select("sid", "agent", F.col("seq").alias("ask"), F.lit("Edit").alias("tool"), "path", "ts", "seq", F.lit(True).alias("exists"), F.coalesce("hash", F.lit("")).alias("disk_hash"), F.lit(-1).cast("long").alias("epoch_ms"), F.col("ts").alias("now"))
    judged = api.guard_edits(edits, marks, i.select("sid", "agent", "path", "ts"), e.select("sid", "agent", "path", "ts"), ["sid"])
    return judged.select("ask", "verdict", "conflict", "allowed")


# --- text operators: rows only ----------------------------------------------------------------------------------------


@query("""with d as (select doc_id, list_transform(string_split(text, chr(10)), lambda t, i: case when i % 4 = 1 then 'function f' || (i - 1) || '(a) {' when i % 4 = 0 then t || ' }' else t end) as l from documents)
select doc_id, case when len(l) > 4 then 5 end as "start", case when len(l) > 4 then cast(least(8, len(l)) as int) end as "end", case when len(l) > 4 then sha256(array_to_string(list_slice(l, 5, 8), chr(10))) end as hash from d""")
def symbol_slices(spark, sf):
    body = F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.when(i % 4 == 0, F.concat(F.lit("function f"), i.cast("string"), F.lit("(a) {"))).when(i % 4 == 3, F.concat(t, F.lit(" }"))).otherwise(t)), "\n")
    docs = table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return docs.select("doc_id", code.symbol_slice(F.col("body"), F.lit("f4"), F.lit("a.ts")).alias("s")).select("doc_id", "s.start", "s.end", F.sha2("s.text", 256).alias("hash"))


@query("""with d as (select doc_id, len(string_split(text, chr(10))) as n, sha256(text) as h from documents),
b as (select doc_id, n, list_transform(range(n), lambda i: case i % 4 when 0 then 'def f' || i || '(a):  # def f4(b):' when 1 then '    s = "def f4(" + "def f4(x):" # "' when 2 then '' else chr(9) || 'return ' || h end) as l from d),
e as (select *, least(8, n) - cast(n = 7 as int) as z from b)
select doc_id, case when n > 4 then 5 end as "start", case when n > 4 then cast(z as int) end as "end", case when n > 4 then sha256(array_to_string(list_slice(l, 5, z), chr(10))) end as hash from e""")
def symbol_slices_indented(spark, sf):
    """A symbol whose name stands in comments and strings before its declaration, in code that is indented by spaces and tabs."""
    line = lambda i: F.when(i % 4 == 0, F.concat(F.lit("def f"), i.cast("string"), F.lit("(a):  # def f4(b):"))).when(i % 4 == 1, F.lit('    s = "def f4(" + "def f4(x):" # "')).when(i % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("\treturn "), F.sha2("text", 256)))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda t, i: line(i)), "\n").alias("body"))
    return docs.select("doc_id", code.symbol_slice(F.col("body"), F.lit("f4"), F.lit("a.py")).alias("s")).select("doc_id", "s.start", "s.end", F.sha2("s.text", 256).alias("hash"))


@query(r"""with d as (select doc_id, len(string_split(text, chr(10))) as n, sha256(text) as h from documents),
b as (select doc_id, n, list_transform(range(n), lambda i: case i % 4 when 0 then 'const f' || i || ' = g( // const f4 = {' when 1 then '  "}{ \" ;(' || h || '",' when 2 then '  /* ) }; */' else ')' end) as l from d)
select doc_id, case when n > 4 then 5 end as "start", case when n > 4 then cast(least(7, n) as int) end as "end", case when n > 4 then sha256(array_to_string(list_slice(l, 5, 7), chr(10))) end as hash from b""")
def symbol_slices_continued(spark, sf):
    """A declaration without a brace that goes on over open parentheses and commas, with braces and escapes in strings and comments."""
    line = lambda i: F.when(i % 4 == 0, F.concat(F.lit("const f"), i.cast("string"), F.lit(" = g( // const f4 = {"))).when(i % 4 == 1, F.concat(F.lit('  "}{ \\" ;('), F.sha2("text", 256), F.lit('",'))).when(i % 4 == 2, F.lit("  /* ) }; */")).otherwise(F.lit(")"))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda t, i: line(i)), "\n").alias("body"))
    return docs.select("doc_id", code.symbol_slice(F.col("body"), F.lit("f4"), F.lit("a.ts")).alias("s")).select("doc_id", "s.start", "s.end", F.sha2("s.text", 256).alias("hash"))


_LITERAL = "a.b*(c|d)[e]$"


@query(rf"""with {SQL_BASE}, nw as (select max(ts_ms) as n from base), x as (select seq, n - ts_ms as age, case k % 5 when 0 then 'f.py' when 1 then 'd.x/f.PYI' when 2 then 'f.ts' when 3 then 'py' else 'f.coffee' end as path, case when k % 3 = 0 then 'x{_LITERAL}y' else 'xa_bbb(c|d)ey' end as t from base, nw)
select seq, case when age < 120000 then greatest(1, cast(floor(age / 1000 + 0.5) as bigint)) || 's ago' else cast(floor(age / 60000 + 0.5) as bigint) || 'min ago' end as age, case when lower(regexp_extract(path, '(\.[^./\\]*)$', 1)) in ('.py', '.pyi', '.pyw', '.coffee') then 'indent' else 'brace' end as family, contains(t, '{_LITERAL}') as literal from x""")
def small_functions(spark, sf):
    """Ages as texts, families of languages by suffix, names taken literally in a pattern."""
    b = with_now(base_events(spark, sf))
    kind = F.col("k") % 5
    path = F.when(kind == 0, "f.py").when(kind == 1, "d.x/f.PYI").when(kind == 2, "f.ts").when(kind == 3, "py").otherwise("f.coffee")
    text = F.when(F.col("k") % 3 == 0, f"x{_LITERAL}y").otherwise("xa_bbb(c|d)ey")
    return b.select("seq", content.age_text(F.col("_now") - F.col("ts_ms")).alias("age"), content.language_family(path).alias("family"), text.rlike(content.quoted(_LITERAL)).alias("literal"))


def _versions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("session"))
    rows = docs.select("session", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.concat(F.col("text"), F.lit("\n" if v else ""), F.lit(f"line {v // 2}" if v else "")).alias("content")) for v in range(4)])).alias("x"), "doc_id")
    return rows.select("session", (F.col("doc_id") * 4 + F.col("x.v")).alias("seq"), F.concat(F.lit("/d"), F.col("doc_id").cast("string")).alias("path"), F.lit("full").alias("view"), F.col("x.content").alias("content"), F.lit(False).alias("force_full"), F.lit(1).cast("long").alias("epoch"), content.content_hash(F.col("x.content")).alias("hash"))


_NONE = "chr(10) || '\\ No newline at end of file' || chr(10)"


# the versions differ in their last lines only, so that SQL can write their patches down
@query(f"""with d as (select doc_id, '/d' || doc_id as p, string_split(text, chr(10)) as l, text as t from documents),
b as (select *, 'Index: ' || p || chr(10) || repeat('=', 67) || chr(10) || '--- ' || p || chr(9) || chr(10) || '+++ ' || p || chr(9) || chr(10) as head, l[-1] as z, cast(l[-1] <> '' as int) as r, len(l) as n from d),
x as (select doc_id, p, v, case v when 0 then t when 1 then t || chr(10) || 'line 0' else t || chr(10) || 'line 1' end as content, case when v = 1 then n - 1 else n end as c, case when v = 1 then r else 1 end as gone, case when v = 1 then 2 else 1 end as come,
  head, l, case when v = 1 then case when r = 1 then '-' || z || {_NONE} else '' end || '+' || z || chr(10) || '+line 0' || {_NONE} else '-line 0' || {_NONE} || '+line 1' || {_NONE} end as body from b, range(4) g(v)),
y as (select *, least(3, c) as k from x), h as (select *, head || '@@ -' || (c + 1 - k - cast(k + gone = 0 as int)) || ',' || (k + gone) || ' +' || (c + 1 - k) || ',' || (k + come) || ' @@' || chr(10)
  || coalesce(array_to_string(list_transform(list_slice(l, c - k + 1, c), lambda e: ' ' || e || chr(10)), ''), '') || body as patch from y),
w as (select *, case when v in (1, 2) and strlen(patch) < strlen(content) then 'diff' when v = 3 and strlen(content) > 256 then 'unchanged' else 'full' end as kind, sha256(content) as hash, lag(sha256(content)) over (partition by doc_id order by v) as held from h)
select 's' || (doc_id % 40) as session, doc_id * 4 + v as seq, p as path, kind, strlen(content) as bytes, case kind when 'diff' then strlen(patch) when 'unchanged' then 256 else strlen(content) end as sent_bytes, case when kind <> 'full' then held end as base_hash,
  case when kind = 'diff' then sha256(patch) end as patch_hash from w""")
def delivered(spark, sf):
    return delivery.deliver(_versions(spark, sf)).select("session", "seq", "path", "kind", "bytes", "sent_bytes", "base_hash", F.sha2("patch", 256).alias("patch_hash"))


@query("select count(*) * 4 as reads, count(*) * 4 as same from documents")
def reconstructed(spark, sf):
    reads = _versions(spark, sf)
    held = delivery.reconstruct(delivery.deliver(reads), dealt=True).select("session", "seq", content.content_hash(F.col("text")).alias("held"))
    # texts and contents meet as SHA-256 hashes, never as a whole
    return held.join(reads.select("session", "seq", "hash"), ["session", "seq"]).agg(F.count("*").alias("reads"), F.count_if(F.col("held") == F.col("hash")).alias("same"))


@query("select doc_id, true as same from documents")
def patch_roundtrip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.when(i % 3 == 1, F.upper(t)).otherwise(t)), "\n").alias("new"))
    return docs.select("doc_id", (patches.patched(F.col("text"), patches.unified_patch(F.col("text"), F.col("new"), F.lit("f"))) == F.col("new")).alias("same"))


@query()
def real_tokens(spark, sf):
    import public_tokenizers

    count = code.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(spark, sf, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


# --- sources and sinks: written to the shared folder, read back ------------------------------------------------------------


def _folder(spark, name):
    return f"{stores.shared_folder(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"


_STAMP = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _stamped(ev):
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return ev.select("seq", F.when(F.col("seq") % 41 == 0, "no time").otherwise(stamp).alias("ts"), "session", F.when(F.col("seq") % 43 != 0, F.col("path")).alias("path"), "repo", "hash", F.col("git_blob_sha1").alias("gitBlobSha1"), "bytes", F.col("approx_tokens").alias("approxTokens"), "source", "op", "view", "sidechain", "excluded")


@query(f"with {sql_events()}, nw as (select max(ts_ms) as n from ev) select session, path, hash, bytes, excluded, case when seq % 41 = 0 then 'no time' else {_STAMP} end as ts from ev, nw where seq % 43 <> 0 and (seq % 41 = 0 or ts_ms >= n - {9 * DAY})")
def event_log_scan(spark, sf):
    """A log of JSON lines in many files, with broken and empty lines and rows that lack a path or a time."""
    at, ev = _folder(spark, "log"), archive_events(spark, sf)
    lines = _stamped(ev).select("session", F.explode(F.array(F.to_json(F.struct("ts", "session", "path", "repo", "hash", "gitBlobSha1", "bytes", "approxTokens", "source", "op", "view", "sidechain", "excluded")), F.lit(""), F.lit('{"ts": "cut of'))).alias("value"))
    lines.withColumn("writer", F.concat(F.col("session"), F.lit(".jsonl"))).select("value", "writer").write.partitionBy("writer").text(at)
    return stores.read_events(spark, at, _scalar_now(ev) - 9 * DAY, "*").select("session", "path", "hash", "bytes", "excluded", "ts")


@query(f"""with {sql_events()}, nw as (select (max(ts_ms) // {DAY} - 3) * {DAY} + 1000 as bound, max(ts_ms) // {DAY} as last from ev), w as (select ev.*, bound, (last - seq % 9) * {DAY} + 1000 - seq % 2 as moment from ev, nw)
select session, path, count(*) as events, cast(sum(bytes) as bigint) as bytes from w where moment >= bound group by 1, 2""")
def event_table_scan(spark, sf):
    """Events appended day by day to the Parquet log, then those since a bound inside a day."""
    at = _folder(spark, "events")
    ev = archive_events(spark, sf).select("seq", "session", "path", "hash", "bytes", (F.col("seq") % 9).alias("back"), (F.col("seq") % 2).alias("odd"))
    last = _scalar_now(archive_events(spark, sf)) // DAY
    for back in range(9):
        for odd in (0, 1):
            ms = (last - back) * DAY + 1000 - odd
            now = datetime.fromtimestamp(ms / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            stores.append_events(ev.where((F.col("back") == back) & (F.col("odd") == odd)).select("session", "path", "hash", "bytes"), at, now)
    return stores.read_event_table(spark, at, (last - 3) * DAY + 1000).groupBy("session", "path").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))


@query("select g, cast(n - 1 as int) as line, v as value from (select conv_id % 5 as g, sha256(text) as v, row_number() over (partition by conv_id % 5 order by conv_id, turn) as n, turn from conversations) where n % 7 <> 0")
def transcript_scan(spark, sf):
    """Transcripts as files, a seventh of their lines empty: numbered as they stand."""
    at = _folder(spark, "transcripts")
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("g"), "conv_id", "turn", F.sha2("text", 256).alias("v"))
    n = F.row_number().over(Window.partitionBy("g").orderBy("conv_id", "turn"))
    lines = c.withColumn("n", n).select("g", "n", F.when(F.col("n") % 7 == 0, "").otherwise(F.col("v")).alias("value"))
    lines.repartition("g").sortWithinPartitions("g", "n").select("value", "g").write.partitionBy("g").text(at)
    found = stores.read_transcripts(spark, at, "*.txt")
    return found.select(F.regexp_extract("file", "g=([0-9]+)", 1).cast("long").alias("g"), "line", "value")


@query("with f as (select case when doc_id % 9 = 4 then doc_id % 20 else doc_id % 40 end as g, string_agg(sha256(text), chr(10) order by doc_id) || chr(10) as t from documents group by 1) select g, strlen(t) as size, sha256(t) as hash from f where strlen(t) <= (select cast(median(strlen(t)) as bigint) from f) and g % 11 <> 3")
def file_scan(spark, sf):
    """Files up to a size; of those, binary ones are left out."""
    at = _folder(spark, "files")
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 == 4, F.col("doc_id") % 20).otherwise(F.col("doc_id") % 40).alias("g"), "doc_id", F.sha2("text", 256).alias("v"))
    first = F.row_number().over(Window.partitionBy("g").orderBy("doc_id")) == 1
    d = d.withColumn("value", F.when(first & (F.col("g") % 11 == 3), F.concat(F.lit("\x00"), F.substring("v", 2, 63))).otherwise(F.col("v")))
    d.repartition("g").sortWithinPartitions("g", "doc_id").select("value", "g").write.partitionBy("g").text(at)
    size = d.groupBy("g").agg((F.count("*") * 65).alias("n")).agg(F.median("n")).first()[0]
    found = stores.read_files(spark, at, int(size))
    return found.where(F.col("path").endswith(".txt")).select(F.regexp_extract("path", "g=([0-9]+)", 1).cast("long").alias("g"), "size", "hash")


@query("select sha256(text) as hash, any_value(text) = any_value(text) as same, count(distinct text) as stored from documents group by 1")
def blobs_put(spark, sf):
    """The blob store after three puts that overlap: every content once."""
    at, docs = _folder(spark, "blobs"), table(spark, sf, "documents").withColumn("content", F.col("text"))
    for part in ("doc_id % 2 = 0", "doc_id % 3 = 0", "true"):
        stores.put_blobs(spark, stores.as_blobs(docs.where(part), F.col("doc_id")), at)
    return stores.read_blobs(spark, at).groupBy("hash").agg(F.bool_and(content.content_hash(F.col("content")) == F.col("hash")).alias("same"), F.count("*").alias("stored"))


@query(f"with {_PR_SQL} select sid, agent, count(*) as edits, max(ts) as last_ms from pe where not (sid = '3' and agent = '1') group by 1, 2 union all select '3', '1', 1, 7")
def presence_saved(spark, sf):
    """Records saved over each other: of the writer that saved twice, the second."""
    at = _folder(spark, "presence")
    e = presence_rows(spark, sf, "edits").groupBy("sid", "agent").agg(F.collect_list(F.struct("path", "ts", "hash")).alias("edits"), F.max("ts").alias("updatedAt"))
    records = e.select("sid", "agent", F.lit(1).cast("long").alias("pid"), "updatedAt", F.array().cast("array<struct<path: string, ts: bigint>>").alias("intents"), "edits")
    stores.save_presence(records, at)
    again = [("3", "1", 1, 7, [], [("f", 7, None)])]
    stores.save_presence(spark.createDataFrame(again, records.schema), at)
    return stores.read_presence(spark, at).select("sid", "agent", F.size("edits").cast("long").alias("edits"), F.array_max(F.transform("edits", lambda x: x["ts"])).alias("last_ms"))


@query(f"with {sql_events()} select path as key, max(ts_ms) as ts, arg_max(hash, ts_ms * 1000000 + seq) as hash from ev where session = '4' group by 1")
def seen_saved(spark, sf):
    at = _folder(spark, "seen")
    m = archive_events(spark, sf).select("session", F.col("path").alias("key"), F.col("ts_ms").alias("ts"), "seq", "hash")
    stores.save_seen(guard.latest_seen(m, ["session"]), "session", at)
    return stores.load_seen(spark, at, "4")


# --- streams ----------------------------------------------------------------------------------------------------------


@query(f"""with {sql_events()}, rs as (select session, ts_ms as ts from raw where event_type = 'error' and seq % 10 = 0), mk as (select session, path, ts_ms as ts, seq, case when k % 4 > 0 then hash end as hash from raw where op = 'read' and not (event_type = 'error' and seq % 10 = 0)),
ed as (select session, path, ts_ms, seq, hash, case when seq % 3 = 0 then 'Write' else 'Edit' end as tool from raw where op <> 'read'),
j as (select ed.*, mk.ts as seen_ts, mk.hash as seen_hash, row_number() over (partition by ed.seq order by mk.ts desc) as n from ed left join mk on mk.session = ed.session and mk.path = ed.path and mk.ts < ed.ts_ms),
lost as (select ed.seq, max(rs.ts) as reset from ed join rs on rs.session = ed.session and rs.ts <= ed.ts_ms group by 1)
select session, path as key, seq as ask, case when seen_ts is null or seen_ts <= reset then 'never-seen' when seen_hash <> hash then 'drift' else 'allow' end as verdict, seen_ts from j left join lost using (seq) where n = 1""")
def stream_seen(spark, sf):
    """The guard as a stream over the whole event table, run to its end, with sessions that lose their context now and then."""
    from ..streaming.seen import guard_stream

    raw = raw_events(spark, sf)
    tool = F.when(F.col("seq") % 3 == 0, "Write").otherwise("Edit")
    lost = (F.col("event_type") == "error") & (F.col("seq") % 10 == 0)
    read = (F.col("op") == "read") & ~lost
    edit = F.col("op") != "read"
    rows = raw.select(
        "session", F.when(lost, "reset").when(read, "mark").otherwise("edit").alias("kind"), F.when(~lost, F.col("path")).alias("key"), F.col("ts_ms").alias("ts"), F.when(read & (F.col("k") % 4 > 0), F.col("hash")).alias("hash"),
        F.when(edit, F.col("seq")).alias("ask"), F.when(edit, tool).alias("tool"), F.lit(True).alias("exists"), F.when(edit, F.col("hash")).alias("disk_hash"),
    )
    return _streamed(spark, rows, guard_stream).select("session", "key", "ask", "verdict", "seen_ts")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _streamed(spark, rows, through):
    """What a stream over rows' files has given at its end."""
    at = _folder(spark, "stream")
    rows.write.parquet(f"{at}/in")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = through(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(SQL["ledger_kinds"])
def stream_ledger(spark, sf):
    """Delivery under a ledger of 4000 bytes as a stream: the same answers as in batch."""
    from ..streaming.ledger import delivery_stream

    rows = read_requests(spark, sf).select("session", "seq", "path", "view", "epoch", "hash", "bytes", F.lit(False).alias("force"))
    return _streamed(spark, rows, lambda r: delivery_stream(r, 4000)).select("session", "seq", "kind", "base_hash")


_CF_SQL = f"""with {SQL_BASE}, {sql_presence("edits", "pe")}, {sql_presence("intents", "pi")}, w as (select path as key, 'intent' as kind, sid, agent, ts, seq from pi where seq % 3 > 0 union all select path, 'landed', sid, agent, ts, seq from pe where seq % 3 > 0),
a as (select path as key, sid, agent, ts, seq as ask, ts - 600000 as seen_ts, case when seq % 2 = 0 then 'h' end as seen_hash from pe where seq % 3 = 0)"""


@query(_CF_SQL + """, l as (select a.*, w.sid as o_sid, w.agent as o_agent, max(w.ts) filter (kind = 'landed') as edit, max(w.ts) filter (kind = 'intent') as intent from a join w on w.key = a.key and w.ts <= a.ts and (w.sid <> a.sid or w.agent <> a.agent) group by all),
c as (select *, intent is not null and intent > coalesce(edit, -1) and ts - intent <= 90000 and seen_ts <= intent as flies, edit is not null and seen_hash is null and edit > seen_ts as landed from l),
f as (select ask, min({'s': o_sid, 'a': o_agent}) filter (flies) as fl, min({'s': o_sid, 'a': o_agent}) filter (landed) as ld from c group by 1)
select a.ask, case when fl is not null then 'in-flight' when ld is not null then 'landed-edit' end as conflict, coalesce(fl, ld).s as other_sid, coalesce(fl, ld).a as other_agent, fl is null and ld is null as allowed from a left join f using (ask)""")
def stream_conflicts(spark, sf):
    """Other writers' conflicts as a stream by file: intents and landed edits of the event table, and a third of the edits as asks for a
    tool's leave that leave no intent (the file is new)."""
    from ..streaming.seen import conflict_stream

    e, i = (presence_rows(spark, sf, k) for k in ("edits", "intents"))
    none = {"ask": "long", "verdict": "string", "tool": "string", "exists": "boolean", "seen_ts": "long", "seen_hash": "string"}
    wrote = lambda rows, kind: rows.where("seq % 3 > 0").select(F.col("path").alias("key"), F.lit(kind).alias("kind"), "sid", "agent", "ts", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    asks = e.where("seq % 3 = 0").select(F.col("path").alias("key"), F.lit("ask").alias("kind"), "sid", "agent", "ts", F.col("seq").alias("ask"), F.lit("allow").alias("verdict"), F.lit("Edit").alias("tool"), F.lit(True).alias("exists"), (F.col("ts") - 600_000).alias("seen_ts"), F.when(F.col("seq") % 2 == 0, "h").alias("seen_hash"))
    rows = wrote(i, "intent").unionByName(wrote(e, "landed")).unionByName(asks)
    return _streamed(spark, rows, lambda r: conflict_stream(r, asks_become_intents=False)).select("ask", "conflict", "other_sid", "other_agent", "allowed")


_SWEPT_SQL = f"""with {_T_SQL}, s as (select *, 's' || (conv_id % 7) as session from tc), e as (select *, 's' || (conv_id % 7) as session, min(seq) over (partition by conv_id % 7, key, hash) = seq as first from ex),
t as (select session, key, count(*) filter (op = 'read') as reads, count(*) filter (op <> 'read') as edits, arg_max(op, seq) as last_op, max(seq) as last from s where role <> 'system' group by 1, 2),
m as (select *, row_number() over (partition by session order by edits > 0 desc, reads + edits desc, last desc) as n from t)"""


@query(_SWEPT_SQL + """, l as (select 's' || (conv_id % 7) as session, count(*) as lines from c group by 1), p as (select session, count(*) as n from (select session, seq from s union select session, seq from e) group by 1),
o as (select session, count(*) filter (op = 'read') as r, count(*) filter (op <> 'read') as w from s group by 1), x as (select session, count(*) filter (first) as n from e group by 1)
select 'stats' as part, session, '' as path, lines as a, p.n as b, r as c, w as d, coalesce(x.n, 0) as e from l left join p using (session) left join o using (session) left join x using (session)
union all select 'entry', session, key, n, reads, edits, length(key), case last_op when 'read' then 0 else 1 end from m where n <= 12
union all select 'blobs', '', '', count(distinct h), 0, 0, 0, 0 from (select hash as h from ex union all select sha256(key) from t)
union all select 'read', session, key, count(*), 0, 0, 0, 0 from e where first group by all""")
def sweep_stream(spark, sf):
    """Transcripts of seven sessions, swept into the archive as three batches; then the last batch is done again."""
    from ..streaming import sweeps

    at = _folder(spark, "sweep")
    c = _lines(spark, sf).select(F.concat(F.lit("s"), (F.col("conv_id") % 7).cast("string")).alias("session"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("line"), F.regexp_replace("value", r"/w\\\\c", "/w/c").alias("value"))
    parts = c.agg(F.percentile_approx("line", [0.3, 0.7])).first()[0]
    files = _lines(spark, sf).select("conv_id").distinct().select(F.concat(F.lit("/w/c"), (F.col("conv_id") % 20).cast("string"), F.lit(".ts")).alias("path")).distinct()
    disk = files.select("path", F.lit(True).alias("exists"), F.length("path").cast("long").alias("size"), F.lit(False).alias("binary"), F.col("path").alias("content"))
    sink, part = sweeps.SweepSink(f"{at}/archive", disk), F.when(F.col("line") <= parts[0], 0).when(F.col("line") <= parts[1], 1).otherwise(2)
    for k in range(3):  # three runs of a query that goes on from its checkpoint
        c.where(part == k).write.mode("append").parquet(f"{at}/in")
        q = spark.readStream.schema(c.schema).parquet(f"{at}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    sink(c.where(part == 2), 2)
    zero = [F.lit(0).cast("long").alias(x) for x in "bcde"]
    st = sweeps.stats(spark, f"{at}/archive").select(F.lit("stats").alias("part"), "session", F.lit("").alias("path"), F.col("lines").alias("a"), F.col("parsed_lines").alias("b"), F.col("reads_seen").alias("c"), F.col("edits_seen").alias("d"), F.col("exact_versions").alias("e"))
    en = sweeps.manifests(spark, f"{at}/archive").select("session", F.posexplode("entries").alias("n", "x")).select(F.lit("entry").alias("part"), "session", "x.path", (F.col("n") + 1).cast("long").alias("a"), F.col("x.reads").alias("b"), F.col("x.edits").alias("c"), F.col("x.bytes").alias("d"), F.when(F.col("x.lastOp") == "read", 0).otherwise(1).cast("long").alias("e"))
    bl = sweeps.read(spark, f"{at}/archive", "blobs").agg(F.count("*").alias("a")).select(F.lit("blobs").alias("part"), F.lit("").alias("session"), F.lit("").alias("path"), "a", *zero)
    rd = sweeps.read(spark, f"{at}/archive", "events").where("hash <> sha2(path, 256)").groupBy("session", "path").agg(F.count("*").alias("a")).select(F.lit("read").alias("part"), "session", "path", "a", *zero)
    return st.unionByName(en).unionByName(bl).unionByName(rd)
