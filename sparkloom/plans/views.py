"""The logical tables derived from the driver's generic ones, in Spark and in DuckDB SQL, without any wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import approx_tokens_of_size, content_hash
from ..functions.paths import is_secret, mask_secret


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms_of(ts: Column) -> Column:
    """Milliseconds of a timestamp without a zone, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), ms_of(F.col("ts")).alias("ts_ms"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor(F.col("value") / 100).cast("int").alias("ver"),
    )


SQL_BASE = """base as (select event_id as seq, epoch_us(ts) // 1000 as ts_ms, user_id, event_type, cast(json_extract_string(props, '$.k') as int) as k,
  cast(floor(value / 100) as int) as ver from events)"""


def raw_events(spark: SparkSession, sf_dir: str, session: str = "mod") -> DataFrame:
    """Event-log rows before secrets are masked. session: `mod` (ten sessions) or `user` (one for each user)."""
    b = base_events(spark, sf_dir)
    k, ver = F.col("k"), F.col("ver")
    folder = F.concat(F.lit("/r"), (k % 5).cast("string"))
    name = F.when(k % 25 == 0, F.concat(F.lit("/.env.p"), k.cast("string"))).when(k % 25 == 1, F.concat(F.lit("/key"), k.cast("string"), F.lit(".pem"))).otherwise(F.concat(F.lit("/f"), k.cast("string"), F.lit(".ts")))
    size = (20 + (k * 37 + ver * 211) % 2000).cast("long")
    content = F.concat(k.cast("string"), F.lit("|"), ver.cast("string"))
    return b.select(
        "seq", "ts_ms", "user_id", "event_type", "k", "ver", (F.col("user_id") % 10 if session == "mod" else F.col("user_id")).cast("string").alias("session"),
        folder.alias("repo"), F.concat(folder, name).alias("path"), content_hash(content).alias("hash"), F.when(ver % 2 == 0, F.sha1(content)).alias("git_blob_sha1"),
        size.alias("bytes"), approx_tokens_of_size(size).alias("approx_tokens"),
        F.when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "write").otherwise("read").alias("op"),
        F.when(F.col("event_type") == "view", "mcp").otherwise("sweep").alias("source"), F.lit("full").alias("view"), (F.col("event_type") == "error").alias("sidechain"),
    )


def archive_events(spark: SparkSession, sf_dir: str, session: str = "mod") -> DataFrame:
    raw = raw_events(spark, sf_dir, session)
    return mask_secret(raw, is_secret(F.col("path")))


SQL_SECRET = r"""(list_contains(['.npmrc','.netrc','.pgpass','.git-credentials','.htpasswd','credentials','credentials.json','secrets.json','secrets.yaml','secrets.yml'],
  coalesce(list_filter(string_split(lower(replace({p}, '\', '/')), '/'), lambda s: s <> '')[-1], ''))
  or list_has_any(string_split(lower(replace({p}, '\', '/')), '/'), ['.ssh','.aws','.gnupg','.kube'])
  or regexp_matches(replace({p}, '\', '/'), '(^|/)\.env($|\.)|\.(pem|key|p12|pfx|keystore|jks|asc)$|(^|/)id_(rsa|dsa|ecdsa|ed25519)[^/]*$|secret[^/]*\.(json|ya?ml|toml|txt)$|credential', 'i'))"""


def sql_events(session: str = "mod") -> str:
    who = "user_id % 10" if session == "mod" else "user_id"
    return f"""{SQL_BASE}, raw as (select seq, ts_ms, user_id, event_type, k, ver, cast({who} as varchar) as session, '/r' || (k % 5) as repo,
  '/r' || (k % 5) || case when k % 25 = 0 then '/.env.p' || k when k % 25 = 1 then '/key' || k || '.pem' else '/f' || k || '.ts' end as path,
  sha256(k || '|' || ver) as hash, case when ver % 2 = 0 then sha1(k || '|' || ver) end as git_blob_sha1, cast(20 + (k * 37 + ver * 211) % 2000 as bigint) as bytes,
  cast(ceil((20 + (k * 37 + ver * 211) % 2000) / 4.0) as bigint) as approx_tokens,
  case event_type when 'purchase' then 'edit' when 'signup' then 'write' else 'read' end as op, case when event_type = 'view' then 'mcp' else 'sweep' end as source,
  'full' as view, event_type = 'error' as sidechain from base),
ev as (select * replace (case when x then '' else hash end as hash, case when x then null else git_blob_sha1 end as git_blob_sha1, case when x then 0 else bytes end as bytes,
  case when x then 0 else approx_tokens end as approx_tokens), x as excluded from (select *, {SQL_SECRET.format(p="path")} as x from raw))"""


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in order: ten sessions, ten paths, an epoch for each day."""
    b = base_events(spark, sf_dir).where("event_type <> 'error'")
    path, ver = F.col("k") % 10, F.col("ver")
    size = (20 + (path * 37 + ver * 211) % 2000).cast("long")
    return b.select(
        (F.col("user_id") % 10).cast("string").alias("session"), "seq", F.concat(F.lit("/r"), (path % 3).cast("string"), F.lit("/f"), path.cast("string")).alias("path"), F.concat(F.lit("/r"), (path % 3).cast("string")).alias("repo"),
        F.lit("full").alias("view"), F.floor(F.col("ts_ms") / 86_400_000).alias("epoch"), content_hash(F.concat(path.cast("string"), F.lit("|"), ver.cast("string"))).alias("hash"), size.alias("bytes"),
        F.when(ver % 2 == 0, F.sha1(F.concat(path.cast("string"), F.lit("|"), ver.cast("string")))).alias("git_blob_sha1"), F.lit(False).alias("excluded"),
    )


SQL_REQUESTS = f"""{SQL_BASE}, rq0 as (select *, k % 10 as p from base where event_type <> 'error'),
rq as (select cast(user_id % 10 as varchar) as session, seq, '/r' || (p % 3) || '/f' || p as path, '/r' || (p % 3) as repo, 'full' as view, cast(floor(ts_ms / 86400000) as bigint) as epoch,
  sha256(p || '|' || ver) as hash, cast(20 + (p * 37 + ver * 211) % 2000 as bigint) as bytes, case when ver % 2 = 0 then sha1(p || '|' || ver) end as git_blob_sha1 from rq0),
runs as (select *, sum(c) over (partition by session order by seq) as run from (select *, case when epoch <> lag(epoch) over (partition by session order by seq) then 1 else 0 end as c from rq)),
held as (select *, lag(hash) over w as base, row_number() over w = 1 as first_read from runs window w as (partition by session, run, path, view order by seq)),
dl as (select *, case when not first_read and base = hash and bytes > 256 then 'unchanged' when not first_read and base <> hash then 'changed' else 'full' end as kind from held)"""


def meter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reads above cost: a changed read counts as a patch of a tenth of the file."""
    from ..operators.delivery import decide

    d = decide(read_requests(spark, sf_dir))
    sent = F.when(F.col("kind") == "unchanged", F.lit(16)).when(F.col("kind") == "changed", F.ceil(F.col("bytes") / 40)).otherwise(F.ceil(F.col("bytes") / 4)).cast("long")
    out = d.withColumn("baseline_tokens", F.ceil(F.col("bytes") / 4).cast("long")).withColumn("sent_tokens", sent)
    return out.withColumn("kind", F.when(F.col("kind") == "changed", "diff").otherwise(F.col("kind")))


SQL_METER = SQL_REQUESTS + """,
mt as (select * replace (case when kind = 'changed' then 'diff' else kind end as kind), cast(ceil(bytes / 4.0) as bigint) as baseline_tokens,
  cast(case kind when 'unchanged' then 16 when 'changed' then ceil(bytes / 40.0) else ceil(bytes / 4.0) end as bigint) as sent_tokens from dl)"""


def presence_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Flat edits (purchases) or intents (signups): (seq, sid, agent, path, ts, hash, updated_ms, mtime)."""
    b = base_events(spark, sf_dir).where(F.col("event_type") == ("purchase" if kind == "edits" else "signup"))
    return b.select(
        "seq", (F.col("user_id") % 10).cast("string").alias("sid"), (F.col("user_id") % 3).cast("string").alias("agent"), F.concat(F.lit("f"), (F.col("k") % 5).cast("string")).alias("path"), F.col("ts_ms").alias("ts"),
        F.when(F.col("ver") % 2 == 0, content_hash(F.col("ver").cast("string"))).alias("hash"), F.col("ts_ms").alias("updated_ms"), F.col("ts_ms").alias("mtime"),
    )


def sql_presence(kind: str, name: str) -> str:
    event = "purchase" if kind == "edits" else "signup"
    return f"""{name} as (select seq, cast(user_id % 10 as varchar) as sid, cast(user_id % 3 as varchar) as agent, 'f' || (k % 5) as path, ts_ms as ts,
  case when ver % 2 = 0 then sha256(cast(ver as varchar)) end as hash, ts_ms as updated_ms from base where event_type = '{event}')"""


def now_ms(rows: DataFrame, column: str = "ts_ms") -> int:
    """The latest time in the data: one row to the driver."""
    return rows.agg(F.max(column)).first()[0] or 0
