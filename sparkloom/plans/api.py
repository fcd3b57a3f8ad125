"""The named queries of a context history, each a composition of operators over the tables that the caller hands in."""

from __future__ import annotations

import hmac
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attest, code, content, paths, transcripts
from ..operators import analytics as A
from ..operators import budget, delivery, guard, presence, retention
from ..sources import stores

DAY = 86_400_000


def context_stats(meter: DataFrame) -> dict[str, DataFrame]:
    """Totals, repositories, and the eight files that cost most."""
    totals = A.meter_totals(meter)
    priced = totals.withColumn("saved_usd", content.usd(F.col("saved_tokens"))).withColumn("saved_pct", content.saved_percent(F.col("baseline_tokens"), F.col("sent_tokens")))
    return {"totals": priced, "by_repo": A.meter_by_repo(meter), "top_files": A.top_files(meter, 8)}


def read_files(requests: DataFrame) -> DataFrame:
    """READ_REQUEST rows answered in order, each in full, by a marker or by a patch; secret paths are delivered but not archived."""
    hashed = requests.withColumn("hash", content.content_hash(F.col("content")))
    sent = delivery.deliver(hashed)
    return sent.withColumn("archived", (F.col("view") == "full") & ~paths.is_secret(F.col("path")))


def resolve_views(requests: DataFrame, disk: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """requests(session, seq, path, symbol, lines, force_full, epoch) over disk(path, size, binary, content) -> with view, content,
    first_line, last_line and error.

    A symbol comes before a line range; empty ones don't count. error, or null: unreadable, too large, binary, no such symbol,
    bad line range. The view's name holds the range as it was clamped.
    """
    d = disk.select(paths.path_key(F.col("path")).alias("_key"), F.col("size").alias("_size"), F.coalesce("binary", F.lit(False)).alias("_binary"), F.col("content").alias("_text"))
    rows = requests.withColumn("_key", paths.path_key(F.col("path"))).join(d, "_key", "left")
    refused = F.when(F.col("_size").isNull(), "unreadable").when(F.col("_size") > max_bytes, "too large").when(F.col("_binary"), "binary")
    rows = rows.withColumn("_refused", refused).withColumn("_named", F.coalesce(F.col("symbol") != "", F.lit(False)))
    rows = rows.withColumn("_ranged", ~F.col("_named") & F.coalesce(F.col("lines") != "", F.lit(False)))
    rows = rows.withColumn("_found", code.symbol_slice(F.when(F.col("_refused").isNull() & F.col("_named"), F.col("_text")), F.coalesce("symbol", F.lit("")), F.col("path")))
    ends = [F.regexp_extract("lines", r"^(\d+)\s*-\s*(\d+)$", k).try_cast("int") for k in (1, 2)]
    rows = rows.withColumn("_cut", F.when(F.col("_ranged") & ends[0].isNotNull(), content.slice_lines(F.col("_text"), ends[0], ends[1])))
    error = F.coalesce("_refused", F.when(F.col("_named") & F.col("_found.text").isNull(), "no such symbol").when(F.col("_ranged") & F.col("_cut").isNull(), "bad line range"))
    part = F.when(F.col("_named"), F.col("_found")).when(F.col("_ranged"), F.struct(F.col("_cut.text").alias("text"), F.col("_cut.start").cast("int").alias("start"), F.col("_cut.end").cast("int").alias("end")))
    view = F.when(F.col("_named"), F.concat(F.lit("sym:"), F.col("symbol"))).when(F.col("_ranged"), F.concat(F.lit("lines:"), F.col("_cut.start").cast("string"), F.lit("-"), F.col("_cut.end").cast("string"))).otherwise("full")
    whole = ~F.col("_named") & ~F.col("_ranged")
    return rows.select(
        "session", "seq", "path", view.alias("view"), F.when(error.isNull(), F.when(whole, F.col("_text")).otherwise(part["text"])).alias("content"), F.coalesce("force_full", F.lit(False)).alias("force_full"), "epoch",
        part["start"].alias("first_line"), part["end"].alias("last_line"), error.alias("error"),
    )


@dataclass
class Answers:
    """What is sent for reads, what couldn't be read, and what the reads leave behind: meter and log events, blobs."""

    sent: DataFrame
    errors: DataFrame
    meter: DataFrame
    events: DataFrame
    blobs: DataFrame


def read_file(requests: DataFrame, disk: DataFrame, ledger_bytes: int = delivery.LEDGER_BYTES, max_bytes: int = 2_000_000) -> Answers:
    """Reads of whole files, symbols and line ranges (see resolve_views), delivered, metered and recorded.

    Whole files are archived, secret ones without anything that tells about their content.
    """
    found = resolve_views(requests, disk, max_bytes)
    reads = found.where("error is null").withColumn("hash", content.content_hash(F.col("content")))
    sent = delivery.deliver(reads, ledger_bytes)
    facts = reads.select("session", "seq", content.approx_tokens(F.col("content")).alias("_tokens"), F.when(F.col("view") == "full", content.git_blob_sha1(F.col("content"))).alias("_git"), F.when(F.col("view") == "full", F.col("content")).alias("_whole"), "first_line", "last_line")
    marker = F.concat(F.lit("[unchanged] "), F.col("path"), F.lit(" is as you last read it ("), paths.short_id(F.col("hash"), 12), F.lit(")"))
    rows = sent.join(facts, ["session", "seq"]).withColumn("excluded", paths.is_secret(F.col("path")))
    rows = rows.withColumn("sent_tokens", content.approx_tokens(F.coalesce("content", "patch", marker)))
    shown = F.when(F.col("excluded"), "").otherwise(F.col("hash"))
    git = F.when(~F.col("excluded"), F.col("_git")).alias("git_blob_sha1")
    meter = rows.select("session", "seq", "path", "view", "kind", "epoch", shown.alias("hash"), F.when(~F.col("excluded"), F.col("base_hash")).alias("base_hash"), git, "excluded", "bytes", F.col("_tokens").alias("baseline_tokens"), "sent_tokens")
    events = rows.where("view = 'full'").select(
        "session", "seq", "path", shown.alias("hash"), git, F.when(F.col("excluded"), 0).otherwise(F.col("bytes")).cast("long").alias("bytes"),
        F.when(F.col("excluded"), 0).otherwise(F.col("_tokens")).cast("long").alias("approx_tokens"), F.lit("mcp").alias("source"), F.lit("read").alias("op"), "view", F.lit(False).alias("sidechain"), "excluded",
    )
    blobs = stores.as_blobs(rows.where("view = 'full' and not excluded").withColumn("content", F.col("_whole")), F.col("seq"))
    return Answers(sent.join(facts.select("session", "seq", "first_line", "last_line"), ["session", "seq"]), found.where("error is not null").select("session", "seq", "path", "error"), meter, events, blobs)


def outline(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.size(F.split("content", "\n")).alias("total_lines"), F.explode_outer(content.outline(F.col("content"))).alias("o"))
    return rows.select("path", "total_lines", "o.line", "o.text")


def working_set(events: DataFrame, manifest: DataFrame, disk: DataFrame, now_ms: int, limit: int = 15) -> DataFrame:
    """The most touched files of the last day, with what has become of them on disk (disk(path, hash))."""
    rows = A.working_set(events, manifest, now_ms).orderBy(F.desc("touches"), F.desc("last_ms"), "path").limit(limit)
    now = disk.select(paths.path_key(F.col("path")).alias("key"), F.col("hash").alias("_disk"))
    return rows.join(now, "key", "left").withColumn("state", content.staleness(F.col("hash"), F.col("_disk").isNotNull(), F.col("_disk"))).drop("_disk", "key")


def restore_context(entries: DataFrame, disk: DataFrame, tokens: int = 25_000) -> DataFrame:
    """entries(place, path, hash) with disk(path, content, hash): which files are sent again within the budget, in order.

    status: sent, over-budget, or unreadable (which costs nothing).
    """
    rows = entries.join(disk.select("path", F.col("content").alias("_c"), F.col("hash").alias("disk_hash")), "path", "left")
    rows = rows.withColumn("tokens", content.approx_tokens(F.coalesce("_c", F.lit("")))).withColumn("_none", F.col("_c").isNull()).withColumn("_all", F.lit(1))
    done = budget.greedy(rows, ["_all"], ["place"], "tokens", tokens, free="_none")
    status = F.when(F.col("_none"), "unreadable").when(F.col("taken"), "sent").otherwise("over-budget")
    return done.select("place", "path", "tokens", status.alias("status"), F.when(F.col("taken"), F.col("_c")).alias("content"), (F.col("disk_hash") != F.col("hash")).alias("changed"))


def restore_and_record(entries: DataFrame, disk: DataFrame, earlier: DataFrame, session: str, epoch: int, tokens: int = 25_000) -> tuple[DataFrame, Answers]:
    """(restore_context's rows, the reads they are): what is restored goes through the ledger after the session's earlier reads and is
    recorded like any other read. earlier: requests of resolve_views' columns. disk needs size and binary too."""
    plan = restore_context(entries, disk, tokens)
    last = earlier.where(F.col("session") == session).agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    none = F.lit(None).cast("string")
    reads = plan.where("status = 'sent'").select(F.lit(session).alias("session"), (last + F.col("place")).cast("long").alias("seq"), "path", none.alias("symbol"), none.alias("lines"), F.lit(False).alias("force_full"), F.lit(epoch).cast("long").alias("epoch"), F.lit(True).alias("_new"))
    asked = earlier.withColumn("_new", F.lit(False)).unionByName(reads)
    answers = read_file(asked.drop("_new"), disk)
    mine = reads.select("session", "seq")
    only = lambda rows: rows.join(mine, ["session", "seq"], "left_semi")
    events = only(answers.events)
    return plan, Answers(only(answers.sent), only(answers.errors), only(answers.meter), events, answers.blobs.join(events.select("hash"), "hash", "left_semi"))


#: Characters of context that an injection may hold; what shows that it was cut.
INJECTED, CUT = 9500, "\n[truncated]"


def inject(manifests: DataFrame, session: str | None, source: str, now_ms: int) -> DataFrame:
    """(text): the working set that a compacted or resumed session gets told, from its manifest (see manifest_as_of); no row for
    any other source, without a manifest, or where that is empty."""
    if source not in ("compact", "resume"):
        return manifests.limit(0).select(F.lit("").alias("text"))
    m = stores.manifest_as_of(manifests, session, now_ms).where(F.size("entries") > 0)
    fact = lambda e: F.concat_ws(", ", F.concat(e["reads"].cast("string"), F.lit(" reads")), F.concat(e["edits"].cast("string"), F.lit(" edits")), F.concat(F.lit("~"), e["approxTokens"].cast("string"), F.lit(" tok")), F.when(F.coalesce(e["excluded"], F.lit(False)), "not archived (secret-pattern)").otherwise(F.concat(F.lit("hash "), paths.short_id(e["hash"], 12))))
    lines = F.transform("entries", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["path"], F.lit(" ("), fact(e), F.lit(")")))
    text = F.concat(F.lit("Working set of session "), "session", F.lit(" as of "), "ts", F.lit(":\n"), F.array_join(lines, "\n"))
    return m.select(F.when(F.length(text) > INJECTED, F.concat(F.substring(text, 1, INJECTED), F.lit(CUT))).otherwise(text).alias("text"))


def publish(records: DataFrame, landed: DataFrame, now_ms: int) -> DataFrame:
    """Presence records after landed(sid, agent, path, ts, hash) edits: one row for each writer that edited, ready for save_presence.

    An edit ends the writer's own intents on its file; old and surplus rows go (see presence.kept_edits, kept_intents).
    """
    mine = records.join(landed.select("sid", "agent").distinct(), ["sid", "agent"], "left_semi")
    # rows keep their place: those of the record first
    numbered = lambda what: mine.select("sid", "agent", F.posexplode(what).alias("_n", "x")).select("sid", "agent", F.struct(F.lit(0).alias("k"), F.col("_n").cast("long").alias("n")).alias("seq"), "x.*")
    edits = numbered("edits").unionByName(landed.select("sid", "agent", F.struct(F.lit(1).alias("k"), F.col("ts").alias("n")).alias("seq"), "path", "ts", "hash"))
    edits = presence.kept_edits(edits, now_ms)
    intents = presence.kept_intents(presence.retire_intents(numbered("intents"), landed), now_ms)
    in_order = lambda *names: F.transform(F.array_sort(F.collect_list(F.struct("seq", *names))), lambda x: F.struct(*[x[n].alias(n) for n in names]))  # noqa: E731  KEPT at most
    e = edits.groupBy("sid", "agent").agg(in_order("path", "ts", "hash").alias("edits"))
    i = intents.groupBy("sid", "agent").agg(in_order("path", "ts").alias("intents"))
    who = landed.groupBy("sid", "agent").agg(F.lit(now_ms).cast("long").alias("updatedAt")).join(mine.select("sid", "agent", "pid"), ["sid", "agent"], "left")
    out = who.join(i, ["sid", "agent"], "left").join(e, ["sid", "agent"], "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.select("sid", "agent", "pid", "updatedAt", empty("intents", "array<struct<path: string, ts: bigint>>").alias("intents"), empty("edits", "array<struct<path: string, ts: bigint, hash: string>>").alias("edits"))


def export_pack(events: DataFrame, disk: DataFrame, now_ms: int, repo: str | None = None, top: int = 8, tokens: int = 30_000, days: int = 14, max_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): the best-ranked files that fit, and those passed over on the way with the reason.

    disk(path, size, binary, content). The ranking may be of any length: see budget.pick.
    """
    spark = events.sparkSession
    stats = A.pack_stats(events.where(F.col("ts_ms") >= now_ms - days * DAY), repo=repo)
    d = disk.select("path", "size", F.coalesce("binary", F.lit(False)).alias("binary"), "content")
    rows = stats.join(d, "path", "left").withColumn("tokens", content.approx_tokens(F.coalesce("content", F.lit(""))))
    reason = F.when(paths.is_secret(F.col("path")), "secret-pattern").when(F.col("size").isNull(), "unreadable").when(F.col("size") > max_bytes, "too large").when(F.col("binary"), "binary")
    ranked = rows.withColumn("reason", reason)
    picks = budget.pick(ranked.where("reason is null").drop("content"), "score", "path", "tokens", tokens, top)
    names = spark.createDataFrame([(p["path"], i) for i, p in enumerate(picks)], "path string, place int")
    files = ranked.join(F.broadcast(names), "path").select("place", "path", content.content_hash(F.col("content")).alias("hash"), content.git_blob_sha1(F.col("content")).alias("git_blob_sha1"), "tokens", "content", "sessions", "reads").orderBy("place")
    passed = ranked.join(F.broadcast(names), "path", "left_anti")
    if len(picks) == top:
        last = picks[-1]
        passed = passed.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (F.col("path") < last["path"])))
    over = F.concat(F.lit("over budget (~"), F.col("tokens").cast("string"), F.lit(" tok)"))
    return files, passed.select("path", F.coalesce("reason", over).alias("reason"))


@dataclass
class Blame:
    versions: DataFrame
    counters: DataFrame
    co_context: DataFrame


def context_blame(events: DataFrame, blobs: DataFrame, path: str, now_ms: int, at_ms: int | None = None, window_minutes: int = 30, days: int = 30) -> Blame:
    recent = events.where(F.col("ts_ms") >= now_ms - days * DAY)
    versions = stores.has_blob(A.blame_versions(recent, path), blobs).orderBy("first_ms", "hash")
    return Blame(versions, A.blame_counters(recent, path), A.co_context(recent, path, window_minutes, at_ms))


def coordination_status(records: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """Live sessions and contested files from presence records."""
    live = presence.live(records, now_ms)
    edits = presence.flat(live, "edits").withColumnRenamed("updatedAt", "updated_ms")
    intents = presence.flat(live, "intents").withColumnRenamed("updatedAt", "updated_ms")
    return {"sessions": presence.radar_sessions(edits, intents), "files": presence.radar_files(edits, intents, now_ms)}


def _receipt(meter: DataFrame, artifact: str, now_iso: str, swept: bool) -> dict:
    """A receipt without its lists of files."""
    totals = A.receipt_totals(meter).first().asDict()
    return {
        "kind": "context-receipt", "version": 2, "artifact": artifact, "ts": now_iso, "epochs": [int(x) for x in (totals.pop("epochs") or "").split(",") if x],
        "repos": [{"repo": r} for r in (totals.pop("repos") or "").split(",") if r], "files": [], "totals": totals, "sources": ["mcp", *(["transcript-sweep"] if swept else [])], **({"sweptFiles": []} if swept else {}),
    }


def context_receipt(meter: DataFrame, artifact: str, now_iso: str, key: str, events: DataFrame | None = None) -> tuple[dict, str]:
    """(receipt, signature) as one document on the driver; see write_receipt for receipts of any size."""
    receipt = _receipt(meter, artifact, now_iso, events is not None) | {"files": [r.asDict() for r in A.receipt_files(meter).collect()]}
    if events is not None:
        receipt["sweptFiles"] = [r.asDict() for r in A.receipt_swept(events).collect()]
    return receipt, attest.sign(receipt, key)


def _as_json(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"json": pa.array([attest.canonical_json(r) for r in b.to_pylist()], pa.string())})


def _receipt_parts(spark: SparkSession, path: str):
    """The text of a written receipt, in parts: its lists' rows come a partition at a time."""
    receipt = json.loads(spark.read.text(f"{path}/receipt").first()[0])
    yield "{"
    for n, name in enumerate(sorted(receipt)):
        yield ("," if n else "") + attest.canonical_json(name) + ":"
        if name in ("files", "sweptFiles"):
            rows = spark.read.schema("n long, json string").parquet(f"{path}/{name}").orderBy("n").select("json")
            yield "["
            for k, r in enumerate(rows.toLocalIterator()):
                yield ("," if k else "") + r.json
            yield "]"
        else:
            yield attest.canonical_json(receipt[name])
    yield "}"


def write_receipt(meter: DataFrame, artifact: str, now_iso: str, key: str, path: str, events: DataFrame | None = None) -> str:
    """context_receipt's signature, with the receipt in a folder: its lists are sorted, written as canonical rows by tasks, and go through one
    running HMAC; the driver holds a partition of them at a time."""
    spark = meter.sparkSession
    lists = {"files": A.receipt_files(meter)} | ({} if events is None else {"sweptFiles": A.receipt_swept(events)})
    for name, rows in lists.items():
        rows.mapInArrow(_as_json, "json string").withColumn("n", F.monotonically_increasing_id()).select("n", "json").write.parquet(f"{path}/{name}")
    spark.createDataFrame([(attest.canonical_json(_receipt(meter, artifact, now_iso, events is not None)),)], "value string").coalesce(1).write.text(f"{path}/receipt")
    return attest.sign_parts(_receipt_parts(spark, path), key)


def verify_receipt(spark: SparkSession, path: str, signature: str | None, key: str) -> bool:
    """Whether a written receipt is as it was signed."""
    return hmac.compare_digest(attest.sign_parts(_receipt_parts(spark, path), key).encode(), (signature or "").encode())


def verify_context_receipt(receipt: dict, signature: str, key: str) -> bool:
    return attest.verify(receipt, signature, key)


@dataclass
class Sweep:
    stats: DataFrame
    working_set: DataFrame
    blobs: DataFrame
    events: DataFrame


def sweep(lines: DataFrame, disk: DataFrame, session: str, exact_bytes: int = 64 << 20, max_bytes: int = 2_000_000) -> Sweep:
    """One transcript's lines(line, value) -> what a sweep records: statistics, the heat-ranked working set, blobs and events.

    Exact versions come from read results, in line order within a byte budget; then the current content of every touched file.
    Secret paths are recorded without hash, size or content.
    """
    said = transcripts.parsed(lines)
    touches = transcripts.touches(said, ["line"]).withColumn("seq", F.col("line") * 10_000 + F.col("pos"))
    exact = transcripts.exact_versions(said, ["line"]).withColumn("hash", content.content_hash(F.col("content"))).withColumn("size", content.byte_size(F.col("content"))).withColumn("_all", F.lit(1))
    kept = budget.greedy(A.first_versions(exact, "line"), ["_all"], ["line"], "size", exact_bytes).where("taken")
    there, _ = A.on_disk(A.touch_fold(touches), disk, max_bytes)
    there = there.join(disk.select("path", "content"), "path")
    secret = paths.is_secret(F.col("path"))
    tier2 = kept.select("path", "content", F.lit("read").alias("op"), "sidechain", F.col("ts").alias("seen_ts"))
    tier1 = there.select("path", "content", F.col("last_op").alias("op"), F.lit(False).alias("sidechain"), F.col("last_ts").alias("seen_ts"))
    rows = tier2.unionByName(tier1).withColumn("excluded", secret)
    facts = rows.select(
        F.lit(session).alias("session"), "path", F.when(secret, "").otherwise(content.content_hash(F.col("content"))).alias("hash"), F.when(~secret, content.git_blob_sha1(F.col("content"))).alias("git_blob_sha1"),
        F.when(secret, 0).otherwise(content.byte_size(F.col("content"))).cast("long").alias("bytes"), F.when(secret, 0).otherwise(content.approx_tokens(F.col("content"))).cast("long").alias("approx_tokens"),
        F.lit("sweep").alias("source"), "op", F.lit("full").alias("view"), "sidechain", "excluded", "seen_ts",
    )
    ranked = there.withColumn("excluded", secret).select(
        "path", F.when(secret, "").otherwise(F.col("disk_hash")).alias("hash"), F.when(secret, 0).otherwise(F.col("size")).cast("long").alias("bytes"),
        F.when(secret, 0).otherwise(content.approx_tokens(F.col("content"))).cast("long").alias("approx_tokens"), "reads", "edits", "last_op", "last_ts", "excluded",
    )
    return Sweep(A.sweep_stats(said, touches, exact), ranked.orderBy(*A.heat_order()), stores.as_blobs(rows.where(~F.col("excluded")), F.lit(0)), facts)


def guard_edits(edits: DataFrame, marks: DataFrame, intents: DataFrame, landed: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts for edits as of their own time, with another writer's conflict where the guard itself would allow.

    edits needs sid, agent and now besides what guard.judge_edits needs.
    """
    judged = guard.judge_edits(edits, marks, by)
    asks = judged.join(edits.select("ask", *[c for c in ("sid", "agent", "now") if c not in by]), "ask").where("verdict = 'allow'").select("ask", "sid", "agent", "path", "now", "seen_ts", "seen_hash")
    found = presence.conflicts(asks, intents, landed).withColumnRenamed("kind", "conflict")
    return judged.join(found, "ask", "left").withColumn("allowed", (F.col("verdict") == "allow") & F.col("conflict").isNull())


def enforce_budget(events: DataFrame, blobs: DataFrame, now_ms: int, max_bytes: int = 512 << 20, days: int = 30, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blobs to delete, events to keep)."""
    return retention.evicted_blobs(blobs, max_bytes), retention.retained_events(events, now_ms, days, own)


def bump_epoch(current: int, now_ms: int) -> int:
    """The next context epoch: it always grows, whatever the clock says."""
    return max(now_ms, current + 1)
