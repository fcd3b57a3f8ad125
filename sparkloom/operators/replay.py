"""Replays of recorded sessions: calls and their results, re-reads, overlap between agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls(file, id, call_line, ...) with the usable result that answers each: results(file, id, result_line, body, is_error, ...).

    A call waits for the first result after it, usable or not; a later call of the same id takes its place. So a result answers
    the row just before it, if that is a call, and only then is it asked whether it is usable (no error, not empty).
    """
    own, said = [c for c in calls.columns if c not in ("file", "id")], [c for c in results.columns if c not in ("file", "id")]
    c = calls.select("file", "id", F.col("call_line").alias("_at"), F.lit(0).alias("_kind"), F.struct(*own).alias("_call"))
    r = results.select("file", "id", F.col("result_line").alias("_at"), F.lit(1).alias("_kind"), F.struct(*said).alias("_result"))
    w = Window.partitionBy("file", "id").orderBy("_at", "_kind")
    met = c.unionByName(r, allowMissingColumns=True).withColumn("_call", F.lag("_call").over(w)).where("_kind = 1 and _call is not null")
    usable = ~F.coalesce(F.col("_result.is_error"), F.lit(False)) & (F.coalesce("_result.body", F.lit("")) != "")
    return met.where(usable).select("file", "id", "_call.*", "_result.*")


def replay_summary(reads: DataFrame) -> DataFrame:
    """reads(kind, first_read, baseline_tokens, sent_tokens) -> one row of counts, the re-read rate and the share saved."""
    again = F.count_if(~F.col("first_read"))
    base, sent = F.sum("baseline_tokens"), F.sum("sent_tokens")
    return reads.agg(
        F.count("*").alias("reads"), F.count_if("first_read").alias("first_reads"), F.count_if(F.col("kind") == "unchanged").alias("unchanged"), F.count_if(F.col("kind") == "changed").alias("changed"),
        F.round(again * 100.0 / F.nullif(F.count("*"), F.lit(0)), 6).alias("reread_pct"), base.alias("baseline_tokens"), sent.alias("sent_tokens"),
        F.round((base - sent) * 100.0 / F.nullif(base, F.lit(0)), 6).alias("saved_pct"),
    )


def reread_median(reads: DataFrame, session: str = "session") -> DataFrame:
    """The upper median over sessions of the share of reads that are re-reads: an element of the list, never between two."""
    shares = reads.groupBy(session).agg((F.count_if(~F.col("first_read")) / F.count("*")).alias("share"))
    # the middle by rank: equal shares are counted first, so that the ranking has few rows however many sessions there are
    counts = shares.groupBy("share").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("share"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.round(F.min("share"), 6).alias("median_reread_share"), F.max("all").alias("sessions"))


def sibling_overlap(reads: DataFrame, run: str, agent: str, identity: list[str], seq: str = "seq") -> DataFrame:
    """Per run: reads, and those of a version that a sibling agent had read first. An agent's own re-reads aren't overlap."""
    first = reads.groupBy(run, *identity).agg(F.min_by(agent, seq).alias("_first"))
    marked = reads.join(first, [run, *identity])
    return marked.groupBy(run).agg(F.count("*").alias("reads"), F.count_if(F.col(agent) != F.col("_first")).alias("duplicates"), F.sum("approx_tokens").alias("tokens"), F.sum(F.when(F.col(agent) != F.col("_first"), F.col("approx_tokens")).otherwise(0)).alias("duplicate_tokens"))
