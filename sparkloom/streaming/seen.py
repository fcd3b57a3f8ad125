"""The guard as a stream: what sessions have seen, resets, verdicts on edits, and other writers' conflicts.

Rows of guard_stream are (session, kind, key, ts, hash, ask, tool, exists, disk_hash): kind is `mark` (a file was seen), `reset` (the
session lost its context at ts; no key) or `edit` (may this edit go ahead?). A session's state is its last reset and a map of the
files it has seen, which lives in the state store, entry by entry: a batch fetches each entry that its rows touch once and puts it back
once, and a reset touches none. Only where a session has seen more files than it may keep are its entries looked through. Of one
millisecond's rows a reset comes first, and an edit before the marks: what is seen at that moment isn't seen before it.

conflict_stream takes the verdicts on by file: what other writers are about to edit or have edited decides where the guard allows.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import path_key
from ..functions.transcripts import GUARDED
from ..operators.guard import SEEN_CAP
from ..operators.presence import INTENT_SECS


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


S, L, B = T.StringType(), T.LongType(), T.BooleanType()
OUT = _fields(session=S, key=S, ask=L, verdict=S, seen_ts=L, seen_hash=S, tool=S, exists=B, ts=L)
CONFLICTS = _fields(ask=L, verdict=S, conflict=S, other_sid=S, other_agent=S, allowed=B, intent=B)
_SEEN, _KEY, _RESET, _HELD = _fields(ts=L, hash=S), _fields(key=S), _fields(ts=L), _fields(n=L)
_WRITER, _WROTE = _fields(sid=S, agent=S), _fields(intent=L, edit=L)


def judge(tool: str | None, exists: bool, seen: tuple[int, str | None] | None, disk_hash: str | None, reset: int) -> str:
    if tool not in GUARDED or not exists:
        return "allow"
    if seen is None or seen[0] <= reset:
        return "never-seen"
    return "drift" if seen[1] and disk_hash and seen[1] != disk_hash else "allow"


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


class Fetched:
    """A map state whose entries are fetched once a batch, and put back at its end where they have changed. new: whether a key can't be in the store."""

    def __init__(self, state, new: Callable[[tuple], bool] = lambda key: False):
        self.state, self.new = state, new
        self.held: dict[tuple, tuple | None] = {}
        self.changed: set[tuple] = set()
        self.whole = False

    def get(self, key: tuple) -> tuple | None:
        if key not in self.held:
            if self.whole or self.new(key):
                return None
            self.held[key] = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
        return self.held[key]

    def put(self, key: tuple, value: tuple) -> None:
        self.held[key] = value
        self.changed.add(key)

    def remove(self, key: tuple) -> None:
        if self.new(key):
            self.held.pop(key, None)
            self.changed.discard(key)
        else:
            self.held[key] = None
            self.changed.add(key)

    def items(self) -> list[tuple[tuple, tuple]]:
        if not self.whole:
            for k, v in self.state.iterator():
                self.held.setdefault(tuple(k), tuple(v))
            self.whole = True
        return [(k, v) for k, v in self.held.items() if v is not None]

    def clear(self) -> None:
        self.state.clear()
        self.held.clear()
        self.changed.clear()
        self.whole = True

    def put_back(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue(key, self.held[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)


#: Rows of a group that are made or given at once.
AT_ONCE = 10_000


def in_order(rows: Iterator[pd.DataFrame], *by: str | Callable[[pd.DataFrame], pd.Series]) -> Iterator:
    """A group's rows of one batch, sorted. They are held as columns, and of equal texts one."""
    known: dict = {}
    parts = []
    for pdf in rows:
        parts.append(pdf.assign(**{c: np.array([known.setdefault(x, x) for x in pdf[c]], dtype=object) for c in pdf.columns if pdf[c].dtype == object}))
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    del parts
    order = np.lexsort([(rows[b] if isinstance(b, str) else b(rows)).to_numpy() for b in reversed(by)])
    for at in range(0, len(order), AT_ONCE):
        yield from rows.take(order[at : at + AT_ONCE]).itertuples(index=False)


def given(out: Iterator[tuple], names: list[str], whole: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Rows as frames of AT_ONCE rows, an empty one if there are none; whole: numbers that may be null."""
    frame = lambda some: pd.DataFrame(some, columns=names).astype({c: "Int64" for c in whole})
    held, any_ = [], False
    for row in out:
        held.append(row)
        if len(held) == AT_ONCE:
            yield frame(held)
            held, any_ = [], True
    if held or not any_:
        yield frame(held)


def _asked(rows: pd.DataFrame) -> pd.Series:
    return pd.to_numeric(rows["ask"]).fillna(-1)


class SeenProcessor(StatefulProcessor):
    """For each session: its last reset, and the newest marks of `cap` files. An idle session's state goes when its timer ends."""

    def __init__(self, keep_ms: int | None = None, cap: int = SEEN_CAP, idle_ms: int | None = None):
        self.keep_ms, self.cap, self.idle_ms = keep_ms, cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", _KEY, _SEEN, self.keep_ms)
        self.reset = handle.getValueState("reset", _RESET, self.keep_ms)
        self.held = handle.getValueState("held", _HELD, self.keep_ms)

    def _evict(self, seen: Fetched) -> int:
        """The oldest marks go, of equally old ones those of the last files by name, until `cap` are left."""
        marks = sorted(((v[0], k[0]) for k, v in seen.items()), key=lambda m: (-m[0], m[1]))
        for _, key in marks[self.cap :]:
            seen.remove((key,))
        return min(len(marks), self.cap)

    def _wait(self, newest: int) -> None:
        """One timer, idle_ms after the newest row that the session has had."""
        for old in list(self.handle.listTimers()):
            newest = max(newest, old - self.idle_ms)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from given(self._judged(key[0], rows), OUT.names, ("ask", "seen_ts", "ts"))

    def _judged(self, session: str, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        reset = self.reset.get()[0] if self.reset.exists() else -1
        count = self.held.get()[0] if self.held.exists() else 0
        newest, before, seen = 0, reset, Fetched(self.seen)
        turn = lambda rows: rows["kind"].map({"reset": 0, "edit": 1}).fillna(2)
        known = lambda rows: rows["hash"].fillna("")  # noqa: E731  of marks that are equally new the one of the last hash stays
        for r in in_order(rows, "ts", turn, _asked, known):
            newest = max(newest, int(r.ts))
            if r.kind == "reset":
                reset = max(reset, int(r.ts))
                continue
            held = seen.get((r.key,))
            if r.kind == "edit":
                verdict = judge(r.tool, bool(r.exists), held, _text(r.disk_hash), reset)
                yield session, r.key, int(r.ask), verdict, held[0] if held else None, held[1] if held else None, _text(r.tool), bool(r.exists), int(r.ts)
            elif held is None or r.ts >= held[0]:  # late marks never overwrite newer ones
                seen.put((r.key,), (int(r.ts), _text(r.hash)))
                count += held is None
        if reset > before:
            self.reset.update((reset,))
        # marks that a time to live has taken are counted until the next look at all of them
        self.held.update((self._evict(seen) if count > self.cap else count,))
        seen.put_back()
        if self.idle_ms is not None:
            self._wait(newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.seen, self.reset, self.held):
            state.clear()
        yield pd.DataFrame([], columns=OUT.names).astype({"ask": "Int64", "seen_ts": "Int64", "ts": "Int64"})

    def close(self) -> None:
        pass


def guard_stream(rows: DataFrame, keep_ms: int | None = None, cap: int = SEEN_CAP, idle_ms: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Verdicts for the edits of a stream (needs the RocksDB state store).

    cap: files whose newest marks a session keeps after each batch. keep_ms: how long state without news is kept, by the clock; or idle_ms: how
    long after a session's last row all its state is dropped, by the rows' own times, which `ts` holds and which come at most `delay` late.
    """
    if idle_ms is None:
        return rows.groupBy("session").transformWithStateInPandas(SeenProcessor(keep_ms, cap), OUT, "append", "none" if keep_ms is None else "processingTime")
    if keep_ms is not None:
        raise ValueError("state is dropped by the clock or by the rows' times, not by both")
    timed = rows.withColumn("_time", F.timestamp_millis("ts")).withWatermark("_time", delay)
    return timed.groupBy("session").transformWithStateInPandas(SeenProcessor(None, cap, idle_ms), OUT, "append", "eventTime")


class ConflictProcessor(StatefulProcessor):
    """For each file: each writer's newest intent and newest landed edit."""

    def __init__(self, fresh_ms: int, keep_ms: int | None, asks_become_intents: bool = True):
        self.fresh_ms, self.keep_ms, self.asks_become_intents = fresh_ms, keep_ms, asks_become_intents

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wrote = handle.getMapState("wrote", _WRITER, _WROTE, self.keep_ms)

    def _conflict(self, wrote: Fetched, writers: list[tuple[str, str]], own: tuple[str, str], now: int, seen: int | None, seen_hash: str | None):
        landed = None
        for writer in writers:
            held = wrote.get(writer) if writer != own else None
            if held is None:
                continue
            intent, edit = held
            if intent is not None and 0 <= now - intent <= self.fresh_ms and not (seen is not None and seen > intent):
                return "in-flight", writer
            if landed is None and edit is not None and seen is not None and not seen_hash and edit > seen:
                landed = writer
        return ("landed-edit", landed) if landed else (None, (None, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from given(self._told(rows), CONFLICTS.names, ("ask",))

    def _told(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        wrote = Fetched(self.wrote)
        writers = sorted(k for k, _ in wrote.items())
        for r in in_order(rows, "ts", _asked):
            own = (r.sid, _text(r.agent) or "")
            held = wrote.get(own)
            intent, edit = held or (None, None)
            if r.kind == "intent":
                if edit is None or r.ts > edit:
                    intent = max(intent or 0, int(r.ts))
            elif r.kind == "landed":
                # an edit that has landed ends the writer's intents up to it
                edit = max(edit or 0, int(r.ts))
                intent = intent if intent is not None and intent > edit else None
            else:
                seen = int(r.seen_ts) if pd.notna(r.seen_ts) else None
                asked = r.tool in GUARDED and bool(r.exists)
                kind, other = self._conflict(wrote, writers, own, int(r.ts), seen, _text(r.seen_hash)) if r.verdict == "allow" and asked else (None, (None, None))
                allowed = r.verdict == "allow" and kind is None
                if allowed and asked and self.asks_become_intents:
                    intent = max(intent or 0, int(r.ts))
                yield int(r.ask), r.verdict, kind, *other, allowed, allowed and asked
            if (intent, edit) != (held or (None, None)):
                if held is None:
                    insort(writers, own)
                wrote.put(own, (intent, edit))
        wrote.put_back()

    def close(self) -> None:
        pass


def conflict_stream(rows: DataFrame, fresh_secs: int = INTENT_SECS, keep_ms: int | None = None, asks_become_intents: bool = True) -> DataFrame:
    """The guard's verdicts with other writers' conflicts where it allows, and whether the edit becomes an intent of its writer.

    rows: (key, kind, sid, agent, ts, ask, verdict, tool, exists, seen_ts, seen_hash); kind is `intent`, `landed` or `ask`. A fresh
    intent comes before a landed edit; of several writers the first by name counts. asks_become_intents: whether an edit that is allowed is
    its writer's intent from then on, or the writers' intents come as rows of their own only.
    """
    return rows.groupBy("key").transformWithStateInPandas(ConflictProcessor(fresh_secs * 1000, keep_ms, asks_become_intents), CONFLICTS, "append", "none" if keep_ms is None else "processingTime")


def dedup_edits(edits: DataFrame, delay: str = "1 hour", bucket_ms: int = 5000) -> DataFrame:
    """Edits of a stream, one for each (writer, file, time bucket): the first of a bucket, or the first with a hash.

    `ts_time` is their event time. A bucket comes through once the watermark has passed it, so that nothing better can follow.
    """
    window = F.window("ts_time", f"{bucket_ms} milliseconds", startTime=f"{bucket_ms // 2} milliseconds")
    keyed = edits.withWatermark("ts_time", delay).groupBy(window.alias("_window"), "sid", "agent", path_key(F.col("path")).alias("_key"))
    best = F.min_by(F.struct(*edits.columns), F.struct(F.col("hash").isNull().alias("none"), "ts"))
    return keyed.agg(best.alias("x")).select("x.*")
