"""Delivery as a stream: each session's ledger of what it has been sent, kept as keyed state.

The ledger remembers what was sent last of each file, oldest first, as far as a number of bytes goes. Entries are map state by file, and by the
place at which they were sent: an answer touches its own entry, and forgetting takes places from the oldest on, each once. A batch fetches
an entry once and puts it back once; places that it makes and takes never reach the store. A read of another epoch begins a new ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.delivery import LEDGER_BYTES, MARKER_BYTES
from .seen import B, Fetched, L, S, _fields, given, in_order

SENT = _fields(session=S, seq=L, path=S, view=S, kind=S, base_hash=S)
_FILE, _ENTRY, _AT, _NAME = _fields(path=S, view=S), _fields(hash=S, bytes=L, at=L), _fields(at=L), _fields(path=S, view=S)
#: epoch, bytes held, the next place, the oldest place that may still be held.
_HEAD = _fields(epoch=L, known=B, held=L, next=L, oldest=L)


class LedgerProcessor(StatefulProcessor):
    def __init__(self, ledger_bytes: int):
        self.ledger_bytes = ledger_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", _FILE, _ENTRY)
        self.places = handle.getMapState("places", _AT, _NAME)
        self.head = handle.getValueState("head", _HEAD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from given(self._sent(key[0], rows), SENT.names)

    def _sent(self, session: str, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        epoch, known, held, next_, oldest = tuple(self.head.get()) if self.head.exists() else (0, False, 0, 0, 0)
        begin = next_
        entries, places = Fetched(self.entries), Fetched(self.places, lambda at: at[0] >= begin)
        for r in in_order(rows, "seq"):
            if known and r.epoch != epoch:
                entries.clear()
                places.clear()
                begin = held = next_ = oldest = 0
            epoch, known, file = int(r.epoch), True, (r.path, r.view)
            before = entries.get(file)
            held_hash = before[0] if before and not r.force else None
            kind = "full" if held_hash is None else "changed" if held_hash != r.hash else "unchanged" if r.bytes > MARKER_BYTES else "full"
            yield session, int(r.seq), r.path, r.view, kind, held_hash if kind != "full" else None
            if kind == "unchanged":
                continue  # it keeps its place
            if before:
                held -= before[1]
                places.remove((before[2],))
            entries.put(file, (r.hash, int(r.bytes), next_))
            places.put((next_,), file)
            held, next_ = held + int(r.bytes), next_ + 1
            while held > self.ledger_bytes and oldest < next_ - 1:  # never what was just sent
                gone = places.get((oldest,))
                if gone:
                    held -= entries.get(gone)[1]
                    entries.remove(gone)
                    places.remove((oldest,))
                oldest += 1
        entries.put_back()
        places.put_back()
        self.head.update((epoch, known, held, next_, oldest))

    def close(self) -> None:
        pass


def delivery_stream(reads: DataFrame, ledger_bytes: int = LEDGER_BYTES) -> DataFrame:
    """reads(session, seq, path, view, epoch, hash, bytes, force) of a stream -> kinds and base hashes, as delivery.decide gives them: a session's
    reads of one batch in the order of seq, batches as they come. Paths are keys already. Needs the RocksDB state store."""
    return reads.groupBy("session").transformWithStateInPandas(LedgerProcessor(ledger_bytes), SENT, "append", "none")
