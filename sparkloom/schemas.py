"""Schemas of the logical tables. Readers apply them as they are; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BooleanType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _list(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


#: One line of the append-only event log: which session was shown which version of which file.
ARCHIVE_EVENT = _of(
    ts=S, session=S, path=S, repo=S, hash=S, gitBlobSha1=S, bytes=L, approxTokens=L,
    source=S, op=S, view=S, sidechain=B, excluded=B,
)
BLOB = _of(hash=S, content=S, bytes=L, git_sha1=S, mtime=L)
METER_EVENT = _of(
    ts=S, path=S, repo=S, view=S, kind=S, epoch=L, hash=S, baseHash=S, gitBlobSha1=S,
    excluded=B, bytes=L, baselineTokens=L, sentTokens=L,
)
READ_REQUEST = _of(session=S, seq=L, path=S, view=S, content=S, force_full=B, epoch=L)
WORKING_SET_ENTRY = _of(path=S, hash=S, bytes=L, approxTokens=L, reads=L, edits=L, lastOp=S, lastTs=S, excluded=B)
MANIFEST = _of(session=S, ts=S, entries=_list(WORKING_SET_ENTRY))
PRESENCE = _of(sid=S, agent=S, pid=L, updatedAt=L, intents=_list(_of(path=S, ts=L)), edits=_list(_of(path=S, ts=L, hash=S)))
EDIT = _of(sid=S, agent=S, path=S, ts=L, hash=S)
INTENT = _of(sid=S, agent=S, path=S, ts=L)
SEEN = _of(key=S, ts=L, hash=S)
DISK_SNAPSHOT = _of(path=S, exists=B, size=L, content=S, hash=S)

#: What a transcript line holds that any operator looks at; every other field is skipped by the parser.
_INPUT = _of(file_path=S, notebook_path=S, path=S, paths=_list(S), files=_list(S), symbol=S, offset=L, limit=L)
_BLOCK = _of(type=S, id=S, name=S, input=_INPUT, tool_use_id=S, is_error=B, content=S)
_FILE = _of(filePath=S, content=S, startLine=L, numLines=L, totalLines=L)
TRANSCRIPT_LINE = _of(timestamp=S, isSidechain=B, message=_of(content=_list(_BLOCK)), toolUseResult=_of(file=_FILE, filePath=S, content=S))
