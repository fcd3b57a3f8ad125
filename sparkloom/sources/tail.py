"""A streaming source that tails growing JSON-lines files: only complete new lines, from where each file was left.

Spark's own file source tracks whole files and wouldn't see appended bytes. What a trigger takes is a plan: byte ranges of files, admitted
up to a number of files and bytes, in turn, so that one busy file doesn't keep others waiting. Plans are numbered and written to a folder
before they are used; the stream's offset is a plan's number, so a batch that is done again reads the same ranges, and what a restart finds
there is where every file was left. A plan holds what it changes; every so often it holds all files' offsets too, and older plans
are deleted once they are committed. A file that shrank is read from its start again; one that is gone is forgotten.

Long ranges are cut into splits that several tasks read: a split takes the lines that begin in it. Folders may be on any file system that Arrow
opens by its URI (local, s3, gs, hdfs), from the driver and the tasks alike.

    register(spark)
    spark.readStream.format("tailed_lines").option("path", folder).option("plans", other_folder).option("maxBytesPerTrigger", 1 << 30).load()
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("file", StringType()), StructField("offset", LongType()), StructField("value", StringType())])
#: Bytes that a task reads, about; plans between two that hold all offsets; bytes that are read at once.
SPLIT_BYTES, SNAPSHOT_EVERY, BLOCK = 16 << 20, 20, 1 << 20


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return arrow_fs.LocalFileSystem(), path


def _after_line_end(f, start: int, end: int, block: int) -> int | None:
    """The offset after the first line end in [start, end)."""
    while start < end:
        f.seek(start)
        at = f.read(min(block, end - start)).find(b"\n")
        if at >= 0:
            return start + at + 1
        start += block
    return None


def _complete_until(f, start: int, end: int, block: int = BLOCK) -> int:
    """The offset after the last line end in [start, end), or start: found by reading backwards, a block at a time."""
    while end > start:
        begin = max(start, end - block)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def _lines(f, start: int, end: int, size: int, block: int = BLOCK) -> Iterator[tuple[int, str]]:
    """(offset, text) of the lines without blank ones that begin in [start, end); one begins at start."""
    rest, at, read = b"", start, start
    f.seek(start)
    while at < end and (chunk := f.read(min(block, size - read))):
        read += len(chunk)
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            if at >= end:
                return
            text = line.decode("utf-8", "replace")
            if text.strip():
                yield at, text
            at += len(line) + 1


def read_new_lines(path: str, offset: int) -> tuple[list[str], int]:
    """(complete new lines without blank ones, the next offset). A shrunk file gives no lines and offset 0."""
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        size = f.size()
        if size < offset:
            return [], 0
        end = _complete_until(f, offset, size)
        return [line for _, line in _lines(f, offset, end, end)], end


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool, upto: int):
        super().__init__(None)
        self.path, self.start, self.end, self.first, self.upto = path, start, end, first, upto


class Plans:
    """The numbered plans under a folder, and where they have left every file."""

    def __init__(self, folder: str):
        self.fs, self.folder = opened(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.offsets: dict[str, int] = {}
        self.number, self.turn = -1, ""
        held = sorted(self._held())
        from_ = next((n for n in reversed(held) if "offsets" in self.read(n)), 0)
        for n in (n for n in held if n >= from_):
            self._take(n, self.read(n))

    def _held(self) -> list[int]:
        return [int(i.base_name.removesuffix(".json")) for i in self.fs.get_file_info(arrow_fs.FileSelector(self.folder)) if i.base_name.endswith(".json")]

    def _path(self, n: int) -> str:
        return posixpath.join(self.folder, f"{n:012d}.json")

    def read(self, n: int) -> dict:
        with self.fs.open_input_stream(self._path(n)) as f:
            return json.loads(f.read())

    def _take(self, n: int, plan: dict) -> None:
        self.offsets = plan.get("offsets", self.offsets)
        for path, _, end in plan["ranges"]:
            self.offsets[path] = end
        for path in plan["gone"]:
            self.offsets.pop(path, None)
        self.number, self.turn = n, plan["turn"]

    def add(self, ranges: list[tuple[str, int, int]], gone: list[str]) -> None:
        n, turn = self.number + 1, ranges[-1][0] if ranges else self.turn
        plan = {"ranges": ranges, "gone": gone, "turn": turn}
        self._take(n, plan)
        if n % SNAPSHOT_EVERY == 0:
            plan["offsets"] = self.offsets
        # written whole under another name first: a plan is there or isn't
        with self.fs.open_output_stream(self._path(n) + ".part") as f:
            f.write(json.dumps(plan).encode())
        self.fs.move(self._path(n) + ".part", self._path(n))

    def forget_before(self, n: int) -> None:
        """Delete plans that neither a batch nor a restart needs: those before the newest snapshot that isn't after n."""
        keep = n - n % SNAPSHOT_EVERY
        for old in self._held():
            if old < keep:
                self.fs.delete_file(self._path(old))


class TailReader(DataSourceStreamReader):
    """Plans are made on the driver, from sizes and one look for a line end in each file with news; lines are read by tasks."""

    def __init__(self, folder: str, plans: str, max_files: int | None = None, max_bytes: int | None = None, split: int = SPLIT_BYTES):
        self.folder, self.max_files, self.max_bytes, self.split = folder, max_files, max_bytes, split
        self.plans = Plans(plans)
        self.asked = -1

    def initialOffset(self) -> dict:
        return {"plan": -1}

    def _sizes(self) -> dict[str, int]:
        fs, root = opened(self.folder)
        found = fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True, recursive=True))
        return {i.path: i.size for i in found if i.type == arrow_fs.FileType.File and i.base_name.endswith(".jsonl")}

    def _admitted(self, sizes: dict[str, int]) -> list[tuple[str, int, int]]:
        known, fs = self.plans.offsets, opened(self.folder)[0]
        news = sorted(p for p, size in sizes.items() if size != known.get(p, 0))
        news = [p for p in news if p > self.plans.turn] + [p for p in news if p <= self.plans.turn]
        ranges, left = [], self.max_bytes
        for path in news:
            if len(ranges) == self.max_files or (left is not None and left <= 0):
                break
            begin, size = known.get(path, 0), sizes[path]
            begin = begin if begin <= size else 0
            with fs.open_input_file(path) as f:
                end = _complete_until(f, begin, size if left is None else min(size, begin + left))
                if end == begin and left is not None:  # a line longer than what is left goes alone
                    end = (_after_line_end(f, begin, size, BLOCK) or begin) if not ranges else begin
            if end > begin or path in known and begin == 0 and known[path] > size:
                ranges.append((path, begin, end))
                left = None if left is None else left - (end - begin)
        return ranges

    def latestOffset(self) -> dict:
        if self.plans.number <= self.asked or self.asked < 0:  # else a plan waits to be asked for
            sizes = self._sizes()
            ranges, gone = self._admitted(sizes), [p for p in self.plans.offsets if p not in sizes]
            if ranges or gone:
                self.plans.add(ranges, gone)
        return {"plan": self.plans.number}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.asked = max(self.asked, end["plan"])
        out = []
        for n in range(start["plan"] + 1, end["plan"] + 1):
            for path, a, b in self.plans.read(n)["ranges"]:
                out += [Range(path, s, min(b, s + self.split), s == a, b) for s in range(a, b, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        with opened(self.folder)[0].open_input_file(partition.path) as f:
            # a line that begins where the split does belongs to it; the byte before tells
            at = partition.start if partition.first else _after_line_end(f, partition.start - 1, partition.upto, BLOCK)
            for offset, text in _lines(f, at, partition.end, partition.upto) if at is not None and at < partition.end else ():
                yield partition.path, offset, text

    def commit(self, end: dict) -> None:
        self.plans.forget_before(end["plan"])


class TailedLines(DataSource):
    """Options: path, plans, and if wanted maxFilesPerTrigger, maxBytesPerTrigger, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        number = lambda name: int(self.options[name]) if name in self.options else None
        return TailReader(self.options["path"], self.options["plans"], number("maxFilesPerTrigger"), number("maxBytesPerTrigger"), number("splitBytes") or SPLIT_BYTES)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailedLines)
