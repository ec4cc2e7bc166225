"""A streaming source of server-sent events: folders of files, one folder a stream, whose bytes follow one another.

Files of a stream are taken in order of their names; the last may still grow, and new ones
may come. Offsets are bytes of each stream, and an event belongs to the batch within which the
empty line after it ends, wherever it began. So a batch can be cut anywhere, also within an event or at the
end of a file, and be read again after a failure with the same result; nothing is kept between batches.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "stream_id string, stop long, type string, data string, event binary"
#: Bytes that are read at once, and rows of an Arrow batch.
BLOCK, ROWS = 1 << 20, 1024
#: Each batch takes at most so many bytes of a stream, and one task so many, unless the options say otherwise.
BATCH_BYTES, SPLIT_BYTES = 1 << 30, 64 << 20


class Span(InputPartition):
    def __init__(self, stream: str, files: list[tuple[str, int]], start: int, stop: int):
        self.stream, self.files, self.start, self.stop = stream, files, start, stop


def _listed(root: str) -> dict[str, list[tuple[str, int]]]:
    """Paths and sizes of the files of each stream, in order."""
    store, path = fs.FileSystem.from_uri(root)
    found: dict[str, list[tuple[str, int]]] = {}
    for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        stream, _, name = info.path.removeprefix(path).strip("/").rpartition("/")
        if info.is_file and stream and not re.search(r"(?:^|/)[._]", f"{stream}/{name}"):
            found.setdefault(stream, []).append((info.path, info.size))
    return {k: sorted(v) for k, v in sorted(found.items())}


class Bytes:
    """The bytes of a stream, over its files."""

    def __init__(self, root: str, files: list[tuple[str, int]]):
        self.store, _ = fs.FileSystem.from_uri(root)
        self.files = files
        self.begins = [0]
        for _, size in files:
            self.begins.append(self.begins[-1] + size)

    def at(self, start: int, n: int) -> bytes:
        out = []
        stop = min(start + n, self.begins[-1])
        while start < stop:
            k = bisect_right(self.begins, start) - 1
            upto = min(stop, self.begins[k + 1])
            with self.store.open_input_file(self.files[k][0]) as file:
                out.append(file.read_at(upto - start, start - self.begins[k]))
            start = upto
        return b"".join(out)


def _boundary(stream: Bytes, start: int) -> int:
    """A place at or before start where an empty line ends, or the beginning."""
    stop = start
    while stop > 0:
        begin = max(0, stop - BLOCK)
        block = stream.at(begin, min(start, stop + 2) - begin)
        at = max(block.rfind(b"\n\n"), block.rfind(b"\n\r\n"))
        if at >= 0:
            return begin + at + (2 if block[at + 1 : at + 2] == b"\n" else 3)
        stop = begin
    return 0


def events(stream: Bytes, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """End and bytes of each event whose empty line ends after start, and at or before stop. An event is a run of lines that aren't empty."""
    at = _boundary(stream, start)
    held, rest = [], b""
    while at < stop:
        block = stream.at(at, min(BLOCK, stop - at))
        if not block:
            return
        place = at - len(rest)
        at += len(block)
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        for line in lines:
            place += len(line) + 1
            if line not in (b"", b"\r"):
                held.append(line)
            elif held:
                if place > start:
                    yield place, b"\n".join(held) + b"\n" + line + b"\n"
                held = []


def fields(event: bytes) -> tuple[str | None, str]:
    """The type of an event, and its data lines joined by line feeds; bytes that aren't UTF-8 are replaced here, not in the event."""
    kind, data = None, []
    for line in event.split(b"\n"):
        name, _, value = line.removesuffix(b"\r").partition(b":")
        value = value.removeprefix(b" ").decode("utf-8", "replace")
        if name == b"event":
            kind = value
        elif name == b"data":
            data.append(value)
    return kind, "\n".join(data)


def _batches(root: str, span: Span) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["stream_id", "stop", "type", "data", "event"])

    for stop, event in events(Bytes(root, span.files), span.start, span.stop):
        rows.append((span.stream, stop, *fields(event), event))
        weight += len(event)
        if len(rows) >= ROWS or weight >= 8 * BLOCK:
            yield batch()
            rows, weight = [], 0
    if rows:
        yield batch()


def _spans(files: dict[str, list[tuple[str, int]]], start: dict, end: dict, most: int) -> list[Span]:
    return [Span(s, files[s], a, min(a + most, end[s])) for s in sorted(end) for a in range(start.get(s, 0), end[s], most)]


class _Options:
    def __init__(self, options: dict):
        self.root = options["path"]
        if "://" not in self.root:
            self.root = "file://" + self.root
        self.batch = int(options.get("maxBytesPerBatch", BATCH_BYTES))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        if self.batch < 1 or self.split < 1:
            raise ValueError("maxBytesPerBatch and splitBytes are at least 1")


class EventReader(DataSourceReader):
    """All events that are there now."""

    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[Span]:
        files = _listed(self.options.root)
        return _spans(files, {}, {s: sum(n for _, n in f) for s, f in files.items()}, self.options.split) or [Span("", [], 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.options.root, partition)


class EventStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = _Options(options)
        self.told: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"bytes": "{}"}

    def latestOffset(self) -> dict:
        """As far as the files reach, but no more than a batch beyond what was told last."""
        for stream, files in _listed(self.options.root).items():
            self.told[stream] = min(sum(n for _, n in files), self.told.get(stream, 0) + self.options.batch)
        return {"bytes": json.dumps(self.told, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        a, b = json.loads(start["bytes"]), json.loads(end["bytes"])
        self.told = {s: max(n, self.told.get(s, 0)) for s, n in b.items()}
        return _spans(_listed(self.options.root), a, b, self.options.split)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.options.root, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are; offsets tell what was read."""


class EventSource(DataSource):
    """Format "sse": stream_id, stop (the byte of its stream at which an event ends), type, data and event.

    Options: path (of the folder of stream folders, in a store that Arrow knows), maxBytesPerBatch
    (of each stream) and splitBytes (of each task). Names that begin with a dot or an underscore
    are left out. What follows the last empty line is no event yet.
    """

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Have spark.read and spark.readStream know the format."""
    spark.dataSource.register(EventSource)
