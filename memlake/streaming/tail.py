"""A streaming source that follows growing files of lines: offsets are (generation, byte) for each file.

A batch takes complete lines only, up to a number of bytes shared out among the
files that have grown. A line of more than `max_record` bytes becomes a row of
its own kind without its text. A file that is shorter than what was read of it
has been rewound: a row says from where to where, its generation goes up by
one, and it is read from its start again. Of a file that is gone the place is
kept for a day. Large ranges are read by several tasks, each of which takes the
lines that begin in its part.

Spark keeps the offsets of batches. What was planned last also lies in a
registry beside the checkpoint, as a reader is not told where a batch begins
until it has said where it ends; it is written when a batch is planned, so that
a batch that is planned again after a restart leaves it as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a batch, of a task, of the longest line and of a read; rows of an Arrow batch; seconds that the place in a missing file is kept.
BATCH, TASK, RECORD, READ, ROWS, KEPT = 1 << 30, 1 << 24, 1 << 24, 1 << 20, 4096, 86_400
#: kind: line, oversized or rewind. first and last: bytes of the line in its file; of a rewind what had been read and the size now.
SCHEMA = "file string, generation int, kind string, first long, last long, raw string"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _chunks(f, at: int, end: int) -> Iterator[bytes]:
    f.seek(at)
    while at < end and (data := f.read(min(READ, end - at))):
        yield data
        at += len(data)


def _after_line(f, at: int, end: int) -> int:
    """The byte after the first line end from `at`, or -1."""
    for data in _chunks(f, at, end):
        k = data.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(data)
    return -1


def _last_line(f, at: int, end: int) -> int:
    """The byte after the last line end from `at` to `end`, or -1."""
    while end > at:
        begin = max(at, end - READ)
        k = b"".join(_chunks(f, begin, end)).rfind(b"\n")
        if k >= 0:
            return begin + k + 1
        end = begin
    return -1


def complete(f, at: int, share: int, size: int) -> int:
    """Where a batch of `share` bytes from `at` ends: after its last complete line, or after its first one if that is longer."""
    limit = min(size, at + share)
    end = _last_line(f, at, limit)
    if end < 0 and limit < size:
        end = _after_line(f, limit, size)
    return max(end, at)


def lines(f, begin: int, end: int, whole_end: int, first: bool, longest: int) -> Iterator[tuple[int, int, bytes | None]]:
    """Lines that begin from `begin` to `end`: (first, last byte, text without its end; None if it is longer than `longest`).

    Unless the part is the first of its range, what runs on from before is left to the part before.
    """
    at = begin if first else _after_line(f, begin - 1, whole_end)
    if at < 0:
        return
    start, held = at, bytearray()
    long = False
    for data in _chunks(f, at, whole_end):
        cursor = 0
        while start < end and (k := data.find(b"\n", cursor)) >= 0:
            held += data[cursor:k] if not long else b""
            yield start, at + k + 1, None if long or len(held) > longest else bytes(held)
            start, cursor, held, long = at + k + 1, k + 1, bytearray(), False
        if start >= end:
            return
        if not long:
            held += data[cursor:]
            if len(held) > longest:  # no more than that is ever held
                held, long = bytearray(), True
        at += len(data)


class Part(InputPartition):
    def __init__(self, file: str, generation: int, begin: int, end: int, whole_end: int, first: bool, was: int = -1):
        self.file, self.generation, self.begin, self.end, self.whole_end, self.first, self.was = file, generation, begin, end, whole_end, first, was


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.pattern, self.registry = options.get("pattern", "*"), options["registry"]
        self.batch, self.task, self.record = (int(options.get(k, v)) for k, v in (("batchbytes", BATCH), ("taskbytes", TASK), ("recordbytes", RECORD)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _planned(self) -> dict:
        store, path = _store(self.registry)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _files(self) -> dict[str, int]:
        found = {}
        for root in self.roots:
            store, path = _store(root)
            for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
                if info.is_file and fnmatch(info.base_name, self.pattern):
                    found[f"{root.rstrip('/')}{info.path[len(path.rstrip('/')):]}"] = info.size
        return found

    def latestOffset(self) -> dict:  # noqa: N802
        made, sizes, now = self._planned(), self._files(), int(time.time())
        for file in [x for x in made if x not in sizes]:
            gone = made[file].setdefault("gone", now)
            if now - gone > KEPT:
                del made[file]
        for file, size in sizes.items():
            at = made.setdefault(file, {"generation": 0, "at": 0})
            at.pop("gone", None)
            if size < at["at"]:
                made[file] = {"generation": at["generation"] + 1, "at": 0, "was": at["at"], "now": size}
        waiting = sorted((size - made[file]["at"], file) for file, size in sizes.items() if size > made[file]["at"])
        left = self.batch
        for k, (_, file) in enumerate(waiting):  # those with little first, so that their shares' rest goes to the others
            store, path = _store(file)
            with store.open_input_file(path) as f:
                at = made[file]["at"]
                made[file]["at"] = complete(f, at, max(1, left // (len(waiting) - k)), sizes[file])
            left = max(0, left - made[file]["at"] + at)
        return made

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, path = _store(self.registry)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        new = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as f:
            f.write(json.dumps(end).encode())
        store.move(new, path)
        parts: list[InputPartition] = []
        for file, to in sorted(end.items()):
            own = start.get(file, {"generation": 0, "at": 0})
            at = own["at"]
            if own["generation"] != to["generation"]:
                parts.append(Part(file, to["generation"], 0, to["now"], 0, True, to["was"]))
                at = 0
            parts += [Part(file, to["generation"], a, min(a + self.task, to["at"]), to["at"], a == at) for a in range(at, to["at"], self.task)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        def batch(kinds, firsts, lasts, raws):
            n = len(kinds)
            raw = pa.array(raws, pa.binary())
            try:
                raw = raw.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8 are replaced; the record then fails where it is parsed
                raw = pa.array([x if x is None else x.decode("utf-8", "replace") for x in raws], pa.string())
            columns = [pa.array([part.file] * n), pa.array([part.generation] * n, pa.int32()), pa.array(kinds), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), raw]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        if part.was >= 0:
            yield batch(["rewind"], [part.was], [part.end], [None])
            return
        store, path = _store(part.file)
        held: list[tuple[str, int, int, bytes | None]] = []
        size = 0
        with store.open_input_file(path) as f:
            for a, z, raw in lines(f, part.begin, part.end, part.whole_end, part.first, self.record):
                if raw is not None and not raw.strip():
                    continue
                held.append(("oversized" if raw is None else "line", a, z, raw))
                size += len(raw or b"")
                if len(held) >= ROWS or size >= 4 * READ:
                    yield batch(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield batch(*map(list, zip(*held, strict=True)))

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def tail(
    spark: SparkSession, roots: list[str], checkpoint: str, pattern: str = "*", batch_bytes: int = BATCH, task_bytes: int = TASK, record_bytes: int = RECORD
) -> DataFrame:
    """A stream of the lines (`SCHEMA`) of the files under the folders; blank lines are left out. `checkpoint` is that of the query that
    reads it, in a folder that driver and executors share."""
    spark.dataSource.register(TailSource)
    options = {"roots": json.dumps(roots), "pattern": pattern, "registry": f"{checkpoint}/tail.json", "batchBytes": str(batch_bytes), "taskBytes": str(task_bytes), "recordBytes": str(record_bytes)}
    return spark.readStream.format("tailed_lines").options(**options).load()
