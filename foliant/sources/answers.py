"""Recorded answers of a chat service as a source of tables and streams.

Answers lie as lines of JSON, one answer a line, in files below a folder: request, call (from 1), status and body. Files
are read in byte ranges that begin and end at lines, so that a large file is many tasks. What isn't such a line comes back
in `broken`, and nothing is lost.

For a stream files count in the order of their paths, so a landing goes into a folder whose name is greater than those
before; `record` does that. An offset is the last path that has been read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "recorded_answers"
SCHEMA = "request long, call int, status int, body string, broken string"
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
SPLIT_BYTES, BATCH = 32 << 20, 4096


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    return files, base.rstrip("/")


def listed(folder: str) -> list[tuple[str, int]]:
    """Path below the folder and size of each file, in order; what is being written, or is no data, begins with _ or a dot."""
    files, base = opened(folder)
    found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    names = [(f.path.removeprefix(f"{base}/"), f.size) for f in found if f.type == fs.FileType.File and f.size]
    return sorted((n, size) for n, size in names if not any(part[0] in "_." for part in n.split("/")))


def ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(name, start, min(start + size, length)) for name, length in files for start in range(0, length, size)]


def whole_lines(file: io.BufferedIOBase, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin within the range."""
    at = start
    if start:
        file.seek(start - 1)
        at += len(file.readline()) - 1
    while at < end and (line := file.readline()):
        at += len(line)
        yield line.rstrip(b"\r\n")


def parsed(line: bytes) -> tuple:
    try:
        x = json.loads(line)
        if isinstance(x, dict) and all(x.get(k) is None or type(x[k]) is int for k in ("request", "call", "status")) and isinstance(x.get("body"), str | None):
            return x.get("request"), x.get("call"), x.get("status"), x.get("body"), None
    except ValueError:
        pass
    return None, None, None, None, line.decode("utf-8", "replace")


def read_range(folder: str, part: Range) -> Iterator[pa.RecordBatch]:
    files, base = opened(folder)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)

    rows: list[tuple] = []
    with files.open_input_file(f"{base}/{part.path}") as raw, io.BufferedReader(raw) as file:
        for line in whole_lines(file, part.start, part.end):
            if line:
                rows.append(parsed(line))
            if len(rows) == BATCH:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


class Reader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(listed(self.folder), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.folder, partition) if partition is not None else iter([])


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = listed(self.folder)
        return {"after": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return ranges([f for f in listed(self.folder) if start["after"] < f[0] <= end["after"]], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Answers stay where they are."""


class RecordedAnswers(DataSource):
    """Options: `path`, the folder, and `splitBytes`, the length of the ranges."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def record(answers: DataFrame, folder: str, landing: int) -> None:
    """Writes request, call, status and body as lines of JSON, as the landing of that number."""
    line = F.to_json(F.struct("request", "call", "status", "body"))
    answers.select(line.alias("value")).write.text(f"{folder}/{landing:08d}")


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RecordedAnswers)
    return spark.read.format(FORMAT).option("path", folder).load()


def recorded_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RecordedAnswers)
    return spark.readStream.format(FORMAT).option("path", folder).load()
