"""A Spark data source that writes a table as one JSON array, or as JSON lines, all at once.

Every attempt of a task writes a file of its own name and reports it; only files that the commit names
become part of the result, so attempts that failed or ran twice leave nothing behind. The result
appears under its final name in one move.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at a time.
COPY = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


def _plain(value):
    """Without fields that are null, as Spark's own JSON; lists keep theirs."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [dict(v) if isinstance(v, list) and v and all(isinstance(p, tuple) for p in v) else _plain(v) for v in value]
    return value


class JsonWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: str, overwrite: bool) -> None:
        if layout not in ("array", "lines"):
            raise ValueError(f"layout must be array or lines, not {layout}")
        self.path, self.layout, self.overwrite = path.rstrip("/"), layout, overwrite
        self.work = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, work = located(self.work)
        files.create_dir(work, recursive=True)
        name, rows = f"{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(f"{work}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    # one row a line in both layouts; between the rows of an array stands a comma
                    lead = ",\n" if rows and self.layout == "array" else ""
                    end = "\n" if self.layout == "lines" else ""
                    out.write((lead + json.dumps(_plain(row), ensure_ascii=False, default=str) + end).encode("utf-8", "surrogatepass"))
                    rows += 1
        context = TaskContext.get()
        return Part(context.partitionId() if context else 0, name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        files, work = located(self.work)
        _, path = located(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        files.create_dir(work, recursive=True)
        if self.layout == "array":
            whole = f"{work}/whole"
            with files.open_output_stream(whole) as out:
                out.write(b"[\n")
                for n, part in enumerate(parts):
                    out.write(b",\n" if n else b"")
                    with files.open_input_stream(f"{work}/{part.name}") as piece:
                        while data := piece.read(COPY):
                            out.write(data)
                out.write(b"\n]\n")
            made = whole
        else:
            made = f"{work}/whole"
            files.create_dir(made)
            for n, part in enumerate(parts):
                files.move(f"{work}/{part.name}", f"{made}/part-{n:05d}.json")
        there = files.get_file_info(path)
        if there.type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            if there.type == fs.FileType.Directory:
                files.delete_dir(path)
            elif self.layout == "lines":
                files.delete_file(path)
        files.move(made, path)
        files.delete_dir(work)

    def abort(self, messages: list[Part | None]) -> None:
        files, work = located(self.work)
        if files.get_file_info(work).type != fs.FileType.NotFound:
            files.delete_dir(work)


class JsonSink(DataSource):
    """format("lyricspark_json"), options path and layout: array (one file) or lines (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "lyricspark_json"

    def writer(self, schema, overwrite: bool) -> JsonWriter:
        return JsonWriter(self.options["path"], self.options.get("layout", "array"), overwrite)
