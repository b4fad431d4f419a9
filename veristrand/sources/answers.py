"""Growing answers as a data source: folders of line-delimited JSON files, in batch and as a stream.

``spark.read.format("answers")`` and ``spark.readStream.format("answers")`` give request, seq
and line of each whole line below a folder. A file holds the answer named like it, or lines
that name theirs in ``request``; seq is the line's place in its file, in bytes, so it grows as
the file does. A stream's offset is how far each file had grown; a line without its end waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that are looked at in one go.
BLOCK = 1 << 20
#: Lines of an Arrow batch.
LINES = 4096


@dataclass
class Span(InputPartition):
    """Bytes of a file that a task reads: from the start of a line to the end of another."""

    path: str
    start: int
    end: int


def _located(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _sizes(root: str, ending: str) -> dict[str, int]:
    system, at = _located(root)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return {}
    return {i.path: i.size for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.path.endswith(ending) and not i.base_name.startswith(("_", "."))}


def _whole(system: fs.FileSystem, path: str, start: int, end: int) -> int:
    """The end of the last whole line of the span."""
    with system.open_input_file(path) as f:
        while end > start:
            low = max(start, end - BLOCK)
            f.seek(low)
            found = f.read(end - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            end = low
    return start


def _lines(root: str, span: Span) -> Iterator[pa.RecordBatch]:
    system, _ = _located(root)
    name = span.path.rsplit("/", 1)[-1].split(".", 1)[0]
    rows: list[tuple] = []
    with system.open_input_file(span.path) as f:
        f.seek(span.start)
        at, rest = span.start, b""
        while at < span.end or rest:
            block = f.read(min(BLOCK, span.end - at))
            at += len(block)
            *whole, tail = (rest + block).split(b"\n")
            place = at - len(rest) - len(block)
            if not block:  # the file became shorter
                whole, tail = [tail], b""
            for raw in whole:
                if raw.strip():
                    rows.append((_request(raw, name), place, raw.decode("utf-8", "replace")))
                place += len(raw) + 1
                if len(rows) >= LINES:
                    yield _batch(rows)
                    rows = []
            rest = tail
            if at >= span.end and not rest:
                break
    if rows:
        yield _batch(rows)


def _request(raw: bytes, name: str) -> str:
    try:
        found = json.loads(raw)
    except ValueError:  # the line is told as it is
        return name
    return str(found["request"]) if isinstance(found, dict) and "request" in found else name


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    request, seq, line = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(request, pa.string()), pa.array(seq, pa.int64()), pa.array(line, pa.string())], names=["request", "seq", "line"])


class _Reader(DataSourceReader):
    def __init__(self, root: str, ending: str):
        self.root, self.ending = root, ending

    def partitions(self) -> list[Span]:
        return [Span(p, 0, n) for p, n in sorted(_sizes(self.root, self.ending).items()) if n] or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.path:
            system, _ = _located(self.root)
            yield from _lines(self.root, Span(span.path, 0, _whole(system, span.path, 0, span.end)))


class _StreamReader(DataSourceStreamReader):
    """Offsets: how far each file has been seen, always at the end of a line."""

    def __init__(self, root: str, ending: str):
        self.root, self.ending, self.seen = root, ending, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = _located(self.root)
        for path, size in _sizes(self.root, self.ending).items():
            was = self.seen.get(path, 0)
            if size > was:
                self.seen[path] = _whole(system, path, was, size)
        return {p: n for p, n in sorted(self.seen.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return _lines(self.root, span)

    def commit(self, end: dict) -> None:
        pass


class AnswerSource(DataSource):
    """Options: path, the folder; ending, of its files (.ndjson)."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return "request string, seq long, line string"

    def _of(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("ending", ".ndjson")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._of())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(*self._of())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnswerSource)
