"""Logs of lines that still grow, as a source of batches and streams: a line counts once its end is written."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that are looked through at a time.
CHUNK = 1 << 20


@dataclass
class Span(InputPartition):
    """The lines of a file that start in [start, stop); none goes beyond ``end``."""

    file: str
    start: int
    stop: int
    end: int


def _files(path: str) -> tuple[object, dict[str, int]]:
    """The file system of a folder or file, and the sizes of its files; hidden ones don't count."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return system, {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


def whole_lines(system: object, file: str, start: int, size: int) -> int:
    """Where the last line that has its end stops, looked for backwards from ``size``; ``start`` if none has."""
    with system.open_input_file(file) as f:
        stop = size
        while stop > start:
            low = max(start, stop - CHUNK)
            f.seek(low)
            at = f.read(stop - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            stop = low
    return start


def spans(file: str, start: int, end: int, split: int) -> list[Span]:
    """[start, end) in pieces; ``start`` is where a line starts."""
    return [Span(file, a, min(a + split, end), end) for a in range(start, end, split)]


def lines_of(path: str, span: Span) -> Iterator[tuple[str]]:
    """A piece's lines without their ends. A line belongs to the piece that its first byte is in, so a piece in the middle starts behind the first line end from the byte before it on."""
    system, _ = _files(path)
    with system.open_input_file(span.file) as f:
        at = line_at = max(0, span.start - 1)
        f.seek(at)
        left, skip = b"", span.start > 0
        while at < span.end and line_at < span.stop:
            data = f.read(min(CHUNK, span.end - at))
            if not data:
                break
            at += len(data)
            *whole, left = (left + data).split(b"\n")
            for line in whole:
                begun, line_at = line_at, line_at + len(line) + 1
                if skip:
                    skip = False
                elif begun < span.stop:
                    yield (line.removesuffix(b"\r").decode("utf-8", "replace"),)
        if left and not skip and line_at < span.stop:
            yield (left.decode("utf-8", "replace"),)


class _Reader:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))
        self.closed = options.get("closed", "false").lower() == "true"

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        """How far each file may be read."""
        system, sizes = _files(self.path)
        return {f: max(known.get(f, 0), n if self.closed else whole_lines(system, f, known.get(f, 0), n)) for f, n in sorted(sizes.items())}

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[Span]:
        return [s for f, n in end.items() for s in spans(f, start.get(f, 0), n, self.split)]


class LineReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.between({}, self.ends({}))

    def read(self, partition: Span | None) -> Iterator[tuple[str]]:
        return lines_of(self.path, partition) if partition else iter(())  # Spark reads nothing as a piece of None


class LineStreamReader(_Reader, DataSourceStreamReader):
    """An offset is the bytes read of each file, always at the start of a line: what is cut off stays for the next batch, and Spark's checkpoint keeps the rest."""

    known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        self.known = self.ends(self.known)
        return {"files": json.dumps(self.known)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.between(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: Span | None) -> Iterator[tuple[str]]:
        return lines_of(self.path, partition) if partition else iter(())


class GrowingLines(DataSource):
    """``spark.read`` or ``readStream`` ``.format("growing_lines")``: a column ``value``, a row for each line of a file or of the files in a folder, while they are being written.

    A line without its end is left until it has one; with the option ``closed`` files are at their end, and a last line without an end counts. Files only grow, and a batch's
    offset lists them all, so it is meant for logs of few files; ``splitBytes`` (64 MB) is what a task reads. Bytes that aren't UTF-8 become replacement marks.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: object) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema: object) -> LineStreamReader:
        return LineStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
