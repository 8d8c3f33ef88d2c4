"""The tail of text logs as a stream: a Python data source whose offsets are bytes of each file.

A batch takes whole lines only: the last line of a file waits until its line feed is there. A file is known by a
fingerprint of its first bytes, so that one that was replaced or cut is read from its start. Files are read in byte ranges, a task each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a file is known by, that are looked at for its last line feed at a time, and that a task reads at most (but for the line that goes on).
HEAD, BLOCK, RANGE = 256, 1 << 16, 64 << 20


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class LogReader(DataSourceStreamReader):
    """``path``: a folder, ``suffix``: what names end with, ``range``: bytes of a task."""

    def __init__(self, options: dict):
        self.system, self.path = pyarrow.fs.FileSystem.from_uri(options["path"])
        self.suffix, self.range = options.get("suffix", ".log"), int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        found = {}
        for info in self.system.get_file_info(pyarrow.fs.FileSelector(self.path, recursive=True, allow_not_found=True)):
            if info.is_file and info.path.endswith(self.suffix):
                with self.system.open_input_file(info.path) as file:
                    head = file.read_at(min(HEAD, info.size), 0)
                    found[info.path] = [self._whole_lines(file, info.size), len(head), hashlib.sha1(head).hexdigest()]
        return found

    def _whole_lines(self, file, size: int) -> int:
        """Bytes up to the last line feed."""
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, (upto, _, _) in sorted(end.items()):
            at, known, print_ = start.get(name, (0, 0, hashlib.sha1(b"").hexdigest()))
            with self.system.open_input_file(name) as file:
                if hashlib.sha1(file.read_at(known, 0)).hexdigest() != print_ or upto < at:
                    at = 0  # another file under this name
            out += [Range(name, a, min(upto, a + self.range)) for a in range(at, upto, self.range)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        """Lines that begin in the range; the first byte after the line feed before it begins a line."""
        with self.system.open_input_file(part.name) as file:
            size, at = file.size(), part.start
            if at and file.read_at(1, at - 1) != b"\n":
                at = self._next_line(file, at, size)
            while at < part.end:
                upto = self._next_line(file, max(at, min(part.end, at + BLOCK) - 1), size)
                data = file.read_at(upto - at, at)
                for line in data.split(b"\n")[:-1]:
                    yield part.name, at, line.removesuffix(b"\r").decode("utf-8", "replace")
                    at += len(line) + 1
                    if at >= part.end:
                        return
                at = upto

    def _next_line(self, file, at: int, size: int) -> int:
        while at < size:
            found = file.read_at(min(BLOCK, size - at), at).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += BLOCK
        return size


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def tail_logs(spark: SparkSession, path: str, suffix: str = ".log", range_bytes: int = RANGE) -> DataFrame:
    """file, offset and line of every whole line of the files under ``path`` (a URI), as they grow."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("log_tail").option("suffix", suffix).option("range", str(range_bytes)).load(path)


def visits(lines: DataFrame) -> DataFrame:
    """ts, month, address, page and status of lines ``2001-05-06T07:08:09 address page status``; other lines are left out."""
    part = lambda n: F.regexp_extract("line", r"^(\S+) (\S+) (\S+) (\d{3})$", n)
    rows = lines.select(part(1).try_cast("timestamp").alias("ts"), part(2).alias("address"), part(3).alias("page"), part(4).try_cast("int").alias("status")).filter("ts is not null")
    return rows.select("ts", F.date_format("ts", "yyyy-MM").alias("month"), "address", "page", "status")
