"""Quoted CSV in parallel: byte ranges whose place inside or outside quotes is known from counts of quotes.

A line feed ends a record only outside quotes, and whether a byte stands in quotes depends on all before it. So quotes are
counted by range first; the running parity of these counts, a few bytes for each range, tells every range how it
begins. Then each range finds the first record that begins in it and reads on to the end of its last one, past
its own end. A doubled quote inside a cell turns the parity twice, which changes nothing.

For encodings in which quotes, line feeds and delimiters are single bytes that occur in no other letter (UTF-8,
Windows and ISO code pages). Files that quote by other rules than RFC 4180 (a quote inside an unquoted cell, backslashes) need ``tables.read_csv``.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and what is read at a time where a record goes on past it.
RANGE, BLOCK = 32 << 20, 1 << 20
QUOTE, LINE = ord('"'), ord("\n")


def _open(path: str):
    system, name = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return system.open_input_file(name)


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """path, size, n, start and end of the ranges of the files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    cut = files.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))))
    return cut.select("path", "size", "n", (F.col("n") * range_bytes).alias("start"), F.least("size", (F.col("n") + 1) * range_bytes).alias("end"))


def with_parity(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``quoted``: whether the first byte stands inside quotes that opened before."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes = []
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                with _open(path) as file:
                    quotes.append(sum(file.read_at(min(BLOCK, end - at), at).count(b'"') for at in range(start, end, BLOCK)))
            yield batch.append_column("quotes", pa.array(quotes, pa.int64()))

    kinds = "path string, size long, n long, start long, end long"
    slots = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = ranges.repartition(slots, "path", "n").mapInArrow(count, f"{kinds}, quotes long")
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("path", "size", "n", "start", "end", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("quoted"))


def record_ends(data: bytes, quoted: bool) -> np.ndarray:
    """Places after the line feeds of ``data`` that stand outside quotes."""
    bytes_ = np.frombuffer(data, np.uint8)
    lines = np.flatnonzero(bytes_ == LINE)
    inside = np.searchsorted(np.flatnonzero(bytes_ == QUOTE), lines) % 2 == 1
    return lines[inside == quoted] + 1


def whole_records(file, size: int, start: int, end: int, quoted: bool) -> bytes:
    """Bytes of the records that begin in [start, end); ``quoted`` is what holds at ``start``."""
    data = file.read_at(end - start, start)
    first = 0
    if start:  # a record begins here if the byte before ends one, which is outside quotes if this one is
        if quoted or file.read_at(1, start - 1) != b"\n":
            ends = record_ends(data, quoted)
            if not len(ends) or ends[0] == len(data):
                return b""
            first = int(ends[0])
    inside = quoted ^ (data.count(b'"') % 2 == 1)
    if end < size and (inside or not data.endswith(b"\n")):  # the last record goes on
        at, parts = end, [data]
        while at < size:
            more = file.read_at(min(BLOCK, size - at), at)
            ends = record_ends(more, inside)
            if len(ends):
                parts.append(more[: int(ends[0])])
                break
            parts.append(more)
            inside ^= more.count(b'"') % 2 == 1
            at += len(more)
        data = b"".join(parts)
    return data[first:]


def cells_of(text: str, delimiter: str) -> Iterator[list[str | None]]:
    """Cells of each record; empty ones, with quotes or without, are null; lines without anything are left out."""
    yield from ([c or None for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if row)


def read_quoted_csv(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "utf-8", range_bytes: int = RANGE, limit: int | None = None) -> DataFrame:
    """All columns as text, named by the first record of the first file (by path); the first record of every file is a header.

    Short records are filled with nulls, cells past the header are left out; a byte order mark goes. ``limit``: the first so many
    records of each file, in order, without reading the rest. The rows do not depend on ``range_bytes``.
    """
    csv.field_size_limit(1 << 31)
    ranges = byte_ranges(spark, path, range_bytes)
    first = ranges.orderBy("path", "n").first()
    if first is None:
        return spark.createDataFrame([], "value string").select()
    names: list[str] = []
    with _open(first.path) as file:
        reach = min(first.size, BLOCK)
        while True:
            head = file.read_at(reach, 0)
            ends = record_ends(head, False)
            if len(ends) or reach >= first.size:
                break
            reach = min(first.size, 2 * reach)
        head = head[: int(ends[0])] if len(ends) else head
        names = [c or f"_c{i}" for i, c in enumerate(next(cells_of(head.removeprefix(b"\xef\xbb\xbf").decode(encoding), delimiter), []))]
    schema = pa.schema([(n, pa.string()) for n in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for batch in batches:
            for file_path, size, n, start, end, quoted in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "n", "start", "end", "quoted")), strict=True):
                with _open(file_path) as file:
                    data = whole_records(file, size, start, end, quoted)
                rows: list[list[str | None]] = []
                skip, taken = n == 0, 0
                for row in cells_of((data.removeprefix(b"\xef\xbb\xbf") if n == 0 else data).decode(encoding, "replace"), delimiter):
                    if skip:
                        skip = False
                        continue
                    rows.append((row + [None] * len(names))[: len(names)])
                    taken += 1
                    if taken == limit:
                        break
                    if len(rows) == 4096:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    if limit is not None:
        ranges = ranges.filter("n = 0").withColumn("end", F.col("size"))
        return ranges.withColumn("quoted", F.lit(False)).repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(parse, ", ".join(f"`{c}` string" for c in names))
    known = with_parity(ranges)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return known.repartition(slots, "path", "n").mapInArrow(parse, ", ".join(f"`{c}` string" for c in names))


def _batch(rows: list[list[str | None]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
