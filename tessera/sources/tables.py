"""Tables of files: sniffing, CSV in any encoding, HTML tables, releases with metadata, exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: First bytes of file kinds.
MAGIC = ((b"PAR1", "parquet"), (b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0", "xls"), (b"\x1f\x8b", "gzip"), (b"PK\x05\x06", "zip"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"Rar!", "rar"), (b"7z\xbc\xaf\x27\x1c", "rar"), (b"{\\rtf", "word"))
#: Kinds that are not read, by the reason given for it.
REFUSED = {"gzip": "gzip", "image": "image", "rar": "rar", "word": "word", "slides": "binary", "binary": "binary"}
#: Bytes of an archive's end in which its list of members is looked for.
ARCHIVE_END = 1 << 20
DELIMITERS = (";", "\t", ",", "|")

RELEASE_KEY = ("measure", "territory_code", "period_kind", "year", "period")


def sniff(head: bytes | None) -> str:
    """parquet, pdf, zip, xls, gzip, image, rar, word, html, csv, binary or empty, by the first bytes."""
    if not head:
        return "empty"
    for magic, kind in MAGIC:
        if head.startswith(magic):
            return kind
    if 0 in head and not looks_wide(head):
        return "binary"
    start = head[:512].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    return "html" if re.match(rb"<(!doctype html|html|table)", start) else "csv"


def looks_wide(head: bytes) -> bool:
    """UTF-16: a mark, or zeros in most bytes of one parity and hardly any of the other."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return True
    few, many = sorted(part.count(0) / max(1, len(part)) for part in (head[:2000:2], head[1:2000:2]))
    return many > 0.4 and few < 0.1


def look_into_zip(head: bytes, end: bytes) -> tuple[str, str | None]:
    """Kind of a zip (xlsx, ods, docx, slides, word or zip) by the names of its members, and why it is refused, if it is. Its list of members stands in ``end``."""
    try:
        members = zipfile.ZipFile(io.BytesIO(end)).infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return "zip", "damaged"
    names = {m.filename for m in members}
    kinds = {"xl/workbook.xml": "xlsx", "word/document.xml": "docx", "ppt/presentation.xml": "slides"}
    kind = next((k for name, k in kinds.items() if name in names), "zip")
    if kind == "zip" and "mimetype" in names:
        kind = "ods" if b"opendocument.spreadsheet" in head[:200] else "word"
    return kind, "password" if any(m.flag_bits & 1 for m in members) else REFUSED.get(kind)


def detect_encoding(head: bytes) -> str:
    """By mark, by zeros of UTF-16, by strict UTF-8 (a cut last letter is allowed), else Windows Cyrillic."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    if head[:200].count(0) > len(head[:200]) // 4:
        return "utf-16-le" if head[1:2] == b"\0" else "utf-16-be"
    for cut in range(4):
        try:
            head[: len(head) - cut].decode()
        except UnicodeDecodeError:
            continue
        return "utf-8"
    return "cp1251"


def detect_delimiter(text: str) -> str:
    """The mark that gives most lines the same number of columns; wider tables and the usual order break ties."""

    def score(mark: str) -> float:
        widths = Counter(line.count(mark) for line in text.splitlines() if line.strip())
        width, n = widths.most_common(1)[0] if widths else (0, 0)
        return (n / sum(widths.values()) + width / 1000 - DELIMITERS.index(mark) / 10000) if width else 0.0

    return max(DELIMITERS, key=score)


def inspect_files(spark: SparkSession, path: str, head: int = 4096) -> DataFrame:
    """path, length, kind, encoding, delimiter and sha256 of each file, and why it is refused (password, word, image, rar, gzip, binary, damaged) or null.

    Contents stay on the executors; Python gets their first bytes, and the end of archives. Old workbooks and
    documents are told apart by the names of their streams, anywhere in the file. Spark does not list files without a byte.
    """

    @F.pandas_udf("kind string, encoding string, delimiter string, refused string")
    def look(heads: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for h, end in zip(heads, ends, strict=True):
            kind = sniff(h)
            kind, refused = look_into_zip(h, end) if kind == "zip" else (kind, REFUSED.get(kind))
            encoding = detect_encoding(h) if h else "utf-8"
            rows.append((kind, encoding, detect_delimiter(h.decode(encoding, "replace")) if kind == "csv" else None, refused))
        return pd.DataFrame(rows, columns=["kind", "encoding", "delimiter", "refused"])

    content = F.col("content")
    stream = lambda name: F.contains(content, F.lit(name.encode("utf-16-le")))
    end = F.when(F.startswith(content, F.lit(b"PK")), F.substring(content, -ARCHIVE_END, ARCHIVE_END))
    document = stream("WordDocument") & ~stream("Workbook\0") & ~stream("Book\0")
    old = F.when(stream("EncryptedPackage"), "password").when(document, "word")
    files = spark.read.format("binaryFile").load(path)
    looked = files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(F.startswith(content, F.lit(b"\xd0\xcf\x11\xe0")), old).alias("old"), look(F.substring("content", 1, head), end).alias("l"))
    return looked.select("path", "length", "sha256", F.when(F.col("old") == "word", "word").otherwise(F.col("l.kind")).alias("kind"), "l.encoding", "l.delimiter", F.coalesce("old", "l.refused").alias("refused"))


def store_new(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not known yet, one of each content."""
    return files.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def read_csv(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; quoted newlines are part of a cell; short rows are filled with nulls."""
    return spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, multiLine=True, inferSchema=False, mode="PERMISSIVE", escape='"')


def summarise(df: DataFrame, exact: bool = False) -> DataFrame:
    """column, filled cells and distinct values (approximate unless ``exact``), in one pass."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [a for c in df.columns for a in (F.count(c).alias(f"{c}\0n"), distinct(F.col(c)).alias(f"{c}\0d"))]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}\0n`").alias("filled"), F.col(f"`{c}\0d`").alias("distinct")) for c in df.columns])).alias("c")).select("c.*")


class _Tables(HTMLParser):
    """Rows of tables with spans filled in."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.spans: dict[tuple[int, int], str] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.spans = {}
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell, size = [], dict(attrs)
            self.size = tuple(max(1, int(size.get(k) or 1)) if str(size.get(k) or 1).isdigit() else 1 for k in ("rowspan", "colspan"))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            text, row, y = " ".join("".join(self.cell).split()), self.tables[-1][-1], len(self.tables[-1]) - 1
            self._fill(row, y)
            x = len(row)
            for dy in range(self.size[0]):
                for dx in range(self.size[1]):
                    self.spans[y + dy, x + dx] = text
            self.cell = None
            self._fill(row, y)
        elif tag == "tr" and self.tables and self.tables[-1]:
            self._fill(self.tables[-1][-1], len(self.tables[-1]) - 1)

    def _fill(self, row, y):
        while (y, len(row)) in self.spans:
            row.append(self.spans[y, len(row)])


def html_rows(markup: str | None) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(markup or "")
    return parser.tables


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row and cells of every table of the pages."""

    @F.pandas_udf("array<array<array<string>>>")
    def rows(markup: pd.Series) -> pd.Series:
        return markup.map(html_rows)

    t = pages.select(key, F.posexplode(rows(F.col(html))).alias("table", "rows"))
    return t.select(key, "table", F.posexplode("rows").alias("row", "cells"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, title length, number of links and of paragraphs, by patterns."""
    return pages.select("page_id", F.length(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).cast("long").alias("title_length"), F.regexp_count("html", F.lit(r"<a href=")).cast("long").alias("links"), F.regexp_count("html", F.lit(r"<p>")).cast("long").alias("paragraphs"))


def parse_cells(cells: DataFrame, column: str) -> DataFrame:
    return cells.withColumn("kind", T.cell_kind(F.col(column))).withColumn("value", T.cell_value(F.col(column))).withColumn("below_unit", T.below_unit(F.col(column)))


def unpivot_years(wide: DataFrame, place: str, years: list[str]) -> DataFrame:
    """A sheet with years in columns to long rows; dashes and empty cells are gaps."""
    long = wide.unpivot([place], years, "year", "cell")
    return long.select(place, F.col("year").cast("long").alias("year"), T.cell_value(F.col("cell")).alias("value"), T.cell_kind(F.col("cell")).alias("kind"))


def collect_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first non-null value of each key in order, and how many different values it had."""
    w = Window.partitionBy(*key)
    first = F.row_number().over(w.orderBy(F.col("value").isNull(), order))
    conflicts = rows.groupBy(*key).agg(F.count_distinct("value").alias("values"))
    return rows.withColumn("_p", first).filter("_p = 1 and value is not null").drop("_p").join(conflicts, key)


def write_release(rows: DataFrame, path: str, info: dict[str, str]) -> None:
    """Rows as Parquet and, beside them, one row of metadata."""
    rows.write.mode("overwrite").parquet(f"{path}/data")
    rows.sparkSession.createDataFrame([tuple(info.values())], ", ".join(f"`{k}` string" for k in info)).coalesce(1).write.mode("overwrite").json(f"{path}/info")


def read_release(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/data"), spark.read.json(f"{path}/info")


def changes_since(new: DataFrame, old: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per measure: cells in both, cells that changed, and the last year of the new release."""
    key = list(RELEASE_KEY)
    both = new.select(*key, F.col("value").alias("new")).join(old.select(*key, F.col("value").alias("old")), key, "left")
    return both.groupBy("measure").agg(F.count("old").alias("common"), F.count(F.when(F.abs(F.col("new") - F.col("old")) > tolerance, 1)).alias("changed"), F.max("year").alias("last_year"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    safe = [T.safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").csv(path, header=True)


def release_links(pages: DataFrame) -> DataFrame:
    """page_id, link and place of every link of the pages, in order."""
    links = F.filter(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)), lambda l: l != "")  # noqa: E741
    return pages.select("page_id", F.posexplode(links).alias("place", "link")).select("page_id", "link", (F.col("place") + 1).cast("long").alias("place"))


def pasted_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of pasted text with their number of cells (split by tabs) and the first cell; lines of blanks are left out."""
    lines = rows.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")).alias("row", "line"))
    cells = F.split("line", "\t")
    return lines.filter(F.trim(F.col("line"), F.lit("\t ")) != "").select(key, F.col("row").cast("long").alias("row"), F.size(cells).cast("long").alias("cells"), cells[0].alias("first_cell"))


def releases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metadata of releases, a row each, in order of reference year, publication and fetching."""
    found = spark.read.json([f"{p}/info" for p in paths])
    return found.orderBy(*[c for c in ("reference_year", "published_on", "fetched_at") if c in found.columns])


def read_any(spark: SparkSession, path: str, kind: str, delimiter: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Rows of a file by its kind, as arrays of text: csv, parquet or html (all tables of the pages)."""
    if kind == "html":
        pages = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("page"), F.col("value").alias("html"))
        return html_tables(pages, "page", "html").select("cells")
    df = spark.read.parquet(path) if kind == "parquet" else read_csv(spark, path, delimiter, encoding)
    return df.select(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("cells"))
