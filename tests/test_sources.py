"""Sources: files sniffed, read in any form, released, compared and exported."""

import hashlib

import pytest

from tessera.sources import profile, tables


def test_files_are_told_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("название;число\nКурск;1,5\nОрёл;2\n".encode("cp1251"))
    (tmp_path / "b.csv").write_bytes("a,b\n1,\"x, y\"\n".encode("utf-8-sig"))
    (tmp_path / "c.html").write_bytes(b"<!DOCTYPE html><table><tr><td>1</td></tr></table>")
    (tmp_path / "d.parquet").write_bytes(b"PAR1....PAR1")
    (tmp_path / "e.txt").write_bytes("a\tb\n1\t2\n".encode("utf-16"))
    (tmp_path / "g.zip").write_bytes(b"PK\x03\x04...")
    rows = {r.path.rpartition("/")[2]: r for r in tables.inspect_files(spark, str(tmp_path)).collect()}
    assert [rows[n].kind for n in sorted(rows)] == ["csv", "csv", "html", "parquet", "csv", "zip"]
    assert (rows["a.csv"].encoding, rows["a.csv"].delimiter) == ("cp1251", ";")
    assert (rows["b.csv"].encoding, rows["b.csv"].delimiter) == ("utf-8-sig", ",")
    assert rows["e.txt"].encoding == "utf-16" and rows["e.txt"].delimiter == "\t"
    for name, row in rows.items():
        assert row.sha256 == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()


def test_refused_files_and_kinds_of_archives(spark, tmp_path):
    """Each kind by its content, whatever the name, and the reason where a file is not read."""
    import io
    import zipfile

    def archive(*names, mimetype=b"", locked=False):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as bundle:
            if mimetype:
                bundle.writestr("mimetype", mimetype)
            for name in names:
                bundle.writestr(name, b"x" * 3000)
        data = bytearray(out.getvalue())
        if locked:  # the flag of encryption in the list of members
            data[data.index(b"PK\x01\x02") + 8] |= 1
        return bytes(data)

    ole, wide = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", lambda name: b"\1" * 9000 + name.encode("utf-16-le")
    cases = {
        "book": (archive("xl/workbook.xml", "a"), "xlsx", None),
        "sheet": (archive("content.xml", mimetype=b"application/vnd.oasis.opendocument.spreadsheet"), "ods", None),
        "letter": (archive("content.xml", mimetype=b"application/vnd.oasis.opendocument.text"), "word", "word"),
        "document": (archive("word/document.xml"), "docx", None),
        "slides": (archive("ppt/presentation.xml"), "slides", "binary"),
        "files": (archive("a.csv", "b.csv"), "zip", None),
        "locked": (archive("a.csv", locked=True), "zip", "password"),
        "long": (archive(*[f"{i}.csv" for i in range(500)]), "zip", None),
        "torn": (archive("a.csv")[:-30], "zip", "damaged"),
        "old": (ole + wide("Workbook\0"), "xls", None),
        "old-with-letter": (ole + wide("WordDocument") + wide("Book\0"), "xls", None),
        "old-letter": (ole + wide("WordDocument"), "word", "word"),
        "old-locked": (ole + wide("EncryptedPackage"), "xls", "password"),
        "picture": (b"\x89PNG\r\n", "image", "image"),
        "packed": (b"Rar!\x1a", "rar", "rar"),
        "rich": (b"{\\rtf1", "word", "word"),
        "gz": (b"\x1f\x8b\x08", "gzip", "gzip"),
        "bytes": (b"a,b\n\0\0\0,\1", "binary", "binary"),
        "wide": ("a;b\n1;2\n".encode("utf-16-le"), "csv", None),
    }
    for name, (data, *_) in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    rows = tables.inspect_files(spark, str(tmp_path)).collect()
    assert {r.path.rpartition("/")[2].removesuffix(".csv"): (r.kind, r.refused) for r in rows} == {n: (k, why) for n, (_, k, why) in cases.items()}


@pytest.mark.parametrize(("head", "name"), [(b"\xff\xfea\0", "utf-16"), (b"a\0b\0c\0", "utf-16-le"), (b"\0a\0b\0c", "utf-16-be"), ("aé".encode()[:-1], "utf-8"), ("Яблоко".encode("cp1251"), "cp1251")])
def test_encodings(head, name):
    assert tables.detect_encoding(head) == name


def test_csv_is_read_as_text_and_written_back(spark, tmp_path):
    (tmp_path / "in.csv").write_text('place;note;v\nA;"two\nlines; one cell";=1\nB;-x\n')
    rows = tables.read_csv(spark, str(tmp_path / "in.csv")).collect()
    assert [tuple(r) for r in rows] == [("A", "two\nlines; one cell", "=1"), ("B", "-x", None)]
    tables.export_csv(tables.read_csv(spark, str(tmp_path / "in.csv")), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True).collect()
    assert [r.v for r in back] == ["'=1", None] and back[1].note == "'-x"


def test_rows_of_any_kind(spark, tmp_path):
    (tmp_path / "p.html").write_text("<table><tr><td>a</td><td>1</td></tr></table>")
    spark.createDataFrame([("a", 1)], "x string, y int").write.parquet(str(tmp_path / "p"))
    (tmp_path / "p.csv").write_text("x;y\na;1\n")
    for name, kind in (("p.html", "html"), ("p", "parquet"), ("p.csv", "csv")):
        assert [r.cells for r in tables.read_any(spark, str(tmp_path / name), kind).collect()] == [["a", "1"]]


def test_releases_are_kept_with_their_description(spark, tmp_path):
    rows = spark.createDataFrame([("m", "N1", "annual", 2000, 0, 1.0), ("m", "N1", "annual", 2001, 0, None)], "measure string, territory_code string, period_kind string, year int, period int, value double")
    for year, path in (("2002", "b"), ("2001", "a")):
        tables.write_release(rows, str(tmp_path / path), {"source": "s", "reference_year": year, "published_on": f"{year}-05-01"})
    back, info = tables.read_release(spark, str(tmp_path / "a"))
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str) and info.first().reference_year == "2001"
    assert [r.reference_year for r in tables.releases(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).collect()] == ["2001", "2002"]
    changed = rows.replace(1.0, 2.0)
    assert [tuple(r) for r in tables.changes_since(changed, rows).select("measure", "common", "changed").collect()] == [("m", 1, 1)]


def test_type_families():
    assert profile.types_compatible("int", "bigint") and profile.types_compatible("float", "double")
    assert not profile.types_compatible("int", "double") and not profile.types_compatible("array<int>", "array<long>")


def messy_csv(rows: int, seed: int) -> str:
    """Quoted delimiters, quotes and line feeds in cells, empty cells of both kinds, blank lines, short and long records."""
    import random

    draw = random.Random(seed)
    cells = ("a", "12,5", "", '""', '"x;y"', '"say ""hi"""', '"two\nlines"', '"\n\n"', "é…", '"long ' + "word " * 30 + '"', '""""', '";"')
    lines = ["place;year;a value;note"]
    for i in range(rows):
        n = draw.choice((4, 4, 4, 2, 5))
        lines.append(";".join([str(i), *(draw.choice(cells) for _ in range(n - 1))]))
        if draw.random() < 0.1:
            lines.append("")
    return "\n".join(lines) + draw.choice(("", "\n"))


def test_quoted_csv_in_ranges_equals_the_plain_reader(spark, tmp_path):
    from tessera.sources import quoted

    for name, seed in (("a.csv", 1), ("b.csv", 2), ("c.csv", 3)):
        (tmp_path / name).write_text(messy_csv(150, seed))
    (tmp_path / "d.csv").write_bytes(b"\xef\xbb\xbf" + b"place;year;a value;note\r\n7;\"x\r\ny\";z;\r\n")
    key = lambda r: tuple("" if v is None else "=" + v for v in r)
    plain = sorted(map(key, spark.read.csv([f"{tmp_path}/{n}.csv" for n in "abc"], header=True, sep=";", multiLine=True, escape='"', mode="PERMISSIVE").collect()))
    for size in (1 << 20, 1000, 137, 16):
        frame = quoted.read_quoted_csv(spark, f"{tmp_path}/[abc].csv", range_bytes=size)
        assert frame.columns == ["place", "year", "a value", "note"]
        assert sorted(map(key, frame.collect())) == plain
        if size == 137:
            assert quoted.byte_ranges(spark, f"{tmp_path}/a.csv", size).count() > 20  # a file is many tasks
    last = quoted.read_quoted_csv(spark, f"{tmp_path}/d.csv", range_bytes=9).collect()
    assert [tuple(r) for r in last] == [("7", "x\r\ny", "z", None)]
    assert quoted.read_quoted_csv(spark, f"{tmp_path}/[abc].csv", limit=5).count() == 15


def test_records_of_any_range():
    from tessera.sources import quoted

    data = messy_csv(60, 5).encode()
    for size in (1, 7, 50, len(data)):
        got = b"".join(quoted.whole_records(io_file(data), len(data), a, min(len(data), a + size), data[:a].count(b'"') % 2 == 1) for a in range(0, len(data), size))
        assert got == data


class io_file:
    """Bytes that are read by place."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]
