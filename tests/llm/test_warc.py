import base64
import gzip
import hashlib

from tessera.llm import warc
from tests.llm.helpers import table


def check(pages, min_bytes=0):
    rows = pages.select("page_id", "html").collect()
    first: dict = {}
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= min_bytes and r.page_id is not None:
            first[data] = min(first.get(data, r.page_id), r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        again = data in first and first[data] != r.page_id
        want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    assert sorted((tuple(r) for r in warc.round_trip(pages, min_bytes).collect()), key=str) == sorted(want, key=str)


def test_round_trip(spark):
    check(table(spark, "pages"))


def odd_pages(spark):
    rows = [(1, "http://a/ü", "x"), (2, None, None), (3, "http://b", ""), (4, "u\r\nX: y", "x"), (4, "u", "x"), (5, "", "A" * 3_000_000), (6, "", "\x1f\x8b\x08WARC/1.1\r\n\r\n"), (None, "n", "only"), (None, "n", "x"), (7, "é", "\n".join(str(i * i) for i in range(200_000)))]
    return spark.createDataFrame([(*r, 1, b"p") for r in rows], "page_id long, url string, html string, digest int, payload binary")


def test_odd_pages(spark):
    check(odd_pages(spark))
    check(odd_pages(spark), 5)
    assert warc.round_trip(odd_pages(spark).limit(0)).collect() == []


def test_any_range_size_gives_the_same_records(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(odd_pages(spark).coalesce(2), path)
    whole = warc.read_warc(spark, path)
    want = sorted((tuple(r) for r in whole.drop("path").collect()), key=str)
    assert len(want) == odd_pages(spark).count()
    for size in (997, 4096, 1 << 16):
        assert sorted((tuple(r) for r in warc.read_warc(spark, path, size).drop("path").collect()), key=str) == want


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write_warc(table(spark, "pages").coalesce(1), f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\nWARC-Type:") >= table(spark, "pages").count()


def test_records_of_other_writers(spark, tmp_path):
    def record(kind, block, **fields):
        head = [f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
        return gzip.compress("\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    data = [
        record("warcinfo", b"software: other", WARC_Record_ID="<urn:uuid:1>", Content_Length=15), record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Length=18),
        record("response", http, WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=response", Content_Length=len(http)),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:2>"), record("metadata", b"k: v"), record("response", b"dns text", Content_Type="text/dns", Content_Length=8),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/other.warc.gz").write_bytes(b"".join(data))
    for size in (64, 1 << 20):
        rows = warc.read_warc(spark, f"file://{tmp_path}/w", size).orderBy("offset").collect()
        assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "revisit", "metadata", "response"]
        assert [r.payload_bytes for r in rows] == [15, 18, 9, None, 4, 8] and rows[2].payload == b"<p>hi</p>" and rows[3].payload_digest is None
        assert rows[2].record_id == "<urn:uuid:2>" == rows[3].refers_to_record and all(r.page_id is None for r in rows)


def test_all_long_ids(spark):
    ends = [-(1 << 63), -(10**18), 10**18, 1234567890123456789, 1234567890123456790, (1 << 63) - 1]
    check(spark.createDataFrame([(i, f"http://a/{i}", "same" if n % 2 else "<p>") for n, i in enumerate(ends)], "page_id long, url string, html string"))
    foreign = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:9223372036854775808>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert warc.parse_record(foreign)[0] is None
