import hashlib

import pytest

from lectern.llm import warc

LONG = "<p>é</p>" * 40


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/1", LONG), (3, "http://a/2 b\nc", LONG), (9, None, LONG), (1, "u", "short"), (2, "u", "short"), (7, "x", None), (8, "", ""), (4, "http://b", "x" * 100), (6, "http://b", "x" * 100), (6, "http://b", "x" * 100), (10, "h", "a\r\n\r\nb" * 20_000)]
    return spark.createDataFrame([(i, u, h, "?") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_round_trip(pages):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    html = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    for i, data in html:
        first = min(j for j, other in html if other == data)
        again = len(data) >= 100 and first != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)


def test_small_files(pages, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 2)
    assert warc.round_trip(pages).count() == 11


def test_empty_table(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    data = warc.arc_head(version, "f.arc") + b"\n" + warc.arc_record(7, "http://a/b", "<p>", version, "f.arc") + b"\n" + warc.arc_record(None, "dns:a.b", "1.2.3.4", version, "f.arc") + b"\n"
    head, page, dns = warc.parse_arc(data)
    assert head[0]["url"].startswith("filedesc:") and page[0]["url"] == "http://a/b" and page[0]["date"] == "19700101000007" and page[0]["type"] == "text/html"
    assert warc.head_and_payload(page[1])[1] == b"<p>" and dns[0]["url"] == "dns:a.b"
    broken = list(warc.parse_arc(data[:-20]))
    assert len(broken) == 3 and "missing" in broken[2][0]["error"]
    assert "error" in list(warc.parse_arc(b"junk\n"))[0][0]


def test_converted_records(spark, pages, tmp_path):
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(pages.where("page_id IN (3, 5)"), arc, "1")
    warc.convert(spark, arc, out)
    text = b"".join(warc.inflated(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*")).decode()
    assert text.count("WARC-Type: response") == 1 and text.count("WARC-Type: revisit") == 1 and "WARC-Date: 1970-01-01T00:00:03Z" in text and "WARC-Target-URI: http://a/2%20b%0Ac" in text
    records = [h for h, _ in warc.parse_warc(text.encode())]
    assert all("error" not in h for h in records) and len({h["warc-record-id"] for h in records if h["warc-type"] != "warcinfo"}) == 2


def test_binary_payloads_survive(spark, tmp_path):
    content = b"HTTP/1.0 200 OK\r\nX-Page-Id: 1\r\n\r\n" + bytes(range(256)) * 4
    (tmp_path / "a.arc").write_bytes(warc.arc_head("1", "a") + f"\nhttp://a 1.1.1.1 20010203040506 image/png {len(content)}\n".encode() + content + b"\n")
    warc.convert(spark, str(tmp_path / "a.arc"), str(tmp_path / "w"))
    row = warc.read_warc(spark, str(tmp_path / "w")).first()
    assert row.error is None and row.payload_bytes == 1024 and row.payload_digest == hashlib.sha256(bytes(range(256)) * 4).hexdigest() and row.date == "2001-02-03T04:05:06Z"
