import base64
import hashlib
from datetime import datetime

import pytest

from imgaudit.llm import warc as op


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, payload string, first int")


def brute_force(rows):
    firsts = {}
    for i, _, html in rows:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    out = []
    for i, url, html in rows:
        first = firsts.get(html or "")
        revisit = first is not None and first != i
        out.append((i, len((html or "").encode()), digest(html),
                    "revisit" if revisit else "response", first if revisit else None, url))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [
    [],
    [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/", None), (4, "http://d/", "")],
    [(5, "http://a/", "x"), (5, "http://a/", "x"), (None, "u\r\nInjected: 1", "x"), (None, "n", "only")],
    [(1, "http://é/", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (2, "u", "w" * 3_000_000)],
    [(i, f"http://h/{i}", "hot page" if i % 3 else f"<p>{i}</p>" * 20) for i in range(400)],
])
def test_round_trip(spark, rows):
    found = op.archive_round_trip(pages(spark, rows)).collect()
    plain = [(i, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, h) for i, u, h in rows]
    assert sorted([tuple(r)[:6] for r in found], key=repr) == brute_force(plain)
    bodies = {(r.page_id, (h or "").encode()) for r in found for i, _, h in rows
              if r.record_type == "response" and r.page_id == i and r.payload_digest == digest(h)}
    assert {(r.page_id, bytes(r.payload)) for r in found if r.record_type == "response"} == bodies


def test_small_payloads_are_never_revisits(spark):
    found = op.archive_round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]), min_bytes=3)
    assert [r.record_type for r in found.collect()] == ["response"] * 2


def test_archive_layout():
    """The dictionary leads, and each record is a frame that needs nothing but it."""
    import zstandard

    records = [op.format_record(i, f"http://h/{i}", b"<html>shared boilerplate</html>" * 4, None)
               for i in range(300)]
    archive = op.pack_archive(records)
    assert int.from_bytes(archive[:4], "little") == 0x184D2A5D
    size = int.from_bytes(archive[4:8], "little")
    trained = zstandard.ZstdCompressionDict(archive[8:8 + size])
    last = zstandard.ZstdCompressor(level=3, dict_data=trained).compress(records[-1])
    assert archive.endswith(last)
    assert list(op.unpack_archive(archive)) == records


def test_all_pages(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in small("pages").collect()]
    found = op.archive_round_trip(small("pages")).collect()
    assert sorted([tuple(r)[:6] for r in found], key=repr) == brute_force(rows)


def read_standard(data):
    """Records by the standard alone: version, named fields, block by its length, two line ends."""
    records = []
    while data:
        line, data = data.split(b"\r\n", 1)
        assert line == b"WARC/1.1"
        fields = {}
        while True:
            line, data = data.split(b"\r\n", 1)
            if not line:
                break
            name, value = line.decode().split(":", 1)
            assert name.lower() not in fields
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block, data = data[:size], data[size:]
        assert data[:4] == b"\r\n\r\n"
        data = data[4:]
        for name in ("warc-record-id", "warc-date", "warc-type"):  # mandatory, besides the length
            assert fields[name]
        datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ")
        assert fields["warc-record-id"].startswith("<") and fields["warc-record-id"].endswith(">")
        payload = None
        if fields["warc-type"] == "revisit":
            assert "revisit" in fields["warc-profile"] and block == b"" and fields["warc-refers-to"]
        else:
            assert fields["content-type"].startswith("application/http")
            status, rest = block.split(b"\r\n", 1)
            assert status.startswith(b"HTTP/1.1 200")
            head, payload = rest.split(b"\r\n\r\n", 1)
            http = dict(h.decode().split(": ") for h in head.split(b"\r\n"))
            assert int(http["Content-Length"]) == len(payload)
            sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert fields["warc-payload-digest"] == f"sha1:{sha}"
        records.append((fields, payload))
    return records


def test_archives_follow_the_standard(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "u\r\nX: 1", None), (4, "http://d/", "\r\n\r\né"), (5, "x", "")]
    manifest = op.write_archives(op.decided(pages(spark, rows)), str(tmp_path / "w"))
    data = b"".join(b"".join(op.unpack_archive((tmp_path / "w" / r.name).read_bytes())) for r in manifest.collect())
    found = {f["warc-record-id"]: (f, p) for f, p in read_standard(data)}
    assert len(found) == 5
    assert {i: found[f"<urn:page:{i}>"][1] for i in range(1, 6)} == {
        1: b"same", 2: None, 3: b"", 4: "\r\n\r\né".encode(), 5: None}
    assert found["<urn:page:2>"][0]["warc-refers-to"] == "<urn:page:1>"
