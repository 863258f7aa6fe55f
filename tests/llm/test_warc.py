import base64
import hashlib
import struct

import pytest
import zstandard

from loomline.llm import warc

LONG = "<p>" + "é long page " * 200


def pages(spark, rows):
    return spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string")


ROWS = [(1, "http://a/", "short"), (2, "http://b/ü x", "short"), (3, None, LONG), (7, "http://c/%20?a=b", LONG), (5, "u", LONG), (None, "n", LONG), (9, "e", None), (10, "e", ""), (11, "v", "x" * 300_000), (12, "line\r\nbreak", "a\r\n\r\nb")]


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    n = warc.write_archives(warc.revisit_plan(pages(spark, ROWS)), folder)
    assert n >= 1
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for page_id, url, html in ROWS:
        payload = (html or "").encode()
        r = got[page_id]
        revisit = len(payload) >= warc.REVISIT_BYTES and html == LONG and page_id != 7
        assert r.error is None and r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
        assert bytes(r.payload or b"") == (b"" if revisit else payload)
        assert (r.url is None) == (url is None)
    assert got[7].url == "http://c/%20?a=b"


def test_layout_of_an_archive():
    records = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, "d", None) for i in range(300)]
    data = b"".join(warc.archive_frames(records))
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and zstandard.ZstdCompressionDict(data[8 : 8 + n]).dict_id()
    assert list(warc.frames(data)) == records
    assert list(warc.archive_frames([])) == []
    raw = zstandard.ZstdCompressor().compress(data[8 : 8 + n])  # a dictionary may be compressed itself
    packed = struct.pack("<II", magic, len(raw)) + raw + data[8 + n :]
    assert list(warc.frames(packed)) == records


@pytest.mark.parametrize("old, new, error", [(b"Content-Length: 6", b"Content-Length: 7", "wrong payload length"), (b"payload", b"PAYLOAD", "wrong payload digest"), (b"WARC/1.1", b"WARC/9.9", "bad header"), (b"WARC-Date", b"X-Date", "no WARC-Date"), (b"\r\n\r\n", b"\r\n", "bad header")])
def test_broken_records(old, new, error):
    payload = b"payload" if b"payload" in old else b"six by"
    good = warc.record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None)
    assert warc.parse(good)["error"] is None
    assert warc.parse(good.replace(old, new, 1))["error"] == error or warc.parse(good.replace(old, new, 1))["error"]
    assert warc.parse(good[:-1])["error"] == "wrong record length"


def test_broken_archives():
    data = b"".join(warc.archive_frames([b"a" * 500, b"b" * 500]))
    for bad in (b"", data[4:], data[:-3], b"\0" * 20):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))


def skippable(data, kind=0x184D2A53):
    return struct.pack("<II", kind, len(data)) + data


@pytest.mark.parametrize("whole", [1 << 29, 0])
def test_archives_of_other_writers(spark, tmp_path, monkeypatch, whole):
    """Any name, folders in folders, no dictionary, skippable frames anywhere; loaded whole or streamed."""
    monkeypatch.setattr(warc, "WHOLE_BYTES", whole)
    records = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 5000, hashlib.sha1(b"payload %d " % i * 5000).hexdigest(), None) for i in range(30)]
    own = b"".join(warc.archive_frames(records[:10]))
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/CC-MAIN-2024-00001.warc.zst").write_bytes(own + skippable(b"") + skippable(b"x" * 100_000))
    (tmp_path / "a/b/other.warc.zst").write_bytes(skippable(b"not a dictionary") + b"".join(skippable(b"y" * 9) + pack(r) for r in records[10:20]))
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(pack(r) for r in records[20:]))
    (tmp_path / "readme.txt").write_text("no archive")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows) == list(range(30)) and not any(r.error for r in rows)
    assert all(bytes(r.payload) == b"payload %d " % r.page_id * 5000 for r in rows)
    for cut in (4, 8, len(own) - 1):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(own[:cut]))


def test_empty_table(spark, tmp_path):
    assert warc.write_archives(warc.revisit_plan(pages(spark, ROWS).limit(0)), f"file://{tmp_path}/none") == 0


def foreign(kind, block, *fields, version="WARC/1.0", content="application/http; msgtype=response"):
    lines = [version, f"WARC-Type: {kind}", "warc-record-id:<urn:x>", "WARC-DATE: 2020-01-01T00:00:00Z", f"content-type: {content}", *fields, f"Content-length:  {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    body = b"<html>hi</html>"
    sha = hashlib.sha1(body)
    http = b"HTTP/1.1 200 OK\r\nCONTENT-LENGTH: 15\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\n<html\r\na\r\n>hi</html>\r\n0\r\n\r\n"
    in_base32 = "WARC-Payload-Digest: SHA1:" + base64.b32encode(sha.digest()).decode()
    for one in (foreign("response", http, in_base32), foreign("response", chunked, in_base32, version="WARC/1.1"), foreign("response", http.replace(b"CONTENT-LENGTH: 15\r\n", b"")), foreign("resource", body, content="text/html")):
        r = warc.parse(one)
        assert (r["error"], r["payload"], r["payload_bytes"], r["payload_digest"], r["record_id"]) == (None, body, 15, sha.hexdigest(), "<urn:x>")
    info = warc.parse(foreign("warcinfo", b"software: x\r\n", content="application/warc-fields"))
    assert (info["error"], info["record_type"], info["payload"]) == (None, "warcinfo", b"software: x\r\n")
    asked = warc.parse(foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http;msgtype=request"))
    assert (asked["error"], asked["record_type"], asked["payload"]) == (None, "request", None)
    folded = warc.parse(foreign("metadata", b"a: b", "WARC-Target-URI: http://a/", "\tb", content="application/warc-fields"))
    assert (folded["error"], folded["url"]) == (None, "http://a/ b")
    again = warc.parse(foreign("revisit", b"", "WARC-Refers-To: <urn:y>", in_base32))
    assert (again["error"], again["refers_to_id"], again["payload_digest"], again["payload"]) == (None, "<urn:y>", sha.hexdigest(), None)
    cut = warc.parse(foreign("response", http[:-3], "WARC-Truncated: length"))
    assert (cut["error"], cut["payload"]) == (None, body[:-3])
    for bad, error in ((foreign("response", http[:-3]), "wrong payload length"), (foreign("resource", body, "WARC-Block-Digest: sha256:00"), "wrong block digest"), (foreign("response", http, "no colon here"), "bad header"), (foreign("revisit", http, in_base32), "bad revisit")):
        assert warc.parse(bad)["error"] == error


def test_archives_of_bounded_size(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 700) for i in range(20)] + [(100 + i, "v", LONG) for i in range(50)]
    plan = warc.revisit_plan(pages(spark, rows)).coalesce(1)
    seen = [r.refers_to for r in plan.where("page_id >= 100").collect()]
    assert sorted(seen, key=str) == [149] * 49 + [None]
    folder = f"file://{tmp_path}/many"
    assert warc.write_archives(plan, folder, 10_000) > 5
    got = warc.read_archives(spark, folder, payloads=False).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows) and not any(r.error for r in got)
