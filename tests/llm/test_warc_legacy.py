import base64
import hashlib

import pytest

from stateloom.llm.warc_legacy import ArchiveError, arc_bytes, archive_pages, convert_arc_files, read_arc, read_warc, read_warc_files, to_warc, write_warc

SCHEMA = "page_id long, url string, html string, key string, digest string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = [
        (5, "http://a.example/x y", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "k", "d"), (3, "http://b.example/", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "k", "d"), (9, None, None, None, None),
        (8, "", "", None, None), (7, "u\n", "abc", None, None), (6, "u", "abc", None, None), (6, "u", "abc", None, None), (1, "big", "x\n" * 200_000, None, None),
    ]
    rows = archive_pages(spark.createDataFrame(pages, SCHEMA), least).collect()
    firsts = {}
    for p in pages:
        if len((p[2] or "").encode()) >= least:
            firsts[digest(p[2])] = min(p[0], firsts.get(digest(p[2]), p[0]))
    expected = []
    for p in pages:
        first = firsts.get(digest(p[2]), p[0])
        expected.append((p[0], len((p[2] or "").encode()), digest(p[2]), "response" if first == p[0] else "revisit", None if first == p[0] else first))
    assert sorted((tuple(r) for r in rows), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_warc(spark, tmp_path):
    import gzip

    write_warc(spark.createDataFrame([(1, "u", "<p>a</p>", None, None), (2, "u", "<p>a</p>", None, None)], SCHEMA), f"file://{tmp_path}/w")
    records = [r for f in tmp_path.glob("w/part-*.gz") for r in read_warc(gzip.decompress(f.read_bytes()))]
    kinds = sorted(f["WARC-Type"] for f, _ in records)
    assert kinds == ["response", "revisit"]
    by = {f["WARC-Type"]: f for f, _ in records}
    assert by["revisit"]["WARC-Refers-To"] == by["response"]["WARC-Record-ID"]
    assert all(f["WARC-Payload-Digest"] == f"sha1:{digest('<p>a</p>')}" for f in by.values())
    assert all(f["WARC-Date"] == "2000-01-01T00:00:00Z" for f in by.values())


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = arc_bytes(version, [("http://a/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\n<p>\nx"), ("http://b/", "20020101", "text/plain", b"")])
    first, second = read_arc(data)
    assert (first.url, first.date, first.mime, first.block[-3:]) == ("http://a/", "20010203040506", "text/html", b">\nx")
    assert second.block == b""
    ((fields, block),) = read_warc(to_warc(first, "1") + b"\r\n\r\n")
    assert (fields["WARC-Type"], fields["WARC-Date"]) == ("response", "2001-02-03T04:05:06Z") and block == first.block
    ((fields, _),) = read_warc(to_warc(second, "1"))
    assert fields["WARC-Type"] == "resource"
    for bad in (data[:-3], data.replace(b"filedesc", b"something"), data[:60]):
        with pytest.raises(ArchiveError):
            list(read_arc(bad))


def test_converted_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(arc_bytes(1, [("http://a/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\nabc")]))
    convert_arc_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    row = read_warc_files(spark, f"file://{tmp_path}/out").first()
    assert (row["payload_bytes"], row["payload_digest"], row["record_type"]) == (3, digest("abc"), "response")


def test_converted_bytes_and_revisits(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    image, latin = b"\x89PNG\r\n\x1a\n\r\n\r\n" + bytes(range(256)), "caf\u00e9 \u00fc".encode("latin-1")
    http = lambda payload: b"HTTP/1.0 200 OK\r\nServer: \xe9\r\n\r\n" + payload
    one = [("http://a/1", "20010203040506", "image/png", http(image)), ("http://a/2", "20010203040507", "text/html", http(latin)), ("dns:a", "20010203", "text/dns", latin)]
    two = [("http://b/1", "20020203040506", "image/png", http(image)), ("http://b/\u00e9", "20020203040507", "text/html", http(b""))]
    (tmp_path / "in" / "a.arc").write_bytes(arc_bytes(1, one))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(arc_bytes(2, two).decode("utf-8", "surrogateescape").replace("http://b/\u00e9", "http://b/\udce9").encode("utf-8", "surrogateescape")))
    convert_arc_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    found = {f["WARC-Target-URI"]: (f, b) for p in tmp_path.glob("out/part-*.gz") for f, b in read_warc(gzip.decompress(p.read_bytes()))}
    assert {u: f["WARC-Type"] for u, (f, _) in found.items()} == {"http://a/1": "response", "http://a/2": "response", "dns:a": "resource", "http://b/1": "revisit", "http://b/\u00e9": "response"}
    assert all(found[u][1] == block for u, _, _, block in one)
    assert found["http://b/1"][0]["WARC-Refers-To"] == found["http://a/1"][0]["WARC-Record-ID"]
    rows = sorted((r["payload_bytes"], r["record_type"]) for r in read_warc_files(spark, f"file://{tmp_path}/out").collect())
    assert rows == sorted([(len(image), "response"), (len(image), "revisit"), (len(latin), "response"), (len(latin), "resource"), (0, "response")])


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, block, *more, length=True):
        lines = ["WARC/1.0", f"warc-type: {kind}", *more, *([f"CONTENT-LENGTH:{len(block)}"] if length else [])]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    image = bytes(range(256))
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "part-0.warc").write_bytes(
        record("warcinfo", b"software: x\r\n")
        + record("request", b"GET / HTTP/1.1\r\n\r\n")
        + record("response", b"HTTP/1.1 200 OK\r\n\r\n" + image, "X-Note: one", " and more")
        + record("resource", image, "WARC-Payload-Digest: md5:abc")
        + record("resource", b"", "WARC-Target-URI: http://\xe9/".encode("latin-1").decode("latin-1"))
        + record("revisit", b"", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(image).digest()).decode().lower()}")
    )
    found = sorted(((r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in read_warc_files(spark, f"file://{tmp_path}/o").collect()), key=str)
    name = base64.b32encode(hashlib.sha1(image).digest()).decode()
    assert found == sorted([("resource", 0, digest("")), ("resource", 256, name), ("response", 256, name), ("revisit", None, name)], key=str)
    for wrong in (record("resource", b"abc", length=False), record("resource", b"abc", "Content-Length: three", length=False), b"WARC/1.0\r\nno field\r\n\r\n"):
        with pytest.raises(ArchiveError):
            list(read_warc(wrong))


def test_malformed_lengths_of_arc_files():
    data = arc_bytes(1, [("http://a/", "20010203040506", "text/html", b"abc")])
    with pytest.raises(ArchiveError, match="length"):
        list(read_arc(data.replace(b"text/html 3", b"text/html -3")))
    with pytest.raises(ArchiveError, match="version"):
        list(read_arc(data.replace(b"\n1 0 ", b"\nx 0 ")))
    (record,) = read_arc(arc_bytes(2, [("http://a/", "20010203040506", "text/html", b"abc")]).replace(b"text/html 200", b"text/html -"))
    assert record.status == 0
