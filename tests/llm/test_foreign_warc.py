"""Archives that other writers made."""

import io
import zlib

from quillon.llm import warc


def member(kind, block=b"", **fields):
    head = [("WARC-Type", kind), *((k.replace("_", "-"), v) for k, v in fields.items()), ("Content-Length", str(len(block)))]
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    return gz.compress(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + gz.flush()


HTTP = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"


def test_records_of_all_types(spark, tmp_path):
    sha = warc.digest32(b"page")
    parts = [
        member("warcinfo", b"software: x", WARC_Record_ID="<urn:uuid:0>"),
        member("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/http; msgtype=request"),
        member("response", HTTP + b"page", WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://h/", Content_Type="application/http;msgtype=response"),
        member("response", HTTP + b"hurt", WARC_Record_ID="<urn:uuid:3>", WARC_Payload_Digest=f"sha1:{sha}"),
        member("response", HTTP + b"hex", WARC_Record_ID="<urn:uuid:4>", WARC_Payload_Digest="SHA1:" + __import__("hashlib").sha1(b"hex").hexdigest()),
        b"\x1f\x8b\x08damaged" + b"\x1f\x8b\x08",
        zlib.compressobj(9, zlib.DEFLATED, 31).flush(),
        member("revisit", HTTP, WARC_Record_ID="<urn:uuid:5>", WARC_Refers_To="<urn:uuid:2>"),
        member("revisit", HTTP, WARC_Payload_Digest=f"sha1:{sha.lower()}"),
        member("revisit", HTTP, WARC_Refers_To="<urn:uuid:none>"),
        member("metadata", b"via: z", WARC_Payload_Digest="md5:abc"),
    ]
    data = b"".join(parts)
    want = [
        (None, None, 11, "warcinfo", "<urn:uuid:0>", None), (None, None, 0, "request", "<urn:uuid:1>", None), (None, "http://h/", 4, "response", "<urn:uuid:2>", None), (None, None, 4, "response", "<urn:uuid:3>", False), (None, None, 3, "response", "<urn:uuid:4>", True),
        (None, None, None, "revisit", "<urn:uuid:5>", None), (None, None, None, "revisit", None, None), (None, None, None, "revisit", None, None), (None, None, 6, "metadata", None, None),
    ]
    for split in (1, 7, 100, 10_000):
        rows = [warc.row_of(h, b) for s in range(0, len(data), split) for _, h, b in warc.records(io.BytesIO(data), len(data), s, min(len(data), s + split))]
        assert [(r[0], r[1], r[2], r[4], r[6], r[8]) for r in rows] == want
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    archives = spark.createDataFrame([(f"file://{path}", len(data)), (f"file://{path}", 0)], "path string, bytes long")
    got = [(r.payload_bytes, r.payload_digest) for r in warc.resolved(warc.read(spark, archives, 50)).where("record_type = 'revisit'").collect()]
    assert sorted(got, key=str) == sorted([(4, sha), (4, sha), (None, None)], key=str)
