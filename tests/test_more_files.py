"""Mail folders as a stream, marks and configuration, EXIF, kinds of files, disappearances, seals."""

from __future__ import annotations

import io
import struct
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from claimwright.extract import contracts, exif, sniff
from claimwright.operators import paths, verify
from claimwright.plans import record as r
from claimwright.queries import extraction
from claimwright.sources import archive, log, mailbox

T = "2024-03-0{}T00:00:00Z".format
A, B, C = ("a" * 64, "b" * 64, "c" * 64)


def test_mail_folder_resumes_and_starts_anew(spark, tmp_path):
    spark.dataSource.register(mailbox.MailFolderSource)
    box = tmp_path / "box"
    box.mkdir()
    for uid in (3, 1, 12):
        (box / f"{uid}.eml").write_bytes(b"m%d" % uid)
    (box / "note.txt").write_bytes(b"no mail")
    assert sorted(x.uid for x in spark.read.format("mailfolder").option("path", str(box)).load().collect()) == [1, 3, 12]

    def take():
        stream = spark.readStream.format("mailfolder").option("path", str(box)).option("perTask", "2").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((x.validity, x.uid) for x in spark.read.parquet(str(tmp_path / "out")).collect())

    assert take() == [(0, 1), (0, 3), (0, 12)]
    (box / "13.eml").write_bytes(b"new")
    assert take() == [(0, 1), (0, 3), (0, 12), (0, 13)]
    reader = mailbox._StreamReader(mailbox.Folder(str(box)), 2)
    (box / "VALIDITY").write_text("7")
    assert [p.uids for p in reader.partitions({"validity": 0, "uid": 13}, {"validity": 7, "uid": 13})] == [[1, 3], [12, 13]]


def test_marks_and_configuration():
    assert archive.Mark.read('{"generation":1,"algorithm":"sha512","depths":{"content":2,"derived":1,"claims":0}}').algorithm == "sha512"
    for bad in ("[]", '{"generation":2,"x":1}', '{"generation":1,"algorithm":"md5","depths":{}}', '{"generation":1,"algorithm":"sha256","depths":{"content":9,"derived":1,"claims":0}}'):
        with pytest.raises(ValueError):
            archive.Mark.read(bad)
    assert archive.Config.read('excludes = ["*.tmp"]\ncompress = true') == archive.Config(("*.tmp",), True, ())
    for bad in ("typo = 1", "excludes = 3", "compress = 1", 'extractors = [""]'):
        with pytest.raises(ValueError):
            archive.Config.read(bad)
    assert archive.shard("abcdef", 2) == "ab/cd/abcdef"


def tiff(lat=(48, 30, 36), ref=b"N", status=None):
    entries = [(1, 2, 2, ref + b"\0\0\0"), (2, 5, 3, None), (3, 2, 2, b"W\0\0\0"), (4, 5, 3, None)] + ([(9, 2, 2, status + b"\0\0\0")] if status else [])
    gps = 8 + 2 + 24 + 4
    data = gps + 2 + 12 * len(entries) + 4
    out = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(">HHII", 0x8825, 4, 1, gps) + struct.pack(">I", 0) + struct.pack(">H", len(entries))
    places = iter((data, data + 24))
    out += b"".join(struct.pack(">HHI", t, k, n) + (v or struct.pack(">I", next(places))) for t, k, n, v in entries) + struct.pack(">I", 0)
    return out + b"".join(struct.pack(">II", x, 1) for x in (*lat, 11, 0, 0))


def test_exif_and_positions():
    assert exif.image_exif(tiff()).facts == [("exif:orientation", 6)]
    assert exif.geo_position(tiff()).facts == [("geo:position", {"latitude": 48.51, "longitude": -11.0})]
    assert exif.geo_position(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff(ref=b"S")).facts[0][1]["latitude"] == -48.51
    assert exif.geo_position(tiff(status=b"V")).facts[0][0] == exif.geo_position(tiff(lat=(91, 0, 0))).facts[0][0] == "prov:note"
    assert exif.geo_position(b"nothing").facts == exif.image_exif(b"II*\0\xff\xff\xff\0").facts == []


def test_all_named_fields_are_found():
    row = SimpleNamespace(lat=-48.51, lon=11.0, width=4)
    assert dict(exif.image_fields(extraction._exif(row)).facts) == {
        "exif:orientation": 6, "exif:make": "Ann", "exif:copyright": ["Ann", "Bo"], "exif:flash": 16, "exif:metering-mode": 5, "exif:white-balance": 1, "exif:exposure-bias-value": "-1/3",
        "exif:lens-specification": ["24/1", "70/1", "28/10", "28/10"], "exif:gps-version-id": [2, 3, 0, 0], "exif:gps-latitude-ref": "S", "exif:gps-latitude": "48510000/1000000", "exif:gps-longitude-ref": "E",
        "exif:gps-longitude": "11000000/1000000", "exif:gps-status": "A", "exif:gps-date-stamp": "2024:03:01",
    }
    assert exif.geo_position(extraction._exif(row)).facts == [("geo:position", {"latitude": -48.51, "longitude": 11.0})]
    assert contracts.CONTRACTS["extractor:image-exif/2"].read is exif.image_fields
    assert (len(exif.TAGS), len(exif.GPS_TAGS), len(exif.INTEROP_TAGS)) == (106, 32, 5) and not exif.LAYOUT & set(exif.TAGS)
    assert {"focal-length-in35mm-film", "iso-speed", "photographic-sensitivity", "y-cb-cr-coefficients", "pixel-x-dimension", "image-unique-id"} <= set(exif.TAGS.values())


def test_all_data_sets_are_found():
    row = SimpleNamespace(width=4)
    got = contracts.image_iptc(extraction._press(row)).facts
    assert len(contracts.IPTC_NAMES) == 48 and len(got) == 50 and {f"iptc:{n}" for n in contracts.IPTC_NAMES.values()} == {a for a, _ in got}
    assert {("iptc:headline", "headline é 4"), ("iptc:province-state", "province-state é 4"), ("iptc:keywords", "key"), ("iptc:caption-abstract", "long")} <= set(got)
    record = b"\x1c\x01\x5a\0\x03\x1b%G" + b"\x1c\x02\x69\0\x02\xc3\xa9" + b"\x1c\x02\x6e\0\x02ab"
    for order, kind, raw in (("<", 7, record), (">", 7, record), ("<", 4, record.ljust(24, b"\0")), (">", 4, record.ljust(24, b"\0"))):
        if kind == 4 and order == "<":
            raw = b"".join(raw[k : k + 4][::-1] for k in range(0, len(raw), 4))
        data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHII", 8, 1, 33723, kind, len(raw) // (4 if kind == 4 else 1), 26) + struct.pack("I", 0) + raw
        assert contracts.image_iptc(data).facts == [("iptc:headline", "é"), ("iptc:credit", "ab")]
    assert contracts.image_iptc(b"\xff\xd8\xff\xda\0\2\x1c\2\x19\0\1x").facts == []


def test_kinds_and_decoders():
    def packed(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "application/epub+zip" if n == "mimetype" else "x")
        return out.getvalue()

    for data, want in [
        (b"%PDF-1", "application/pdf"), (packed("a"), "application/zip"), (packed("mimetype"), "application/epub+zip"), (b"From: a\r\nSubject: b\r\n\r\nx", "message/rfc822"), (b"From a@b Fri Mar 1 2024\nTo: x\nCc: y\n\n", "application/mbox"),
        (packed("[Content_Types].xml", "xl/a.xml"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), (b"plain", "text/plain"), (b"", "text/plain"), (b"<!DOCTYPE html>", "text/html"), (b"a\0b", "application/octet-stream"), (b"RIFF1234WEBP", "image/webp"),
    ]:
        assert sniff.kind(data) == want, data
    assert not sniff.looks_like_mail(b"Subject: one name only\n\n") and not sniff.looks_like_mail(b"no header\n\n")
    assert sniff.lenient_base64(b"aGV!sbG8\n") == b"hello" and sniff.lenient_base64(b"aGVsbG8=d29ybGQ=") == b"helloworld" and sniff.lenient_base64(b"a") == b""
    assert sniff.lenient_quoted(b"a=C3=A9 =\r\nb=zz \nc=") == "aé b=zz\nc".encode() and sniff.lenient_uu(b"begin 644 f\n#86)C\n\nend\n") == b"abc"


def test_disappearances_are_spared(claims, spark, rows):
    own = lambda s, p, i: [(s, "file:path", f'"{p}"', T(1), f"p{i}"), (s, "prov:host", '"h"', T(1), f"h{i}")]
    df = claims(
        *own(A, "/r/gone", 1), *own(B, "/r/there", 2), *own(C, "/r/locked/x", 3), *own("d" * 64, "/r/skip.tmp", 4), *own("e" * 64, "/empty/x", 5), *own("f" * 64, "/other/x", 6), ("0" * 64, "file:path", '"/r/foreign"', T(1), "q"),
    )
    met = spark.createDataFrame([("/r/there",)], "path string")
    args = (df, met, ["/r", "/empty"], "h", ["/r/locked"], ["*.tmp"])
    assert [x[0] for x in rows(paths.disappeared(*args))] == ["/r/gone"]
    assert [x[0] for x in rows(paths.disappeared(*args, emptied=["/empty"]))] == ["/empty/x", "/r/gone"]
    assert paths.shown_tree(["/a/b/c", "/a/d", "/e"]) == "a/\n  b/\n    c\n  d\ne"


def test_seals_copies_and_fixity(spark, claims, rows):
    df = claims((A, "x:y", "1", T(1), "1"), (B, "x:y", "1", T(1), "2"), (A, "x:y", "2", T(1), "3"), (A, "x:y", "3", T(1), "4"), (C, "x:y", "1", T(1), "5"), (A, "x:y", "4", T(1), "6"))
    segments = spark.createDataFrame([(0, "S0", None), (1, "s1", "s0")], "seq long, digest string, previous string")
    blobs = spark.createDataFrame([(A, "content", None), (C, "derived", None)], "digest string, store string, removed timestamp_ntz")
    assert rows(verify.seal_check(df, blobs, segments, "S0")) == [(A, "content"), (B, "missing")]
    assert verify.seal_check(df, blobs, segments, "none").count() == 0
    copied = spark.createDataFrame([("s0",)], "digest string")
    assert rows(verify.copy_plan(df, blobs, segments, copied)) == [("file", C), ("segment", "s1")]
    files = spark.createDataFrame([("x" * 64, bytearray(b"")), (A, None)], "digest string, content binary").withColumn("digest", F.when(F.col("content").isNull(), F.col("digest")).otherwise(F.sha2("content", 256)))
    assert sorted(x.fixity for x in verify.fixity(files).collect()) == ["sound", "unreadable"]


def test_moment_dispatch(claims):
    df = claims((A, "x:y", "1", T(1), "1"), (A, "x:y", "2", "2024-03-02T12:00:00Z", "2"), (A, "x:y", "3", T(3), "3"))
    assert [r.at(df, g).count() for g in ("2024-03-02", "2024-03-02T12:00:00", "2024-03-01T00:00:00Z")] == [2, 2, 1]
    assert r.at(df, "12345678-1234-1234-1234-123456789abc") is None
    with pytest.raises(ValueError):
        r.at(df, "yesterday")


