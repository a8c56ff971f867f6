"""Queries of extractors, scalar functions and the log's text, over files made from the given tables.

The tables hold texts but no mails, archives or images. So the queries build such files
from them by a fixed rule, one per row, in the executors: a message around each document,
an archive of each origin's names, a picture header of each raster subject.
"""

from __future__ import annotations

import base64
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.extract import contracts, exif, sniff
from claimwright.functions import grammar, mail, names
from claimwright.functions.batched import batched
from claimwright.operators import ask, nearby, paths, reconcile, verify, write
from claimwright.operators.instants import read_text, spelled
from claimwright.operators.orphans import held
from claimwright.operators.wide import raster
from claimwright.plans import record as r, terms
from claimwright.plans.ranks import ranked
from claimwright.queries import training
from claimwright.queries.reference import PRELUDE
from claimwright.plans.tables import table, work_folder
from claimwright.sources import files as sources, log
from claimwright.sources.segments import Log
from claimwright.streaming.index import Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, *tables: str):
    def put(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables or ("claims",)))
        if sql is not None:
            SQL[name] = PRELUDE + sql
        return f

    return put


def _made(rows: DataFrame, build: Callable[[tuple], bytes], key: str) -> DataFrame:
    """Files (subject, content): *build* of each row."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"subject": part[key].astype(str), "content": [build(x) for x in part.itertuples(index=False)]})

    return rows.mapInPandas(batches, "subject string, content binary")


# -- mail


#: Header lines, and bodies whose text is sent in three ways, alternate over the documents.
def _message(d) -> bytes:
    text, k = ("" if d.text is None else d.text).encode("utf-8", "replace"), d.doc_id
    sender = [f"=?utf-8?q?Ann_M=C3=BCller?= <Ann.{k}@Example.org>", f"ann.{k}@example.org (Ann)", f"<root>, Team: x{k}@y.z;"][k % 3]
    clock = [f"Fri, 1 Mar 2024 10:00:{k % 60:02d} +0100", f"Fri Mar  1 10:{k % 60:02d}:00 2024", f"31 Dec 2016 23:59:60 GMT (leap {k})", "no date"][k % 4]
    head = f'From: {sender}\r\nTo: b@x.org, "C, D" <c@x.org>, nobody\r\nSubject: note\r\n {k}\r\nMessage-ID: <{k}@x.org>\r\nDate: {clock}\r\nContent-Type: multipart/mixed; boundary="b{k}x"\r\n\r\n'
    way = ["8bit", "base64", "quoted-printable"][k % 3]
    sent = text if way == "8bit" else base64.encodebytes(text) if way == "base64" else re.sub(rb"[^!-<>-~]", lambda m: b"=%02X" % m[0][0], text)
    part = f"--b{k}x\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: {way}\r\n\r\n".encode()
    name = [f'; filename="n{k}.txt"', f"; filename*=utf-8''n%C3%A9{k}.txt", f"; filename*0=long; filename*1=n{k}.txt", f'; filename="dir/n{k}.txt"'][k % 4]
    kept = f"\r\n--b{k}x\r\nContent-Type: text/x-note\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment{name}\r\n\r\n".encode() + base64.b64encode(text)
    inner = f"\r\n--b{k}x\r\nContent-Type: message/rfc822\r\n\r\nFrom: in{k}@x.org\r\nDate: x\r\n\r\nin\r\n--b{k}x--\r\n".encode()
    return head.encode() + part + sent + kept + inner


def _messages(documents: DataFrame) -> DataFrame:
    return _made(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), _message, "doc_id")


def _contract(source: str) -> contracts.Contract:
    return contracts.CONTRACTS[source]


def _facts(files: DataFrame, source: str) -> DataFrame:
    """What a contract finds in *files*: (subject, attribute, value)."""
    return contracts.examine(files, _contract(source)).where("attribute IS NOT NULL").select("subject", "attribute", "value")


_DOCS = "(SELECT doc_id AS k, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"
_ROWS = "SELECT k::VARCHAR AS subject, {} AS attribute, '\"' || {} || '\"' AS value FROM " + _DOCS
_DATE = "CASE k % 4 WHEN 0 THEN '2024-03-01T09:00:' || lpad((k % 60)::VARCHAR, 2, '0') || 'Z' WHEN 1 THEN '2024-03-01T10:' || lpad((k % 60)::VARCHAR, 2, '0') || ':00' ELSE '2016-12-31T23:59:60Z' END"
_add(
    "mail_headers",
    " UNION ALL ".join([
        _ROWS.format("'file:mime'", "'message/rfc822'"), _ROWS.format("'mail:subject'", "'note ' || k"), _ROWS.format("'mail:message-id'", "k || '@x.org'"), _ROWS.format("'mail:to'", "'<b@x.org>'"), _ROWS.format("'mail:to'", "'C, D <c@x.org>'"),
        _ROWS.format("'mail:from'", "CASE k % 3 WHEN 0 THEN 'Ann Müller <ann.' || k || '@example.org>' WHEN 1 THEN 'Ann <ann.' || k || '@example.org>'"
    " ELSE '<root>' END"), _ROWS.format("'mail:from'", "'<x' || k || '@y.z>'") + " WHERE k % 3 = 2",
        _ROWS.format("'mail:date'", _DATE) + " WHERE k % 4 <> 3",
    ]),
    "documents",
)(lambda d: contracts.examine(_messages(d), _contract("extractor:mail-headers/1")).select("subject", "attribute", "value"))
_add("mail_dates", f"SELECT k::VARCHAR AS subject, CASE WHEN k % 4 <> 3 THEN {_DATE} END AS moment FROM {_DOCS}", "documents")(
    lambda d: d.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("subject"), mail.mail_date(_date_text(F.col("doc_id"))).alias("moment"))
)


def _date_text(k):
    second = F.lpad((k % 60).cast("string"), 2, "0")
    return (
        F.when(k % 4 == 0, F.concat(F.lit("Fri, 1 Mar 2024 10:00:"), second, F.lit(" +0100"))).when(k % 4 == 1, F.concat(F.lit("Fri Mar  1 10:"), second, F.lit(":00 2024")))
        .when(k % 4 == 2, F.lit("31 Dec 16 23:59:60 GMT (leap (a))")).otherwise(F.lit("no date"))
    )


_add(
    "mail_attachments",
    f"SELECT k::VARCHAR AS subject, sha256(text) AS derived, '\"' || CASE k % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'né' WHEN 2 THEN 'longn'"
    f" ELSE 'n' END || k || '.txt\"' AS value, octet_length(encode(text))::VARCHAR AS size FROM {_DOCS}",
    "documents",
)(
    lambda d: contracts.examine(_messages(d), _contract("extractor:mail-attachments/1")).where("attribute IN ('file:name', 'file:size')").groupBy("subject", "derived")
    .agg(F.max(F.when(F.col("attribute") == "file:name", F.col("value"))).alias("value"), F.max(F.when(F.col("attribute") == "file:size", F.col("value"))).alias("size")).where("value IS NOT NULL")
)
_WHITE = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FROM = "CASE k % 3 WHEN 0 THEN 'Ann Müller <Ann.' || k || '@Example.org>' WHEN 1 THEN 'ann.' || k || '@example.org (Ann)' ELSE '<root>, Team: x' || k || '@y.z;' END"
_SENT = "CASE k % 4 WHEN 0 THEN 'Fri, 1 Mar 2024 10:00:' || lpad((k % 60)::VARCHAR, 2, '0') || ' +0100' WHEN 1 THEN 'Fri Mar 1 10:' || lpad((k % 60)::VARCHAR, 2, '0') || ':00 2024' WHEN 2 THEN '31 Dec 2016 23:59:60 GMT (leap ' || k || ')' ELSE 'no date' END"
_add(
    "mail_text",
    f"""SELECT k::VARCHAR AS subject, sha256('From     ' || {_FROM} || chr(10) || 'To       b@x.org, "C, D" <c@x.org>, nobody' || chr(10) || 'Date     ' || {_SENT} || chr(10) || 'Subject  note ' || k || chr(10)
    || CASE WHEN regexp_matches(text, '^{_WHITE}*$') THEN '' ELSE chr(10) || regexp_replace(text, '\r\n?', chr(10), 'g') END) AS derived FROM {_DOCS}""",
    "documents",
)(lambda d: contracts.examine(_messages(d), _contract("extractor:mail-text/1")).where("attribute = 'file:size'").select("subject", "derived"))


def _nested(d) -> bytes:
    """A message around an archive around the document's message, which has a text and an attachment of its own."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(f"m{d.doc_id}.eml"), _message(d))
    head = f"From: Ann <ann@x.org>\r\nTo: b@x.org\r\nSubject: box {d.doc_id}\r\nDate: Fri, 1 Mar 2024 11:00:00 +0100\r\nContent-Type: multipart/mixed; boundary=box\r\n\r\n"
    note = f"--box\r\nContent-Type: text/plain\r\n\r\nsee box\r\n{d.doc_id}\r\n--box\r\nContent-Type: application/zip\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment; filename=box.zip\r\n\r\n"
    return (head + note).encode() + base64.encodebytes(box.getvalue()) + b"--box--\r\n"


@_add("extract_fixpoint", None, "documents")
def _fixpoint(documents: DataFrame) -> DataFrame:
    """All contracts until a round examines nothing: messages, their archives, the messages in these, and what was taken from those."""
    files = _made(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), _nested, "doc_id")
    return contracts.recorded(contracts.settle(files), "2026-12-01T00:00:00Z", "r").select("subject", "attribute", "value", "source")


_add(
    "udtf_text_stats",
    "SELECT doc_id::VARCHAR AS subject, (length(text) - length(replace(text, chr(10), '')) + 1)::VARCHAR AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "documents",
)(
    lambda d: contracts.examine(
        d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("subject"), F.encode("text", "utf-8").alias("content")), _contract("extractor:text-stats/1")
    ).where("attribute = 'text:lines'").select("subject", F.col("value").alias("lines"))
)

# -- archives, pictures, documents


def _archive(row) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(row.names):
            z.writestr(zipfile.ZipInfo(name), name)
    return out.getvalue()


def _packs(claims: DataFrame) -> DataFrame:
    """An archive per subject and thousand entries, so no archive holds a great container whole."""
    rows = ask.values(claims, "packed:path").select("subject", F.get_json_object("value", "$").alias("name")).where(F.col("name").isNotNull())
    rows = ranked(rows.distinct(), ["subject"], ["name"])
    block = F.floor(F.col("rank") / 1000).cast("string")
    return _made(rows.groupBy(F.concat("subject", F.lit("/"), block).alias("subject")).agg(F.collect_set("name").alias("names")), _archive, "subject")


_PACKED = "SELECT DISTINCT subject, json_extract_string(value, '$') AS name FROM live WHERE attribute = 'packed:path' AND value LIKE '\"%'"
_add("packed_list", f"SELECT subject, '@' || name AS name FROM ({_PACKED})")(
    lambda c: contracts.examine(_packs(c), _contract("extractor:packed-list/1")).select(F.split_part("subject", F.lit("/"), F.lit(1)).alias("subject"), F.get_json_object("value", "$").alias("name"))
)
_add("packed_unpack", f"SELECT subject, sha256(name) AS derived FROM ({_PACKED})")(
    lambda c: contracts.examine(_packs(c), _contract("extractor:packed-unpack/1")).where("attribute = 'file:path'").select(F.split_part("subject", F.lit("/"), F.lit(1)).alias("subject"), "derived")
)


def _packet(row) -> bytes:
    """An XMP packet with a value of every shape, each with the picture's width in it."""
    w = row.width
    return f"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:m="http://ns.adobe.com/xap/1.0/mm/"
      xmlns:own="u:own" own:CreatorTool="t{w}"><d:subject><rdf:Bag><rdf:li>a</rdf:li><rdf:li>b{w}</rdf:li><rdf:li>a</rdf:li></rdf:Bag></d:subject><d:creator><rdf:Seq><rdf:li>x{w}</rdf:li><rdf:li>y</rdf:li></rdf:Seq></d:creator>
      <d:title><rdf:Alt><rdf:li xml:lang="de">nein</rdf:li><rdf:li xml:lang="x-default">t{w}</rdf:li></rdf:Alt></d:title><m:DerivedFrom rdf:parseType="Resource"><m:documentID>i{w}</m:documentID></m:DerivedFrom></rdf:Description></rdf:RDF></x:xmpmeta>""".encode()


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + b"\0" * 4


def _box(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + name + body


def _picture(row) -> bytes:
    """A picture of one of five kinds, by its width: its grid, and its packet where the kind keeps one."""
    w, h, alpha, xmp = row.width, row.height, row.alpha == "true", _packet(row)
    depth, gray = max(row.depth, 1), row.color == "gray"
    kind = w % 5
    if kind == 0:
        model = {("gray", False): 0, ("indexed", False): 3, ("indexed", True): 3, ("gray", True): 4, ("rgb", True): 6}.get((row.color, alpha), 2)
        clear = _chunk(b"tRNS", b"\0") if alpha else b""
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBB", w, h, depth, model) + b"\0" * 3) + clear + _chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp) + _chunk(b"IDAT", b"")
    if kind == 1:
        n = {"gray": 1, "cmyk": 4}.get(row.color, 3)
        part = b"http://ns.adobe.com/xap/1.0/\0" + xmp
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, h % 65536, w % 65536, n) + b"\0" * (3 * n) + b"\xff\xd9"
    if kind == 2:
        own, samples = {"gray": (1, 1), "indexed": (3, 1), "cmyk": (5, 4)}.get(row.color, (2, 3))
        fields = [(256, 4, 1, struct.pack(">I", w)), (257, 4, 1, struct.pack(">I", h)), (258, 3, 1, struct.pack(">HH", depth, 0)), (262, 3, 1, struct.pack(">HH", own, 0)), (277, 3, 1, struct.pack(">HH", samples + alpha, 0))]
        at = 8 + 2 + 12 * (len(fields) + 1) + 4
        fields.append((700, 1, len(xmp), struct.pack(">I", at)))
        return b"MM\0*" + struct.pack(">IH", 8, len(fields)) + b"".join(struct.pack(">HHI", *f[:3]) + f[3] for f in fields) + b"\0" * 4 + xmp
    if kind == 3:
        body = b"VP8X" + struct.pack("<I", 10) + bytes([0x10 * alpha + 4, 0, 0, 0]) + (w - 1).to_bytes(4, "little")[:3] + (h - 1).to_bytes(4, "little")[:3] + b"XMP " + struct.pack("<I", len(xmp)) + xmp
        return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    full = b"\0" * 4
    properties = _box(b"ispe", full + struct.pack(">II", w, h)) + _box(b"pixi", full + bytes([1] if gray else [3]) + bytes([depth]) * (1 if gray else 3)) + _box(b"auxC", full + b"urn:mpeg:hevc:2015:auxid:1\0")
    owned = _box(b"ipma", full + struct.pack(">I", 2) + struct.pack(">HBBB", 1, 2, 1, 2) + struct.pack(">HBB", 2, 1, 3))
    refers = _box(b"iref", full + (_box(b"auxl", struct.pack(">HHH", 2, 1, 1)) if alpha else b""))
    items = _box(b"iinf", full + struct.pack(">H", 1) + _box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 3, 0) + b"mime\0application/rdf+xml\0"))
    place = _box(b"iloc", b"\1\0\0\0" + bytes([0x44, 0]) + struct.pack(">H", 1) + struct.pack(">HHHHII", 3, 1, 0, 1, 0, len(xmp)))
    meta = full + _box(b"pitm", full + struct.pack(">H", 1)) + items + place + _box(b"iprp", _box(b"ipco", properties) + owned) + refers + _box(b"idat", xmp)
    return _box(b"ftyp", b"heic" + full) + _box(b"meta", meta)


def _press(row) -> bytes:
    """A JPEG whose record has every data set, some twice, one with a long length, behind another resource."""
    data_set = lambda record, n, v: b"\x1c" + bytes([record, n]) + struct.pack(">H", len(v)) + v
    named = b"".join(data_set(2, n, f"{name} é {row.width}".encode()) for n, name in contracts.IPTC_NAMES.items())
    record = data_set(1, 90, b"\x1b%G") + named + data_set(2, 25, b"key") * 2 + b"\x1c\x02\x78\x80\x04" + struct.pack(">I", 5) + b"long\0"
    resource = lambda n, v: b"8BIM" + struct.pack(">H", n) + b"\0\0" + struct.pack(">I", len(v)) + v + b"\0" * (len(v) % 2)
    body = b"Photoshop 3.0\0" + resource(0x03ED, b"odd") + resource(0x0404, record)
    return b"\xff\xd8\xff\xed" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def _rasters(claims: DataFrame) -> DataFrame:
    return raster(claims).where("width BETWEEN 1 AND 16777216 AND height BETWEEN 1 AND 16777216 AND depth BETWEEN -1 AND 255").drop("ordinal")


def _pictures(claims: DataFrame) -> DataFrame:
    return _made(_rasters(claims), _picture, "subject")


_add("image_raster", None)(lambda c: _facts(_pictures(c), "extractor:image-raster/3"))
_add("image_xmp", None)(lambda c: _facts(_pictures(c), "extractor:image-xmp/1"))
_add("image_iptc", None)(lambda c: _facts(_made(_rasters(c), _press, "subject"), "extractor:image-iptc/1"))
_add("mime_sniff", None)(lambda c: _pictures(c).select("subject", names.image_kind(F.col("content")).alias("mime")))


def _document(row) -> bytes:
    """A PDF of a title: as a literal, in hexadecimal UTF-16 or in an object stream, with an embedded file that holds the title, in the name tree or on a page."""
    title, k = row.title, len(row.title) % 3
    wide = b"\xfe\xff" + title.encode("utf-16-be", "replace")
    literal = b"(" + wide.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    info = b"<< /Title " + (literal if k == 0 else b"<" + wide.hex().encode() + b">") + b" /Trapped /True /x_y (no) >>"
    inside = zlib.compress(b"4 0 " + info)
    data = zlib.compress(title.encode("utf-8", "replace"))
    spec = b"<< /Type /Filespec /UF (dir/t.txt) /Desc (d) /AFRelationship /Data /EF << /F 7 0 R >> >>"
    where = b"/Names << /EmbeddedFiles << /Kids [8 0 R] >> >>" if k else b"/Pages 5 0 R"
    return (
        b"%PDF-1.7\n1 0 obj << /Type /Catalog " + where + b" >> endobj\n" + (b"4 0 obj " + info + b" endobj\n" if k < 2 else b"9 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >> stream\n" % len(inside) + inside + b"\nendstream endobj\n")
        + b"5 0 obj << /Type /Pages /Kids [6 0 R] >> endobj\n6 0 obj << /Type /Page /Annots [<< /Subtype /FileAttachment /FS " + spec + b" >>] >> endobj\n"
        + b"7 0 obj << /Type /EmbeddedFile /Subtype /text#2Fplain /Filter /FlateDecode /Length %d /Params << /ModDate (D:2024) >> >> stream\r\n" % len(data) + data + b"\r\nendstream endobj\n8 0 obj << /Names [(a) " + spec + b"] >> endobj\ntrailer << /Root 1 0 R /Info 4 0 R >>\n"
    )


def _titled(claims: DataFrame) -> DataFrame:
    rows = ask.values(claims, "pdf:title").where(F.col("value").startswith('"')).groupBy("subject").agg(F.min(F.get_json_object("value", "$")).alias("title"))
    return _made(rows, _document, "subject")


_TITLES = "FROM (SELECT subject, min(json_extract_string(value, '$')) AS t FROM live WHERE attribute = 'pdf:title' AND value LIKE '\"%' GROUP BY 1)"
_add("pdf_info", f"SELECT subject, 'pdf:title' AS attribute, t AS text {_TITLES} WHERE t <> '' UNION ALL SELECT subject, 'pdf:trapped', 'True' {_TITLES}")(
    lambda c: contracts.examine(_titled(c), _contract("extractor:pdf-text/1")).where("attribute IS NOT NULL").select("subject", "attribute", F.get_json_object("value", "$").alias("text"))
)
_add(
    "pdf_attachments",
    f"SELECT subject, sha256(t) AS derived, unnest(['file:size', 'file:mime', 'file:name', 'file:path', 'pdf:desc', 'pdf:af-relationship', 'pdf:mod-date', 'prov:origin']) AS attribute,"
    f" unnest([octet_length(encode(t))::VARCHAR, '\"text/plain\"', '\"t.txt\"', '\"@dir/t.txt\"', '\"d\"', '\"Data\"', '\"D:2024\"', '\"' || subject || '\"']) AS value {_TITLES}",
)(lambda c: contracts.examine(_titled(c), _contract("extractor:pdf-attachments/1")).where("attribute IS NOT NULL").select("subject", "derived", "attribute", "value"))
_add("html_text", None, "documents")(
    lambda d: d.select("doc_id", batched(contracts.html_text, "string")(F.concat(F.lit("<html><style>x{}</style><b>"), "text", F.lit("</b></html>"))).alias("shown"))
)
_add("geo_position", "SELECT DISTINCT k, -(k % 90 + (k % 60) / 60.0 + (k % 6000) / 100.0 / 3600)::DOUBLE AS degrees FROM (SELECT o_orderkey AS k FROM orders)", "orders")(
    lambda o: o.select(F.col("o_orderkey").alias("k")).distinct()
    .select("k", names.degrees(F.format_string("%d/1 %d/1 %d/100", F.col("k") % 90, F.col("k") % 60, F.col("k") % 6000), F.lit("S")).alias("degrees"))
)

# -- scalar functions

_STRICT = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)Z$') AND try_cast({0}[1:10] AS DATE) IS NOT NULL THEN {0} END"
_WIDE = "CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN t || '{0}Z' WHEN length(t) = 19 AND t NOT LIKE '%Z' THEN t || 'Z' ELSE t END"
_add(
    "time_widening",
    f"SELECT given, {_STRICT.format('o')} AS opens, {_STRICT.format('c')} AS closes FROM (SELECT given, {_WIDE.format('T00:00:00')} AS o, {_WIDE.format('T23:59:59')} AS c FROM"
    " (SELECT given, trim(given) AS t FROM (SELECT DISTINCT unnest([time, time[1:10], time[1:19], time[1:7]]) AS given FROM claims) WHERE given IS NOT NULL))",
)(
    lambda c: c.select(F.explode(F.array("time", *[F.substring("time", 1, n) for n in (10, 19, 7)])).alias("given")).where("given IS NOT NULL").distinct()
    .select("given", terms.widened(F.col("given"), "T00:00:00").alias("opens"), terms.widened(F.col("given"), "T23:59:59").alias("closes"))
)
_add(
    "rfc3339_shift",
    "SELECT DISTINCT time, strftime(time[1:19]::TIMESTAMP - to_minutes((CASE time[20:20] WHEN '-' THEN -1"
    " ELSE 1 END * (time[21:22]::INT * 60 + time[24:25]::INT))::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM claims WHERE regexp_matches(time, '^....-..-..T..:..:..[+-]..:..$')",
)(lambda c: c.where(F.col("time").rlike(r"^....-..-..T..:..:..[+-]..:..\z")).select("time").distinct().select("time", spelled(read_text(F.col("time"))).alias("utc")))
_add(
    "mtime_text",
    "SELECT DISTINCT epoch(ts)::BIGINT AS s, strftime(to_timestamp(epoch(ts)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 1000 = 0 THEN ''"
    " ELSE '.' || rtrim(lpad((event_id % 1000)::VARCHAR, 9, '0'), '0') END || 'Z' AS text FROM events",
    "events",
)(lambda e: e.select(F.unix_seconds(F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))).alias("s"), (F.col("event_id") % 1000).alias("n")).distinct().select("s", names.modified_text(F.col("s"), F.col("n")).alias("text")))
SQL["mtime_text"] = SQL["mtime_text"].replace("to_timestamp(epoch(ts)::BIGINT) AT TIME ZONE 'UTC'", "date_trunc('second', ts)").replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT")
_add(
    "epoch_seconds",
    """, t AS (SELECT DISTINCT time, regexp_extract(time, '^[+]?([0-9]{1,9})-[+]?([0-9]{1,9})-[+]?([0-9]{1,9})T[+]?([0-9]{1,9}):[+]?([0-9]{1,9}):[+]?([0-9]{1,9})([.].*)?Z?$', ['y', 'm', 'd', 'h', 'i', 's', 'f']) AS g FROM claims),
    n AS (SELECT time, try_cast(g.y AS BIGINT) AS y, try_cast(g.m AS BIGINT) AS m, try_cast(g.d AS BIGINT) AS d, try_cast(g.h AS BIGINT) AS h, try_cast(g.i AS BIGINT) AS i, try_cast(g.s AS BIGINT) AS s FROM t),
    e AS (SELECT time, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND h <= 23 AND i <= 59 AND y <= 9999 THEN (epoch(make_date(y, least(greatest(m, 1), 12), 1)) + (d - 1) * 86400 + h * 3600 + i * 60 + s)::BIGINT END AS e FROM n)
    SELECT time, CASE WHEN e BETWEEN 0 AND 4294967295 THEN e END AS seconds FROM e""",
)(lambda c: c.select("time").distinct().select("time", names.epoch(F.col("time")).alias("seconds")))
_add(
    "aside_names",
    "SELECT path, subject, CASE WHEN regexp_matches(path, '(?s)^.*/[^/]+\\.[^./]+$') THEN regexp_replace(path, '(?s)^(.*/[^/]+)(\\.[^./]+)$', '\\1-' || subject[1:8] || '\\2')"
    " ELSE path || '-' || subject[1:8] END AS name FROM paths WHERE path LIKE '/%'",
)(lambda c: paths.all_paths(c).where(F.col("path").startswith("/")).select("path", "subject", paths.aside(F.col("path"), F.col("subject")).alias("name")))
_add("label_names", "SELECT DISTINCT value, regexp_replace(json_extract_string(value, '$'), '^\\\\', '/') AS label FROM live WHERE attribute = 'mailbox:tag' AND value LIKE '\"%'")(
    lambda c: ask.values(c, "mailbox:tag").where(F.col("value").startswith('"')).select("value").distinct().select("value", names.label(F.get_json_object("value", "$")).alias("label"))
)
_add("message_ids", "SELECT DISTINCT value, array_to_string(regexp_extract_all(json_extract_string(value, '$'), '<([^<>]*)>?', 1), ' ') AS ids FROM live"
    " WHERE attribute = 'mail:message-id' AND value LIKE '\"%'")(
    lambda c: ask.values(c, "mail:message-id").where(F.col("value").startswith('"')).select("value").distinct().select("value", F.array_join(names.message_ids(F.get_json_object("value", "$")), " ").alias("ids"))
)
_BASES = "unnest([path, path || '/', path || '/..', replace(path, '/', chr(92)), path || '/ x '])"
_add("basenames", f"SELECT path, CASE WHEN n NOT IN ('', '.', '..') THEN n END AS name FROM (SELECT path, trim(regexp_extract(path, '([^/\\\\]*)$', 1)) AS n"
    f" FROM (SELECT DISTINCT {_BASES} AS path FROM paths))")(
    lambda c: paths.all_paths(c).select(F.explode(F.array("path", *[F.concat("path", F.lit(x)) for x in ("/", "/..", "/ x ")], F.translate("path", "/", "\\"))).alias("path")).distinct()
    .select("path", names.basename(F.col("path")).alias("name"))
)
_TAGS = "SELECT DISTINCT json_extract_string(value, '$') AS name FROM live WHERE attribute = 'user:tag' AND value LIKE '\"%'"


def _tags(claims: DataFrame) -> DataFrame:
    return ask.values(claims, "user:tag").where(F.col("value").startswith('"')).select(F.get_json_object("value", "$").alias("name")).distinct()


_add("utf7_names", f"SELECT name, CASE WHEN regexp_matches(name, '^[\\x20-\\x7e]*$') THEN 'a&-' || name || '&-b' END AS wire_of_ascii, name || ' 台&北' AS back"
    f" FROM ({_TAGS}) WHERE NOT contains(name, '&')")(
    lambda c: _tags(c).where(~F.contains("name", F.lit("&"))).select(
        "name", F.when(F.col("name").rlike(r"^[\x20-\x7e]*\z"), mail.to_utf7(F.concat(F.lit("a&"), "name", F.lit("&b")))).alias("wire_of_ascii"), mail.from_utf7(mail.to_utf7(F.concat("name", F.lit(" 台&北")))).alias("back")
    )
)
_add("folder_compare", f"SELECT name, nfc_normalize(CASE WHEN upper(name) = 'INBOX' THEN 'INBOX' ELSE name END) AS key FROM (SELECT name"
    f" FROM ({_TAGS}) UNION SELECT upper(name) FROM ({_TAGS}) UNION SELECT name || 'e' || chr(769) FROM ({_TAGS}) UNION SELECT 'inBox')")(
    lambda c: _tags(c).select(F.explode(F.array("name", F.upper("name"), F.concat("name", F.lit("e\u0301")), F.lit("inBox"))).alias("name")).distinct().select("name", mail.folder(F.col("name")).alias("key"))
)
_add(
    "fits_names",
    f"SELECT name, CASE WHEN octet_length(encode(name)) <= 240 THEN name ELSE name[1:235] || '.text' END AS short FROM (SELECT name"
    f" FROM ({_TAGS}) UNION SELECT 'x' || repeat('long-', n) || '.text' FROM (SELECT unnest(range(40, 60)) AS n))",
)(
    lambda c: _tags(c).select("name").unionByName(c.sparkSession.range(40, 60).select(F.concat(F.lit("x"), F.expr("repeat('long-', int(id))"), F.lit(".text")).alias("name"))).distinct().select("name", mail.fits(F.col("name")).alias("short"))
)
_add(
    "legal_names",
    """, n AS (SELECT DISTINCT unnest([json_extract_string(value, '$'), 'xmp' || json_extract_string(value, '$') || 'ToolkitName2Go']) AS name FROM live
      WHERE attribute IN ('user:tag', 'file:name') AND value LIKE '"%')
    SELECT name, nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS attribute FROM n""",
)(
    lambda c: r.live_values(c, ["user:tag", "file:name"]).where(F.col("value").startswith('"')).select(F.get_json_object("value", "$").alias("n"))
    .select(F.explode(F.array("n", F.concat(F.lit("xmp"), "n", F.lit("ToolkitName2Go")))).alias("name")).distinct().select("name", names.legal(F.col("name")).alias("attribute"))
)

# -- the log's text


_LINE_OF = """'{"subject":"' || subject || '","attribute":"' || attribute || '",' || CASE WHEN retracts IS NULL THEN '"value":' || value
      ELSE '"retracts":["' || array_to_string(retracts, '","') || '"]' END || ',"time":"' || time || '","source":"' || source || '"' || coalesce(',"run":"' || run || '"', '') || '}'"""


@_add(
    "segment_round_trip",
    f""", f AS (SELECT * FROM claims WHERE cid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(cid) ORDER BY seq, position) = 1)
    SELECT sha256({_LINE_OF}) AS cid, lower(subject) AS subject, attribute, value, array_to_string(list_transform(retracts, lambda x: lower(x)), ' ') AS retracts, time, source, run,
    CASE WHEN NOT (regexp_matches(time, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)Z$') AND try_cast(time[1:10] AS DATE) IS NOT NULL) THEN 'field' END AS fault FROM f""",
)
def _round_trip(claims: DataFrame) -> DataFrame:
    """All claims, retractions too, written as lines of text segments and read back strictly; ids are those of the lines, a fault stands beside its line's claim."""
    first = F.min(F.struct("seq", "position", *log.MEMBERS)).alias("f")  # not r.record(): ids are those of the spelling that was sealed, capitals included
    rows = claims.where(F.col("cid").isNotNull()).groupBy(F.lower("cid").alias("cid")).agg(first).select("f.*")
    path = work_folder(claims.sparkSession, "segment")
    log.claim_lines(rows).select(F.col("line").alias("value")).write.text(path, compression="gzip")
    back = log.read_segments(claims.sparkSession, path)
    return back.select("cid", "subject", "attribute", "value", F.array_join(F.transform("retracts", F.lower), " ").alias("retracts"), "time", "source", "run", "fault")


@_add("log_seal", "SELECT cid FROM (SELECT DISTINCT lower(cid) AS cid FROM claims"
    " WHERE regexp_matches(time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)Z$') AND try_cast(time[1:10] AS DATE) IS NOT NULL)")
def _sealed(claims: DataFrame) -> DataFrame:
    """The record appended to a log in two bundles, sealed, folded into a copy and read from there."""
    written = Log(claims.sparkSession, work_folder(claims.sparkSession, "log"))
    rows = r.record(claims).where(grammar.valid_time(F.col("time")))
    for part in (rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1 OR seq IS NULL")):
        written.append(part)
        written.seal()
    copy = Index(written, work_folder(claims.sparkSession, "copy"))
    copy.catch_up()
    lines = copy.claims().select("cid").distinct()
    return rows.withColumn("id", grammar.claim_id()).join(lines.withColumnRenamed("cid", "id"), "id", "left_semi").select("cid")


_add("log_faults", """SELECT CASE WHEN NOT (regexp_matches(time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)Z$') AND try_cast(time[1:10] AS DATE) IS NOT NULL) THEN 'field' END AS fault, count(*) AS n
      FROM rec GROUP BY 1""")(
    lambda c: log.parse_lines(log.claim_lines(r.record(c)).select(F.col("line").alias("value"))).groupBy("fault").agg(F.count("*").alias("n"))
)
_add(
    "log_concat",
    "SELECT lower(cid) AS cid, count(*) AS times, min(part) AS first_part FROM (SELECT cid, 0 AS part FROM claims WHERE seq <= 1 UNION ALL SELECT cid, 1 FROM claims"
    " WHERE seq > 0) WHERE cid IS NOT NULL GROUP BY 1",
)(lambda c: log.concatenated([c.where("seq <= 1"), c.where("seq > 0")]).groupBy(F.lower("cid").alias("cid")).agg(F.count("*").alias("times"), F.min("part").alias("first_part")).where("cid IS NOT NULL"))
_add("reference_difference", "SELECT DISTINCT lower(subject) AS digest FROM claims WHERE seq > 0 EXCEPT SELECT lower(subject) FROM claims WHERE seq = 0")(
    lambda c: verify.delta(c.where("seq > 0"), c.where("seq = 0"))
)
_add("first_five", "SELECT digest FROM (SELECT digest FROM refs EXCEPT SELECT digest"
    " FROM held) ORDER BY digest LIMIT 5", "claims", "blobs")(lambda c, b: ask.first(verify.missing(c, b), "digest"))
_add("ordered_lists", "SELECT path, subject, row_number() OVER (PARTITION BY path ORDER BY subject) AS place FROM paths")(
    lambda c: ranked(paths.all_paths(c), ["path"], ["subject"], "place")
)
_RUNS = ["image:raster", "image:exif", "text:stats"]
_add(
    "worklist_full",
    """SELECT DISTINCT subject, v.source FROM live l
      JOIN (VALUES ('"image/png"', 'extractor:image-raster/3'), ('"image/jpeg"', 'extractor:image-raster/3'), ('"image/tiff"', 'extractor:image-raster/3'), ('"image/webp"', 'extractor:image-raster/3'), ('"image/heic"', 'extractor:image-raster/3'), ('"image/heif"', 'extractor:image-raster/3'), ('"image/avif"', 'extractor:image-raster/3'),
    ('"image/jpeg"', 'extractor:image-exif/2'), ('"image/tiff"', 'extractor:image-exif/2'), ('"text/plain"', 'extractor:text-stats/1')) v(value, source) ON l.attribute = 'file:mime' AND l.value = v.value""",
)(lambda c: contracts.work(c, contracts.named(_RUNS), full=True))
_add(
    "worklist_memo",
    "SELECT subject FROM live WHERE attribute = 'file:mime' AND value = '\"image/jpeg\"' INTERSECT SELECT subject FROM live"
    " WHERE attribute = 'prov:examined' AND value = '\"extractor:image-exif/1\"'",
)(lambda c: ask.remembered(ask.kinds(c, ["image/jpeg"]), ask.examined(c, "extractor:image-exif/1")))
_add(
    "unchanged_skip",
    """, p AS (SELECT subject, json_extract_string(value, '$') AS path FROM vals WHERE attribute = 'file:path' AND value LIKE '"%'),
    h AS (SELECT subject, value AS host FROM vals WHERE attribute = 'prov:host'), s AS (SELECT subject, value AS size FROM vals
      WHERE attribute = 'file:size'), m AS (SELECT subject, value AS modified FROM vals WHERE attribute = 'file:modified'),
    l AS (SELECT DISTINCT host, path, size, modified FROM p JOIN h USING (subject) JOIN s USING (subject) JOIN m USING (subject))
    SELECT * FROM l WHERE NOT path LIKE '/photos/%'""",
)(lambda c: sources.unchanged(_listing(c), _listing(c).where(F.col("path").startswith("/photos/"))))


def _listing(claims: DataFrame) -> DataFrame:
    rows = r.live_values(claims, ["file:path", "prov:host", "file:size", "file:modified"])
    of = lambda a, n: rows.where(F.col("attribute") == a).select("subject", F.col("value").alias(n))
    named = of("file:path", "value").where(F.col("value").startswith('"')).select("subject", F.get_json_object("value", "$").alias("path"))
    return named.join(of("prov:host", "host"), "subject").join(of("file:size", "size"), "subject").join(of("file:modified", "modified"), "subject").select("host", "path", "size", "modified").distinct()


_add("vault_scan", "SELECT log_id AS store_id, coalesce(mailbox, '') || ':' || coalesce(folder, '') AS place, min(date) AS time FROM vault_logs WHERE log_id IS NOT NULL"
    " GROUP BY 1, 2", "vault_logs")(
    lambda v: sources.vault_messages(v.select(F.col("log_id").alias("store_id"), names.place(F.coalesce("mailbox", F.lit("")), F.coalesce("folder", F.lit(""))).alias("place"), F.col("date").alias("time")))
)
_add(
    "import_plan",
    "SELECT v.log_id, CASE WHEN a.mailbox IS NULL THEN 'label' WHEN v.folder IS NULL THEN 'listed' ELSE 'place' END AS kind, CASE"
    " WHEN a.mailbox IS NOT NULL AND v.folder IS NOT NULL THEN v.mailbox || ':' || v.folder END AS place"
    " FROM (SELECT DISTINCT log_id, mailbox, folder FROM vault_logs) v LEFT JOIN (SELECT DISTINCT mailbox FROM accounts) a ON a.mailbox = v.mailbox",
    "vault_logs", "accounts",
)(reconcile.import_plan)
_add(
    "land_messages",
    """, f AS (SELECT DISTINCT lower(subject) AS subject, octet_length(encode(coalesce(text, ''))) AS size, lower(subject) NOT IN (SELECT digest FROM held) AS fresh
      FROM documents WHERE source = 'mail' AND subject IS NOT NULL)
    SELECT subject, 'mailbox:place' AS attribute, '"work:Inbox"' AS value FROM f UNION ALL SELECT subject, 'mailbox:id', '"' || subject[1:8] || '"' FROM f
    UNION ALL SELECT subject, 'file:mime', '"message/rfc822"' FROM f UNION ALL SELECT subject, 'file:size', size::VARCHAR FROM f WHERE fresh""",
    "documents", "blobs",
)(
    lambda d, b: write.land(
        write.admit(
            d.where((F.col("source") == "mail") & F.col("subject").isNotNull())
            .select(F.lower("subject").alias("subject"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).distinct(), held(b),
        ).select("subject", names.place(F.lit("work"), F.lit("Inbox")).alias("place"), F.substring("subject", 1, 8).alias("message_id"), "size", F.lit("2026-12-01T00:00:00Z").alias("time"), "fresh"), "r",
    ).select("subject", "attribute", "value")
)
_add(
    "export_gather",
    "SELECT DISTINCT subject, json_extract_string(value, '$') AS place FROM (SELECT subject, attribute, value, CASE attribute WHEN 'file:path' THEN 0"
    " WHEN 'mailbox:place' THEN 1 ELSE 2 END AS k FROM vals"
    " WHERE attribute IN ('file:path', 'mailbox:place', 'file:name') AND value LIKE '\"%' QUALIFY k = min(k) OVER (PARTITION BY subject))"
    " WHERE subject IN (SELECT digest FROM held)",
    "claims", "blobs",
)(
    lambda c, b: ask.placements(c).join(held(b).select(F.col("digest").alias("subject")), "subject", "left_semi").select("subject", F.get_json_object("value", "$").alias("place")).distinct()
)
_add(
    "store_fixity",
    "SELECT lower(subject) AS digest, doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN sha256(text) = lower(subject) THEN 'sound' ELSE 'damaged' END AS fixity"
    " FROM documents WHERE subject IS NOT NULL",
    "documents",
)(lambda d: verify.fixity(d.where(F.col("subject").isNotNull()).select(F.lower("subject").alias("digest"), "doc_id", F.encode("text", "utf-8").alias("content")), keep=("doc_id",)))
_add(
    "label_delta",
    "SELECT subject, value, 'assert' AS change FROM (SELECT subject, value FROM vals WHERE attribute = 'mailbox:tag' EXCEPT SELECT subject, value FROM vals"
    " WHERE attribute = 'user:tag')"
    " UNION ALL SELECT subject, value, 'retract' FROM (SELECT subject, value FROM vals WHERE attribute = 'user:tag' EXCEPT SELECT subject, value FROM vals"
    " WHERE attribute = 'mailbox:tag')",
)(lambda c: reconcile.snapshot_changes(ask.values(c, "user:tag"), ask.values(c, "mailbox:tag"), ["subject", "value"]))
_add("json_quoted", "SELECT DISTINCT value, value AS back FROM live WHERE attribute IN ('file:name', 'mail:subject') AND value LIKE '\"%'")(
    lambda c: r.live_values(c, ["file:name", "mail:subject"]).where(F.col("value").startswith('"')).select("value").distinct().select("value", grammar.json_quote(F.get_json_object("value", "$")).alias("back"))
)


def _exif(row) -> bytes:
    """A little-endian TIFF with fields of the picture, the camera and the place of a location, and with some of the file's layout."""
    word = lambda tag, v: (tag, 3, 1, struct.pack("<H", v))
    text = lambda tag, v: (tag, 2, len(v) + 1, v + b"\0")
    rational = lambda tag, x: (tag, 5, 1, struct.pack("<II", round(abs(x) * 1_000_000), 1_000_000))
    pointer = lambda tag, at: (tag, 4, 1, struct.pack("<I", at))

    def directory(at: int, entries: list[tuple]) -> bytes:
        heads, rest, free = b"", b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, count, raw in sorted(entries):
            heads += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(rest)))
            rest += raw if len(raw) > 4 else b""
        return struct.pack("<H", len(entries)) + heads + struct.pack("<I", 0) + rest

    first = lambda camera, gps: directory(8, [word(0x0112, 6), text(0x010F, b"Ann"), text(0x8298, b"Ann\0Bo"), pointer(0x0111, 8), pointer(0x0117, 1), pointer(exif.SUB_DIRECTORY, camera), pointer(exif.GPS_DIRECTORY, gps)])
    camera_at = 8 + len(first(0, 0))
    camera = directory(camera_at, [word(0x9209, 16), word(0x9207, 5), word(0xA403, 1), (0x9204, 10, 1, struct.pack("<ii", -1, 3)), (0x9000, 7, 4, b"0232"), (0xA432, 5, 4, struct.pack("<8I", 24, 1, 70, 1, 28, 10, 28, 10))])
    gps_at = camera_at + len(camera)
    gps = [text(1, b"S" if row.lat < 0 else b"N"), rational(2, row.lat), text(3, b"W" if row.lon < 0 else b"E"), rational(4, row.lon), (0, 1, 4, b"\2\3\0\0"), text(9, b"A"), text(0x1D, b"2024:03:01")]
    return b"II*\0" + struct.pack("<I", 8) + first(camera_at, gps_at) + camera + directory(gps_at, gps)


def _located(claims: DataFrame) -> DataFrame:
    rows = nearby.locations(claims).groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")
    return _made(rows, _exif, "id")


_add("image_exif", None)(lambda c: _facts(_located(c), "extractor:image-exif/2"))
_add("image_geo", None)(lambda c: _facts(_located(c), "extractor:image-geo/1"))


def _mixture(d) -> bytes:
    """A file of one of eight kinds around a document's number."""
    k, box = d.doc_id, io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml" if k % 8 == 3 else "mimetype" if k % 8 == 4 else "a.txt"), "application/epub+zip" if k % 8 == 4 else str(k))
        if k % 8 == 3:
            z.writestr(zipfile.ZipInfo("[Content_Types].xml"), "x")
    return [
        b"\x89PNG\r\n\x1a\n" + bytes([k % 256]), b"%%PDF-1.%d" % (k % 8), box.getvalue(), box.getvalue(), box.getvalue(), b"From x@y.z Fri\nFrom: a%d@b.c\nDate: d\n\n" % k,
        b"Bcc: a@b.c\nSubject: %d\n\n" % k, b"MIME-Version: 1.0\nContent-Type: text/plain\n\n%d" % k,
    ][k % 8]


_add(
    "mime_detect",
    """SELECT doc_id::VARCHAR AS subject, ['image/png', 'application/pdf', 'application/zip', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/epub+zip', 'application/mbox', 'message/rfc822', 'text/plain'][doc_id % 8 + 1] AS mime
    FROM documents WHERE doc_id IS NOT NULL""",
    "documents",
)(lambda d: _made(d.where(F.col("doc_id").isNotNull()).select("doc_id"), _mixture, "doc_id").select("subject", batched(sniff.kind, "string")("content").alias("mime")))
_add(
    "seal_check",
    "SELECT r.digest, coalesce(s.store, 'missing') AS presence FROM (SELECT DISTINCT lower(subject) AS digest FROM claims WHERE seq <= (SELECT seq"
    " FROM segments ORDER BY digest LIMIT 1)) r"
    " LEFT JOIN (SELECT lower(digest) AS digest, min(store) AS store FROM blobs WHERE removed IS NULL GROUP BY 1) s USING (digest)",
    "claims", "blobs", "segments",
)(lambda c, b, s: verify.seal_check(c, b, s, s.agg(F.min("digest")).first()[0] or ""))
_add(
    "copy_plan",
    "SELECT 'segment' AS kind, lower(digest) AS digest FROM segments WHERE seq > 1 UNION ALL SELECT 'file', digest FROM (SELECT lower(subject) AS digest FROM claims"
    " WHERE seq > 1 EXCEPT SELECT lower(subject) FROM claims WHERE seq <= 1 INTERSECT ALL SELECT digest FROM held)",
    "claims", "blobs", "segments",
)(lambda c, b, s: verify.copy_plan(c, b, s, s.where("seq <= 1")))
SQL["copy_plan"] = SQL["copy_plan"].replace("(SELECT lower(subject) AS digest FROM claims WHERE seq > 1 EXCEPT SELECT lower(subject) FROM claims WHERE seq <= 1"
    " INTERSECT ALL SELECT digest FROM held)", "((SELECT lower(subject) AS digest FROM claims WHERE seq > 1 EXCEPT SELECT lower(subject) FROM claims WHERE seq <= 1)"
    " INTERSECT SELECT digest FROM held)")
_add(
    "disappeared",
    """, m AS (SELECT DISTINCT json_extract_string(value, '$') AS path FROM rec WHERE attribute = 'file:path' AND value LIKE '"%' AND time > '2025-01-01T00:00:00Z')
    SELECT path, subject FROM paths WHERE (starts_with(path, '/home/') OR starts_with(path, '/photos/')) AND NOT starts_with(path, '/home/2019/') AND NOT regexp_matches(path, '(?s)(^|/)[^/]*\\.zip(/|$)')
    AND subject IN (SELECT subject FROM vals WHERE attribute = 'prov:host' AND value = (SELECT min(value) FROM claims
      WHERE attribute = 'prov:host')) AND path NOT IN (SELECT path FROM m)""",
)(
    lambda c: paths.disappeared(
        c, c.where((F.col("attribute") == "file:path") & (F.col("time") > "2025-01-01T00:00:00Z")).select(paths.path_text(F.col("value")).alias("path")), ["/home", "/photos"],
        json.loads(c.where("attribute = 'prov:host'").agg(F.min("value")).first()[0]), ["/home/2019"], ["*.zip"],
    )
)


def _over_grids(select: str) -> str:
    """SQL over the pictures made of the wide table of grids, which the training query states."""
    return (
        "WITH raster AS (" + training.SQL["p1_found"] + "), g AS (SELECT subject, width AS w, height AS h, greatest(depth, 1) AS d, alpha = 'true' AS a, color AS c FROM raster"
        " WHERE width BETWEEN 1 AND 16777216 AND height BETWEEN 1 AND 16777216 AND depth BETWEEN -1 AND 255) " + select
    )


SQL["image_raster"] = _over_grids("""SELECT subject, 'raster:width' AS attribute, (CASE w % 5 WHEN 1 THEN w % 65536 ELSE w END)::VARCHAR AS value FROM g
      UNION ALL SELECT subject, 'raster:height', (CASE w % 5 WHEN 1 THEN h % 65536 ELSE h END)::VARCHAR FROM g
    UNION ALL SELECT subject, 'raster:depth', (CASE WHEN w % 5 IN (1, 3) THEN 8 ELSE d END)::VARCHAR FROM g
      UNION ALL SELECT subject, 'raster:alpha', (a AND w % 5 <> 1 AND NOT (w % 5 = 2 AND c = 'indexed'))::VARCHAR FROM g
    UNION ALL SELECT subject, 'raster:color', '"' || CASE WHEN c = 'gray' AND w % 5 <> 3 OR c = 'indexed' AND w % 5 IN (0, 2) OR c = 'cmyk' AND w % 5 IN (1, 2) THEN c
      ELSE 'rgb' END || '"' FROM g WHERE NOT (w % 5 = 2 AND c = 'indexed' AND a)""")
SQL["image_xmp"] = _over_grids("""SELECT subject, unnest(['xmp:own-creator-tool', 'xmp:dc-subject', 'xmp:dc-subject', 'xmp:dc-creator', 'xmp:dc-title', 'xmp:xmp-mm-derived-from-xmp-mm-document-id']) AS attribute,
    unnest(['"t' || w || '"', '"a"', '"b' || w || '"', '["x' || w || '","y"]', '"t' || w || '"', '"i' || w || '"']) AS value FROM g""")
SQL["mime_sniff"] = _over_grids("SELECT subject, ['image/png', 'image/jpeg', 'image/tiff', 'image/webp', 'image/heif'][w % 5 + 1] AS mime FROM g")
SQL["image_iptc"] = _over_grids(
    "SELECT subject, unnest([" + ", ".join(f"'iptc:{n}'" for n in contracts.IPTC_NAMES.values()) + "]) AS attribute, unnest([" + ", ".join(f"'\"{n} é ' || w || '\"'" for n in contracts.IPTC_NAMES.values())
    + "]) AS value FROM g UNION ALL SELECT subject, 'iptc:keywords', '\"key\"' FROM g UNION ALL SELECT subject, 'iptc:caption-abstract', '\"long\"' FROM g"
)

_PLACED = training.SQL["p6_found"].partition(",\nn AS")[0] + """, l AS (SELECT s AS subject, min(row(lat, lon)) AS p FROM g GROUP BY s),
    c AS (SELECT subject, round_even(abs(p[1]) * 1000000, 0)::BIGINT AS la, round_even(abs(p[2]) * 1000000, 0)::BIGINT AS lo, p[1] < 0 AS south, p[2] < 0 AS west FROM l)"""
SQL["image_exif"] = _PLACED + """ SELECT subject, unnest(['exif:copyright', 'exif:exposure-bias-value', 'exif:flash', 'exif:gps-date-stamp', 'exif:gps-latitude', 'exif:gps-latitude-ref', 'exif:gps-longitude', 'exif:gps-longitude-ref', 'exif:gps-status',
    'exif:gps-version-id', 'exif:lens-specification', 'exif:make', 'exif:metering-mode', 'exif:orientation', 'exif:white-balance']) AS attribute, unnest(['["Ann","Bo"]', '"-1/3"', '16', '"2024:03:01"', '"' || la || '/1000000"', CASE
      WHEN south THEN '"S"' ELSE '"N"' END,
    '"' || lo || '/1000000"', CASE WHEN west THEN '"W"' ELSE '"E"' END, '"A"', '[2,3,0,0]', '["24/1","70/1","28/10","28/10"]', '"Ann"', '5', '6', '1']) AS value FROM c"""
SQL["image_geo"] = _PLACED + """ SELECT subject, 'geo:position' AS attribute, '{"latitude":' || (CASE WHEN south THEN -la
      ELSE la END / 1000000.0)::DOUBLE || ',"longitude":' || (CASE WHEN west THEN -lo ELSE lo END / 1000000.0)::DOUBLE || '}' AS value FROM c WHERE la <> 0 OR lo <> 0"""
