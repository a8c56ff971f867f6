"""Log text, streaming intake, extractors, scalar and mail functions."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from claimwright.extract import contracts, pdf
from claimwright.extract.limited import limited
from claimwright.functions import grammar, mail, names
from claimwright.plans import record as r
from claimwright.queries import extraction, reference
from claimwright.sources import files, log
from claimwright.streaming import intake

T = "2024-03-0{}T00:00:00Z".format
A = "a" * 64
RUN = "12345678-1234-1234-1234-123456789abc"


def line(**change):
    claim = {"subject": A, "attribute": "user:tag", "value": "x", "time": T(1), "source": "user", "run": RUN} | change
    return json.dumps({k: v for k, v in claim.items() if v != "-"}, separators=(",", ":"))


def test_lines_are_read_strictly(spark):
    cases = {
        line(): None, line(run="-"): None, line(value="-", retracts=["1"]): None, line(value={"b": 1}): None, "{broken": "no object", line(extra=1): "unknown member", line(value=None): "null value",
        line(retracts=["1"]): "both", line(value="-"): "neither", line(value="-", retracts=[]): "empty retracts", line(subject="zz"): "field", line(time="2024-02-30T00:00:00Z"): "field", line(run="r"): "field", line(source="a b"): "field",
    }
    got = log.parse_lines(spark.createDataFrame([(x,) for x in cases], "value string")).collect()
    assert {x.line: x.fault for x in got} == cases
    assert all(x.cid == hashlib.sha256(x.line.encode()).hexdigest() for x in got)


def test_all_claims_round_trip(spark, claims):
    values = ['"é\\"q\\\\\\n"', "1.50", "2.268e3", "-0", '{"longitude":-81.5690,"latitude":1e1,"a":[1.0,null]}', '{"value":{"b":"}"}}', "true", '"2e3"', "[]"]
    rows = [(A, "user:tag", v, T(1), "") for v in values] + [(A, "user:tag", ["B" * 64, "c" * 64], T(2), ""), (A, "user:tag", '"late"', "2024-03-01T00:00:00.5Z", "")]
    df = claims(*rows).withColumn("run", F.lit(RUN)).withColumn("cid", grammar.claim_id())
    want = {(x.cid, x.value, tuple(y.lower() for y in x.retracts or ()), "field" if "." in x.time else None) for x in df.collect()}
    got = extraction._round_trip(df.unionByName(df)).collect()
    assert len(got) == len(rows) and {(x.cid, x.value, tuple((x.retracts or "").split()), x.fault) for x in got} == want
    spaced = log.parse_lines(spark.createDataFrame([(line().replace('"x"', ' { "b" : 1.0 } ').replace(",", " , "),)], "value string")).first()
    assert spaced.fault is None and spaced.value == '{ "b" : 1.0 }'


def test_chain_walk():
    assert log.chain([("a", None), ("b", "a"), ("c", "b")], "c") == ["a", "b", "c"]
    with pytest.raises(LookupError, match="b names it"):
        log.chain([("b", "x")], "b")
    with pytest.raises(ValueError):
        log.chain([("a", "b"), ("b", "a")], "a")


def test_stream_equals_batch(spark, claims, tmp_path, rows):
    feed = [(A, "user:tag", ["c1", "c7"], T(9), "r1"), *[(A, "user:tag", f'"{i}"', T(1), f"c{i}") for i in range(9)], (A, "user:tag", '"3"', T(1), "c3")]
    df = claims(*feed)
    for part in (feed[6:], feed[:3]):
        claims(*part).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        intake.follow(spark, str(tmp_path / "landing"), df.schema, str(tmp_path / "into"), str(tmp_path / "state"), 1).awaitTermination()
    claims(*feed[3:6]).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    intake.follow(spark, str(tmp_path / "landing"), df.schema, str(tmp_path / "into"), str(tmp_path / "state")).awaitTermination()
    assert rows(intake.standing_now(spark, str(tmp_path / "into")).select("cid", "value")) == rows(r.live(df).select("cid", "value"))


def test_file_tree(spark, tmp_path):
    (tmp_path / "d" / "cache").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_bytes(b"x")
    (tmp_path / "d" / "cache" / "b.txt").write_bytes(b"y")
    got = files.file_tree(spark, str(tmp_path / "d"), ("cache",)).collect()
    assert [(x.length, x.subject) for x in got] == [(1, hashlib.sha256(b"x").hexdigest())]


# -- extractors

MESSAGE = b"""From: =?utf-8?q?J=C3=BCrg?= <J@X.org>\r\nTo: a@b.c, "D, E" <e@f.g>\r\nSubject: one\r\n two\r\nDate: Fri, 1 Mar 2024 10:00:00 +0100\r
Content-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<p>Hi <b>you</b><script>no</script></p>\r\n--q\r
Content-Disposition: attachment; filename="f.txt"\r\n\r\ndata\r\n--q--\r\n"""


def found(source, data):
    return contracts.CONTRACTS[source].read(data)


def test_mail():
    facts = found("extractor:mail-headers/1", MESSAGE).facts
    assert ("mail:subject", "one two") in facts and ("mail:from", "Jürg <j@x.org>") in facts and ("mail:to", "D, E <e@f.g>") in facts
    (data, own), = found("extractor:mail-attachments/1", MESSAGE).files
    assert data.strip() == b"data" and ("file:path", "@f.txt") in own
    (text, _), = found("extractor:mail-text/1", MESSAGE).files
    assert b"Hi you" in text and b"no" not in text and text.startswith("From     Jürg".encode())


def test_html_text_by_brute_force(spark, tmp_path):
    pieces = {"a": "a", " ": " ", "\t": " ", "\n": "\n", "<b>": "", "</b>": "", "<p>": "\n", "<br/>": "\n", "&amp;": "&", "&lt;": "<", "é": "é", "-": "-", "'": "'", "& ": "& ", "<!-- c -->": "", "<script>z</script>": "", "<style>z{}</style>": ""}

    def shown(text):
        lines = [" ".join(x for x in line.split(" ") if x) for line in text.split("\n")]
        return "\n".join(x for x in lines if x)

    cases = [(k, "".join(c), shown("".join(pieces[x] for x in c))) for k, c in enumerate(itertools.product(pieces, repeat=3))]
    assert [(t, contracts.html_text(t)) for _, t, w in cases if contracts.html_text(t) != w] == []
    assert contracts.html_text("x &amp") == "x &" and contracts.html_text("a & b") == "a & b"
    spark.createDataFrame([(k, t) for k, t, _ in cases] + [(-1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.shown for x in extraction.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert got == {k: w for k, _, w in cases} | {-1: None}


def test_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b/x.txt", "1")
        z.writestr("a.txt", "2")
        z.writestr("dir/", "")
    assert found("extractor:packed-list/1", out.getvalue()).facts == [("packed:path", "@a.txt"), ("packed:path", "@b/x.txt")]
    assert sorted(d for d, _ in found("extractor:packed-unpack/1", out.getvalue()).files) == [b"1", b"2"]


def test_pictures_and_documents():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBB", 4, 3, 8, 6) + b"\0" * 7
    assert dict(found("extractor:image-raster/3", png).facts) == {"raster:width": 4, "raster:height": 3, "raster:depth": 8, "raster:alpha": True, "raster:color": "rgb"}
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HHB", 30, 40, 3) + b"\0" * 12
    assert dict(found("extractor:image-raster/3", jpeg).facts)["raster:width"] == 40
    iptc = b"\xff\xd8" + b"\x1c\x02\x19\0\x03key" + b"\x1c\x02\x19\0\x01\xe9" + b"\x1c\x02\x19\0\x03key" + b"\0" * 6
    assert found("extractor:image-iptc/1", iptc).facts == [("iptc:keywords", "key"), ("iptc:keywords", "é")]


def test_pdf_objects():
    whole = pdf.Document(b"%PDF\n1 0 obj << /A (old) >> endobj 1 0 obj << /A [1 -.5 (a\\(b\\)(c)\\101\\\nd\\n) <4 1> /N#20x true null 2 0 R] % note\n >> endobj 2 0 obj (x) endobj")
    a = whole.objects[1]["A"]
    assert a[:6] == [1, -0.5, b"a(b)(c)Ad\n", b"A", "N x", True] and a[6] is None and whole.at(a[7]) == b"x"
    assert pdf.text(b"\xfe\xff\0\xe9") == "é" and pdf.text(b"\xef\xbb\xbf\xc3\xa9") == "é" and pdf.text(b"\x80\x92\xa0\x18\xe9") == "•™€˘é"
    assert contracts.pdf_info(b"trailer << /Info << /Title (a) /CreationDate (D:1) /No_Name (x) /N 3 >> >>").facts == [("pdf:title", "a"), ("pdf:creation-date", "D:1")]
    for broken in (b"", b"%PDF", b"1 0 obj << /A", b"1 0 obj << /Length 9 >> stream\nabc", b"[" * 5000, b"1 0 obj " + b"[" * 5000):
        assert contracts.pdf_info(broken).facts == [] and contracts.pdf_attachments(broken).files == []
    assert contracts.pdf_info(b"trailer << /Encrypt 1 0 R /Info << /Title (a) >> >>").facts == []


def test_memory_is_bounded_by_size():
    assert limited(lambda d: len(d), b"abc") == 3
    with pytest.raises(ValueError, match="memory"):
        limited(lambda d: len(bytearray(1 << 31)), b"abc")
    with pytest.raises(ValueError, match="status"):
        limited(lambda d: os.kill(os.getpid(), 9), b"")


def test_noise_is_told():
    assert contracts.junk_verdict("abc") is None and contracts.junk_verdict("a\x01\x02\ue000") == "75% of the extracted characters are invalid; text discarded"


def test_faults_leave_no_receipt(spark, rows):
    df = spark.createDataFrame([("good", bytearray(b"a b\nc")), ("none", None)], "subject string, content binary")
    answers = contracts.examine(df, contracts.CONTRACTS["extractor:text-stats/1"])
    claims = rows(contracts.recorded(answers, T(1), "r").select("subject", "attribute", "value"))
    assert claims == [("good", "prov:examined", '"extractor:text-stats/1"'), ("good", "text:lines", "2"), ("good", "text:words", "3")]
    nothing = contracts.examine(df.where("subject = 'good'"), contracts.CONTRACTS["extractor:packed-list/1"])
    assert rows(contracts.recorded(nothing, T(1), "r").select("subject", "attribute", "value")) == [("good", "prov:examined", '"extractor:packed-list/1"')]
    bad = contracts.examine(df.where("subject = 'good'"), contracts.Contract("extractor:bad/1", (), lambda data: 1 // 0))
    assert bad.first().error.startswith("ZeroDivision") and contracts.recorded(bad, T(1), "r").count() == 0


def test_rounds_reach_the_innermost_files(spark, rows):
    def mail(name, data):
        head = f"From: a@b.c\r\nSubject: {name}\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nbody of {name}\r\n"
        return (head + f'--q\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment; filename="{name}"\r\n\r\n').encode() + base64.b64encode(data) + b"\r\n--q--\r\n"

    def packed(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo(name), data)
        return out.getvalue()

    digest = lambda data: hashlib.sha256(data).hexdigest()
    leaf = b"one two\nthree"
    inner = mail("leaf.txt", leaf)
    box = packed("inner.eml", inner)
    outer = mail("box.zip", box)
    top = packed("outer.eml", outer)
    files = spark.createDataFrame([("top", bytearray(top)), ("again", bytearray(outer)), ("odd", bytearray(b"PK\x03\x04")), ("none", None)], "subject string, content binary")
    got = contracts.recorded(contracts.settle(files), T(1), "r").select("subject", "attribute", "value").collect()
    facts = {(x.subject, x.attribute, x.value) for x in got}
    assert {("top", "packed:path", '"@outer.eml"'), (digest(outer), "file:mime", '"message/rfc822"'), (digest(box), "prov:origin", f'"{digest(outer)}"'), (digest(box), "prov:origin", '"again"')} <= facts
    assert {(digest(inner), "mail:subject", '"leaf.txt"'), (digest(leaf), "text:words", "3"), (digest(leaf), "text:lines", "2"), (digest(leaf), "prov:origin", f'"{digest(inner)}"')} <= facts
    text = digest(b"From     a@b.c\nSubject  leaf.txt\n\nbody of leaf.txt")
    assert {(text, "prov:origin", f'"{digest(inner)}"'), (text, "text:words", "7"), (text, "prov:examined", '"extractor:text-stats/1"')} <= facts
    assert {x[1] for x in facts if x[0] == "odd"} == {"prov:examined"} and not [x for x in facts if x[0] == "none"]


def test_rounds_without_an_end_are_an_error(spark):
    minting = contracts.Contract("extractor:mint/1", ("text/plain",), lambda data: contracts.Findings(files=[(data + b"x", [("file:mime", "text/plain")])]))
    with pytest.MonkeyPatch.context() as m, pytest.raises(RuntimeError, match="3 rounds"):
        m.setattr(contracts, "MOST_ROUNDS", 3)
        contracts.settle(spark.createDataFrame([("a", bytearray(b"x"))], "subject string, content binary"), [minting])


# -- functions


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    lit = F.lit
    for column, want in [
        (names.basename(lit("a/b\\c.txt ")), "c.txt"), (names.basename(lit("a/..")), None), (names.kebab(lit("XMPToolkitName2Go")), "xmp-toolkit-name2-go"), (names.legal(lit(" Ünder_score! ")), "nder-score"), (names.legal(lit("!!")), None),
        (names.byte_count(lit(1023)), "1023 B"), (names.byte_count(lit(1536)), "1.5 KiB"), (names.byte_count(lit(5 << 40)), "5.0 TiB"), (names.folder_of(lit("acc:a:b")), "a:b"), (names.folder_of(lit("acc")), None),
        (names.label(lit("\\Inbox")), "/Inbox"), (names.compare_key(lit(" <A b@C> ")), "ab@c"), (names.message_ids(lit("<a> x <b c> <")), ["a", "b c"]), (names.epoch(lit("1969-12-31T00:00:00Z")), None), (names.epoch(lit("2024-03-01T00:00:00.75")), 1709251200), (names.byte_count(lit(4096)), "4.0 KiB"), (names.byte_count(lit(54_597)), "53 KiB"), (names.byte_count(lit(3_971_934_208)), "3.7 GiB"), (names.byte_count(lit(3 << 50)), "3.0 PiB"), (names.whole_byte_count(lit(1 << 30)), "1 GiB"), (names.whole_byte_count(lit(1025)), "1025 bytes"), (names.whole_byte_count(lit(0)), "0 bytes"),
        (names.modified_text(lit(0), lit(500_000_000)), "1970-01-01T00:00:00.5Z"), (names.modified_text(lit(1), lit(0)), "1970-01-01T00:00:01Z"), (names.blank(lit(" 　\n")), True), (names.junk_percent(lit("ab\x01 �")), 50),
        (names.junk_percent(lit("  ")), None), (names.degrees(lit("48/1 30/1 0/1"), lit("S")), -48.5), (names.degrees(lit("91/1 0/1 0/1"), lit("N")), None), (names.degrees(lit("1/0 0/1"), lit("N")), None), (names.line_breaks(lit("a\r\nb\rc")), "a\nb\nc"),
    ]:
        assert value(spark, column) == want, want


def test_blank_texts_of_any_letters(spark, tmp_path):
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    texts = ["", "".join(map(chr, spaces)), *map(chr, spaces), "\u3000é", "日本", "\u200b", "\ufeff", "\u180e", "a", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.blank for x in reference.QUERIES["blank_text"](spark, str(tmp_path)).collect()}
    assert got == {k: k < len(spaces) + 2 for k, t in enumerate(texts) if t is not None}


def test_all_degrees_and_long_names(spark, claims, tmp_path):
    spark.range(85, 95).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = {x.k: x.degrees for x in extraction.QUERIES["geo_position"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(85, 95)) and got[89] == pytest.approx(-(89 + 29 / 60 + 0.89 / 3600))
    long = ["é" * 130, "a" * 239 + "é", "b" * 240, "c" * 300 + ".jpeg"]
    claims(*[(A, "user:tag", json.dumps(x, ensure_ascii=False), T(1), f"c{i}") for i, x in enumerate([*long, "short"])]).write.parquet(str(tmp_path / "claims.parquet"))
    names_ = {x.name: x.short for x in extraction.QUERIES["fits_names"](spark, str(tmp_path)).collect()}
    assert set(names_) > {*long, "short"} and names_["short"] == "short" and names_["b" * 240] == "b" * 240
    assert names_["é" * 130] == "é" * 120 and names_["a" * 239 + "é"] == "a" * 239 and names_["c" * 300 + ".jpeg"] == "c" * 235 + ".jpeg"


def test_grammar(spark):
    lit = F.lit
    assert value(spark, grammar.valid_subject(lit("A" * 96))) and not value(spark, grammar.valid_subject(lit("a" * 65)))
    assert value(spark, grammar.valid_time(lit("2024-02-29T23:59:60Z"))) and not value(spark, grammar.valid_time(lit("2023-02-29T00:00:00Z")))
    assert value(spark, grammar.json_quote(lit('a"\\\né'))) == '"a\\"\\\\\\né"'
    assert [value(spark, grammar.json_type(lit(x))) for x in ('"a"', "-1", "true", "[]", "{}", "null", "x")] == ["string", "number", "boolean", "array", "object", "null", None]
    assert grammar.canonical_text('{"b": 1.50, "a": [1e3, "\\u00e9", null]}') == '{"a":[1e3,"é",null],"b":1.50}'
    assert grammar.canonical_text("null") is None and grammar.canonical_text("{") is None and grammar.canonical_text(None) is None
    assert grammar.part_text('{"a":{"b":[1.50,{"c":"x"}]}}', "a.b.0") == "1.50" and grammar.part_text('{"a":null}', "a") == "null" and grammar.part_text('{"a":1}', "a.b") is None


def test_mail_functions(spark):
    for name in ("Entwürfe", "a&b", "日本/語", "plain", "~peter/mail/台北"):
        assert mail.utf7_decode(mail.utf7_encode(name)) == name
    assert mail.utf7_encode("台北") == "&U,BTFw-" and mail.utf7_decode("a&-b") == "a&b" and mail.utf7_decode("&!!-") is not None
    assert mail.folder_key("inbox") == "INBOX" and mail.folder_key("é") == "é" and mail.folder_key(None) is None
    assert mail.fitted("a\x00b" + "é" * 200 + ".jpeg").endswith(".jpeg") and len(mail.fitted("é" * 200 + ".jpeg").encode()) <= 240
    assert mail.address_list("Group: a@B.c, \"X\" <y@z.w>;, broken") == ["<a@b.c>", "X <y@z.w>"] and mail.address_faults("broken") == ["no address: broken"] and mail.address_list(None) == []
    assert mail.decoded_text("=?iso-8859-1?q?=E9?= =?bad") is not None
    assert value(spark, mail.mail_date(F.lit("Fri,\r\n 1 Mar 2024 10:00:00 +0100 (x)"))) == "2024-03-01T09:00:00Z"
