"""Messages: structure, header values, dates, text and attachments."""

from __future__ import annotations

import pytest

from claimwright.extract import contracts, headers, mime, sniff


def split(text):
    return mime.parse(text if isinstance(text, bytes) else text.encode())


def bodies(text):
    return [p.body for p in split(text).parts]


def test_parts_end_at_their_own_delimiters():
    nested = split("Content-Type: multipart/mixed; boundary=o\r\n\r\n--o\r\nContent-Type: multipart/mixed; boundary=i\r\n\r\n--i\r\n\r\nopen\r\n--o\r\nContent-Type: application/pdf; name=after.pdf\r\n\r\n%PDF\r\n--o--\r\n")
    assert [p.name for p in nested.parts] == [None, "after.pdf"] and nested.parts[0].parts[0].body == b"open" and nested.parts[1].body == b"%PDF"
    assert bodies("Content-Type: multipart/mixed; boundary=b\n\n--b\n\nfirst\n--b\n\nlast\n") == [b"first", b"last\n"]
    assert bodies("Content-Type: multipart/mixed; boundary=b\n\n--b\n\nfirst\n--b--\n--b\n\nafter the end\n--b--\n") == [b"first"]
    assert bodies("Content-Type: multipart/mixed; boundary=b\n\n--b\r\n--b\n\r\nbody\n--b--") == [b"", b"body"]
    assert len(bodies("Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\n\r\ninner\r\n--b--\r\n")) == 2
    assert bodies("Content-Type: multipart/mixed; boundary=b\n\n--b  \n\na --b\n--bb\nx\n--b--\n") == [b"a --b\n--bb\nx"]


@pytest.mark.parametrize("text", [
    "Content-Type: multipart/mixed\r\n\r\n--b\r\n\r\nno boundary\r\n", "Content-Type: multipart/mixed; boundary=b\r\n\r\nno delimiter\r\n",
    "Content-Type: multipart/mixed; boundary=b\r\n\r\ntext --b\r\n", "Content-Type: multipart/mixed; boundary=b\r\n\r\n--b--\r\nclosed\r\n", 'Content-Type: multipart/mixed; boundary=""\r\n\r\n--\r\n\r\nempty\r\n',
])
def test_what_cannot_be_split_is_one_part(text):
    assert split(text).parts is None


def test_heads():
    assert split("From: a@x.org\r\nSubject: no body").body == b""
    assert split("Content-Type: text/plain\r\nHello, no empty line.\r\n\r\nMore.").body == b"Hello, no empty line.\r\n\r\nMore."
    assert split("\r\nonly a body").body == b"only a body" and split(" leading fold\r\nFrom: a@x.org\r\n\r\nbody").fields == []
    assert [n for n, _ in split("Subject : obsolete\r\n folded\r\nX-A: b\r\n\r\nbody").fields] == ["subject", "x-a"]


def test_messages_within_messages():
    digest = split("Content-Type: multipart/digest; boundary=d\r\n\r\n--d\r\n\r\nFrom: a@x.org\r\n\r\nfirst\r\n--d\r\nContent-Type: text/plain\r\n\r\nnone\r\n--d--\r\n")
    assert [p.is_message for p in digest.parts] == [True, False] and digest.parts[0].body == b"From: a@x.org\r\n\r\nfirst"
    assert split("Content-Type: message/global\r\n\r\nFrom: a@x.org\r\n\r\nbody").is_message
    inner = "Content-Type: multipart/mixed; boundary=m\r\n\r\n--m\r\n\r\nmentions --o, never closes"
    outer = split(f"Content-Type: multipart/mixed; boundary=o\r\n\r\n--o\r\nContent-Type: message/rfc822\r\n\r\n{inner}\r\n--o--\r\n")
    assert [p.body.decode() for p in outer.leaves()] == [inner]
    deep = split("".join(f"Content-Type: multipart/mixed; boundary=b{k}\r\n\r\n--b{k}\r\n" for k in range(200)) + "\r\nin\r\n")
    levels = 0
    while deep.parts:
        deep, levels = deep.parts[0], levels + 1
    assert levels == mime.DEEPEST


def test_names_of_parts():
    for value, want in [
        ('attachment; filename="a b.pdf"', "a b.pdf"), ("attachment; filename=x.pdf", "x.pdf"), ("attachment; filename*=utf-8''%e2%82%ac.pdf", "€.pdf"), ("attachment; filename*0=long; filename*1=er.pdf", "longer.pdf"),
        ("attachment; filename*0*=iso-8859-1'de'M%FC; filename*1*=ller.pdf", "Müller.pdf"), ('attachment;\r\n\tfilename="=?utf-8?q?=C3=A9?=\r\n =?utf-8?q?.pdf?="', "é.pdf"), ('attachment; filename="a\\"b"', 'a"b'),
    ]:
        assert split(f"Content-Disposition: {value}\r\n\r\nx").name == want, value


def test_dates():
    utc = "2026-09-04T10:34:56Z"
    for text, want in [
        ("Fri, 4 Sep 2026 12:34:56 +0200", utc), ("Fri, 04 Sep 2026 07:34:56 -0500", "2026-09-04T12:34:56Z"), ("Fri, 4 Sep 2026 12:34:56 -0000", "2026-09-04T12:34:56Z"), ("Thu, 1 Jan 2026 00:30:00 +0100", "2025-12-31T23:30:00Z"),
        ("Sun, 28 Feb 2027 22:00:00 -0300", "2027-03-01T01:00:00Z"), ("Fri, 4 Sep 2026 12:34:56 +0200 (CEST (summer))", utc), ("4 Sep 2026 12:34:56 +0200", utc), ("Fr, 4 Sept 2026 12:34:56 +02:00 trailing", utc), ("fri,4 SEPTEMBER 26 12:34:56 mesz", utc),
        ("Fri, 4 Sep 126 12:34 GMT", "2026-09-04T12:34:00Z"), ("4 Sep 99 1:02 A", "1999-09-04T01:02:00Z"), ("Fri Apr 27 19:41:26 CEST 2007", "2007-04-27T17:41:26Z"), ("Fri Apr 27 19:41:26 2007", "2007-04-27T19:41:26"),
        ("31 Dec 2016 23:59:60 +0000", "2016-12-31T23:59:60Z"), ("4 Sep 2026 12:34:56", "2026-09-04T12:34:56"), ("4 Sep 2026 12:34:56 IST", "2026-09-04T12:34:56"), ("4 Sep 2026 12:34:56 +0-200", "2026-09-04T12:34:56"),
        ("4 Sep 2026 12:34:56 J", "2026-09-04T12:34:56"), ("31 Feb 2026 12:34:56 +0200", None), ("4 Sep 1850 12:34:56 +0200", None), ("soon", None), ("", None), ("4 Sep 2026", None), ("4 Sep 2026 24:00:00 Z", None), ("4 Se 2026 12:00 Z", None),
    ]:
        assert headers.moment(text) == want, text


def test_addresses():
    read = lambda text: headers.read("to", text.encode())
    assert read("Team: a@example.com, B <b@example.com>;, c@example.com")[0] == ["<a@example.com>", "B <b@example.com>", "<c@example.com>"]
    assert read("undisclosed-recipients:;") == ([], [])
    assert read("<John Doe>, a@example.org") == (["<a@example.org>"], ["not an address: <John Doe>"])
    assert read("John Doe")[1] == ["no address: John Doe"] and read("<Root>")[0] == ["<root>"] and read("root")[1] == ["no address: root"] and read("<>")[1] == ["the address is empty: <>"]
    assert read('"Doe, J\\"r" <J@X.org>, k@x.org (Kim (K))')[0] == ['Doe, J"r <j@x.org>', "Kim (K) <k@x.org>"]
    assert read("=?utf-8?q?J=C3=BCrg?= <J@x.org>")[0] == ["Jürg <j@x.org>"]
    assert read("=?iso-8859-1?Q?M=FCller?=\r\n <=?iso-8859-1?Q?M=FCller=40example=2Ecom?=>, b@example.com") == (
        ["<b@example.com>"], ["the address in angle brackets is MIME-encoded, which RFC 2047 does not allow: Müller <Müller@example.com>"])
    assert read('"0123 456-789"@fax.example.com')[0] == ['<"0123 456-789"@fax.example.com>'] and read("a b@x.org")[1] == ["not an address: a b@x.org"]


def test_ids():
    assert headers.ids("<a@b> (note) <c d> <e") == ["a@b", "c d", "e"] and headers.ids("word") == ["word"] and headers.ids("two words") == [] and headers.one_id(" no brackets ") == "no brackets" and headers.one_id("<>") is None
    assert headers.read("references", b"nothing here") == ([], ["no message id: nothing here"]) and headers.read("date", b"irgendwann") == ([], ["not a date: irgendwann"])


LETTER = b"From: a@x.org\r\nTo: B <b@x.org>\r\nDate: Fri, 4 Sep 2026 12:34:56 +0200\r\nSubject: =?utf-8?q?a=0Ab?=\r\n"


def text_of(rest):
    return [c.decode() for c, _ in contracts.mail_text(LETTER + rest).files]


HEAD = "From     a@x.org\nTo       B <b@x.org>\nDate     Fri, 4 Sep 2026 12:34:56 +0200\nSubject  a b\n"


def test_text():
    assert text_of(b"\r\n  \r\n") == [HEAD] and text_of(b"\r\none\r\ntwo") == [HEAD + "\none\ntwo"]
    many = b"Content-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>page</p>\r\n--b\r\nContent-Type: text/plain\r\n\r\n%s\r\n--b--"
    assert text_of(many % b"plain") == [HEAD + "\nplain"] and text_of(many % b" ") == [HEAD + "\npage"]
    assert text_of(b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\none\r\n--b\r\nContent-Type: text/plain; name=n\r\n\r\nfile\r\n--b\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ntw\xf6\r\n--b--") == [HEAD + "\none\ntwö"]
    assert contracts.mail_text(b"no mail").files == []


def test_attachments():
    rest = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: message/rfc822\r\n\r\nFrom: c@x.org\r\n\r\nin\r\n--b\r\nContent-Type: image/png; name=\"dir/i.png\"\r\nContent-ID: <i@x>\r\nContent-Transfer-Encoding: base64\r\n\r\naGVs\r\nbG8=\r\n--b\r\nContent-Disposition: attachment; filename=..\r\n\r\nx\r\n--b--"
    (inner, a), (picture, b), (dots, c) = contracts.mail_attachments(LETTER + rest).files
    assert inner == b"From: c@x.org\r\n\r\nin" and a == [("file:mime", "message/rfc822")]
    assert picture == b"hello" and dict(b)["file:name"] == "i.png" and dict(b)["mail:content-id"] == "i@x" and dict(b)["file:mime"] == "image/png"
    assert dots == b"x" and c == [("file:mime", "application/octet-stream")] and contracts.mail_attachments(b"no mail").files == []


def test_headers_and_kinds():
    found = contracts.mail_headers(LETTER + b"Bcc: x\r\nMessage-ID: <i@x>\r\n\r\n")
    assert found.facts == [("file:mime", "message/rfc822"), ("mail:from", "<a@x.org>"), ("mail:to", "B <b@x.org>"), ("mail:date", "2026-09-04T10:34:56Z"), ("mail:subject", "a\nb"), ("mail:message-id", "i@x")] and found.remarks == ["mail:bcc not recorded, no address: x"]
    assert contracts.mail_headers(b"From a@x.org Fri\n" + LETTER + b"\r\n").facts == [("file:mime", "application/mbox")] and contracts.mail_headers(b"text").facts == []
    assert not sniff.looks_like_mail(b"Content-Type: a\r\nMIME-Version: 1.0\r\n\r\n") and sniff.looks_like_mail(b"Bcc: a\nX: " + b"y" * 100_000 + b"\nDate: b\n\n")


def test_named_contracts():
    assert [c.source for c in contracts.named(["mail:headers", "packed"])] == ["extractor:mail-headers/1", "extractor:packed-list/1", "extractor:packed-unpack/1"]
    for bad in (["mail", "mail:text"], ["nothing"], ["mail:"], ["a b"]):
        with pytest.raises(ValueError):
            contracts.named(bad)


def test_work_modes(spark, claims, rows):
    a, b = "a" * 64, "b" * 64
    df = claims((a, "file:mime", '"text/plain"', "2024-03-01T00:00:00Z", "1"), (b, "file:mime", '"text/plain"', "2024-03-01T00:00:00Z", "2"), (b, "prov:examined", '"extractor:text-stats/1"', "2024-03-01T00:00:00Z", "3"))
    runs = contracts.named(["text:stats"])
    assert [s for s, _ in rows(contracts.work(df, runs))] == [a] and [s for s, _ in rows(contracts.work(df, runs, full=True))] == [a, b]
    chosen = spark.createDataFrame([("c" * 64,)], "subject string")
    assert [s for s, _ in rows(contracts.work(df, runs, chosen))] == ["c" * 64]
    files = spark.createDataFrame([(a, b"x y"), (b, b"z")], "subject string, content binary")
    assert {(x.subject, x.attribute, x.value) for x in contracts.run(df, files, runs).collect()} == {(a, "text:lines", "1"), (a, "text:words", "2")}
