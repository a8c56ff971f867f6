"""Extractors: contracts that read a file's bytes and find facts or derived files.

A contract has a source name, the mimes it takes and a function of bytes. All run in
``mapInPandas`` over (subject, content): a fault of one file gives an ``error`` row and no
receipt; nothing else of its answer is kept. Receipts come from the rows without error.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import shutil
import struct
import subprocess
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimwright.extract import headers, images, mime, pdf, sniff
from claimwright.extract.limited import limited
from claimwright.functions.mail import fitted
from claimwright.operators import ask
from claimwright.plans.skew import union_all
from claimwright.plans.tables import work_folder

ANSWER = "subject string, source string, derived string, attribute string, value string, error string"
#: An answer of a round: the kind under which the subject was examined, and on one row per derived file its kind and bytes.
ROUND = ANSWER + ", kind string, mime string, content binary"
MOST_UNPACKED = 1 << 30
MOST_ROUNDS = 32
#: Bytes of derived files that a Python worker gathers before it hands them on.
HANDED_ON = 8 << 20


@dataclass
class Findings:
    """What a contract found: facts, and derived files with facts of their own."""

    facts: list[tuple[str, object]] = field(default_factory=list)
    files: list[tuple[bytes, list[tuple[str, object]]]] = field(default_factory=list)
    #: What could not be recorded, and why; remarks are no facts.
    remarks: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Contract:
    source: str
    mimes: tuple[str, ...]
    read: Callable[[bytes], Findings]


@lru_cache(maxsize=1)
def _message(data: bytes) -> mime.Entity:
    """The structure of *data*, found once for the contracts that read it one after the other; none changes it."""
    return mime.parse(data)


def mail_headers(data: bytes) -> Findings:
    """The kind of a message, and each value of its recorded headers; of a mailbox its kind only."""
    out = Findings()
    if sniff.looks_like_mbox(data):
        out.facts.append(("file:mime", "application/mbox"))
    elif sniff.looks_like_mail(data):
        out.facts.append(("file:mime", "message/rfc822"))
        for name, raw in _message(data).fields:
            if name in headers.RECORDED:
                values, remarks = headers.read(name, raw)
                out.facts += [(f"mail:{name}", v) for v in values]
                out.remarks += [f"mail:{name} not recorded, {r}" for r in remarks]
    return out


def mail_attachments(data: bytes) -> Findings:
    """Named parts and attached messages as derived files, of the kind that they declare."""
    out = Findings()
    if not sniff.looks_like_mail(data):
        return out
    for part in _message(data).leaves():
        if part.is_attachment:
            kind = part.kind or ("message/rfc822" if part.is_message else "application/octet-stream")
            facts = [("file:mime", kind)]
            name = re.split(r"[/\\\\]", part.name)[-1].strip() if part.name else ""
            if name not in ("", ".", ".."):
                facts += [("file:name", name), ("file:path", "@" + part.name)]
            own = headers.one_id(part.last("content-id") or "")
            out.files.append((part.decoded(), facts + ([("mail:content-id", own)] if own else [])))
    return out


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """The text of a page, line by line, without scripts and styles; null of null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()  # what waits for the end of an entity or a tag is text too
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f]+", " ", "".join(parser.parts))).strip()


_HEADED = ("From", "To", "Cc", "Date", "Subject")


def _blank(text: str) -> bool:
    return not text.strip()


def _shown(entity: mime.Entity) -> str:
    """The text of a part that is body: plain, or of a page; of alternatives the first plain one that says something, else the first that does."""
    if entity.parts is None:
        if entity.is_attachment or entity.kind not in (None, "text/plain", "text/html"):
            return ""
        text = mime.as_text(entity.decoded(), entity.given.get("charset"))
        return html_text(text) if entity.kind == "text/html" else re.sub("\r\n?", "\n", text)
    if entity.kind == "multipart/alternative":
        plain = (p for p in entity.parts if p.parts is None and p.kind == "text/plain")
        shown = next((t for t in map(_shown, plain) if not _blank(t)), None)
        return shown if shown is not None else next((t for t in map(_shown, entity.parts) if not _blank(t)), "")
    out = ""
    for text in map(_shown, entity.parts):
        if text:
            out += ("\n" if out and not out.endswith("\n") else "") + text
    return out


def mail_text(data: bytes) -> Findings:
    """The headers of the letter, a blank line and its readable body as one derived text."""
    if not sniff.looks_like_mail(data):
        return Findings()
    root = _message(data)
    lines = [(n, " ".join(mime.unfolded(raw).split())) for n in _HEADED for own, raw in root.fields if own == n.lower()]
    head, body = "".join(f"{n:<9}{v}\n" for n, v in lines if v), _shown(root)
    text = head + ("\n" if head and not _blank(body) else "") + ("" if _blank(body) else body)
    return Findings(files=[(text.encode("utf-8", "replace"), [("file:mime", "text/plain")])]) if text else Findings()


def _archive(data: bytes, then: Callable[[zipfile.ZipFile], Findings]) -> Findings:
    """*then* of an archive; of a document in an archive's clothes its sharper kind only, of no archive nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            own = sniff.container_kind(z)
            return then(z) if own is None else Findings([("file:mime", own)] if own else [])
    except zipfile.BadZipFile:
        return Findings()


def packed_list(data: bytes) -> Findings:
    """The place of each file in an archive."""
    return _archive(data, lambda z: Findings([("packed:path", "@" + n) for n in sorted({i.filename for i in z.infolist() if not i.is_dir()})]))


def packed_unpack(data: bytes) -> Findings:
    """Entries as derived files of the kind that their bytes tell. Entries without a name, encrypted, damaged and oversized ones leave a note, links nothing."""
    return _archive(data, _unpacked)


def _unpacked(z: zipfile.ZipFile) -> Findings:
    out, stays = Findings(), lambda entry, why: out.facts.append(("prov:note", f"entry {entry} not unpacked: {why}"))
    for entry in z.infolist():
        if entry.is_dir() or entry.external_attr >> 28 == 0xA:
            continue
        name = re.split(r"[/\\\\]", entry.filename)[-1].strip()
        if name in ("", ".", "..") or not fitted(name):
            stays(json.dumps(entry.filename, ensure_ascii=False), "no file name")
        elif entry.flag_bits & 1:
            stays(entry.filename, "encrypted")
        else:
            try:
                with z.open(entry) as f:
                    content = f.read(MOST_UNPACKED + 1)  # what an entry announces need not be what it holds
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError) as e:
                stays(entry.filename, str(e) or "damaged")
                continue
            if len(content) > MOST_UNPACKED:
                stays(entry.filename, "larger than 1 GiB")
            else:
                out.files.append((content, [("file:mime", sniff.kind(content)), ("file:name", name), ("file:path", "@" + entry.filename)]))
    return out


def image_raster(data: bytes) -> Findings:
    """Width, height, depth, alpha and color as the header of a picture has them."""
    found = images.grid(data)
    if found is None:
        return Findings()
    facts = [("raster:width", found.width), ("raster:height", found.height), ("raster:depth", found.depth), ("raster:alpha", found.alpha)]
    return Findings(facts + ([("raster:color", found.color)] if found.color else []))


def image_xmp(data: bytes) -> Findings:
    """The properties of a picture's XMP packets; fields of structures are named by their path."""
    found = images.Properties()
    for packet in images.packets(data):
        found.read(packet)
    return Findings(found.facts())


# The data sets of record 2 by number, in the format's names.
_DATASETS = {
    3: "Object Type Reference", 4: "Object Attribute Reference", 5: "Object Name", 7: "Edit Status", 8: "Editorial Update", 10: "Urgency", 12: "Subject Reference", 15: "Category",
    20: "Supplemental Category", 22: "Fixture Identifier", 25: "Keywords", 26: "Content Location Code", 27: "Content Location Name", 30: "Release Date", 35: "Release Time",
    37: "Expiration Date", 38: "Expiration Time", 40: "Special Instructions", 42: "Action Advised", 45: "Reference Service", 47: "Reference Date", 50: "Reference Number", 55: "Date Created",
    60: "Time Created", 62: "Digital Creation Date", 63: "Digital Creation Time", 65: "Originating Program", 70: "Program Version", 75: "Object Cycle", 80: "By-line", 85: "By-line Title",
    90: "City", 92: "Sub-location", 95: "Province/State", 100: "Country/Primary Location Code", 101: "Country/Primary Location Name", 103: "Original Transmission Reference", 105: "Headline",
    110: "Credit", 115: "Source", 116: "Copyright Notice", 118: "Contact", 120: "Caption/Abstract", 121: "Local Caption", 122: "Writer/Editor", 130: "Image Type", 131: "Image Orientation",
    135: "Language Identifier",
}
IPTC_NAMES = {n: re.sub(r"[^a-z0-9]", "-", name.lower()) for n, name in _DATASETS.items()}


def _press_block(data: bytes) -> bytes:
    """Where a picture keeps its IPTC record: a JPEG's APP13 segments, or bare behind its start; a TIFF's tag 33723 or 34377."""
    if data[:2] == b"\xff\xd8":
        if data[2:3] == b"\x1c":
            return data[2:]
        at, out = 2, b""
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            if data[at + 1] == 0xFF or data[at + 1] == 1 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 1 if data[at + 1] == 0xFF else 2
                continue
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            if data[at + 1] == 0xED and body.startswith(b"Photoshop 3.0\0"):
                out += body[14:]
            at += 2 + size
        return out
    if data[:4] in (b"II*\0", b"MM\0*"):
        from claimwright.extract.exif import entries

        found = {t: (kind, raw) for t, kind, _, raw in entries(data) if t in (33723, 34377)}
        kind, raw = found.get(33723) or found.get(34377) or (1, b"")
        if kind == 4 and data[:2] == b"II":  # old writers' words in this order hold the bytes turned round
            return b"".join(raw[k : k + 4][::-1] for k in range(0, len(raw), 4))
        return raw
    return b""


def _resource(block: bytes, wanted: int) -> bytes:
    """One resource of a run of Photoshop's image resources."""
    at = 0
    while block[at : at + 4] == b"8BIM" and at + 12 <= len(block):
        sized = at + (8 + block[at + 6]) // 2 * 2
        start = sized + 4
        size = int.from_bytes(block[sized:start], "big")
        if start > len(block) or start + size > len(block):
            break
        if int.from_bytes(block[at + 4 : at + 6], "big") == wanted:
            return block[start : start + size]
        at = start + size + size % 2
    return b""


def _data_sets(record: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(record, number, bytes) in order; a length with the high bit is the length of the length."""
    at = 0
    while at + 5 <= len(record) and record[at] == 0x1C:
        number, size, start = (record[at + 1], record[at + 2]), struct.unpack(">H", record[at + 3 : at + 5])[0], at + 5
        if size & 0x8000:
            start += size & 0x7FFF
            if size & 0x7FFF > 4 or start > len(record):
                return
            size = int.from_bytes(record[at + 5 : start], "big")
        if start + size > len(record):
            return
        yield *number, record[start : start + size]
        at = start + size


def image_iptc(data: bytes) -> Findings:
    """Data sets of IPTC record 2, each value once."""
    block = _press_block(data)
    sets = list(_data_sets(_resource(block, 0x0404) if block.startswith(b"8BIM") else block))
    declared = (1, 90, b"\x1b%G") in sets
    out: dict[tuple[str, str], None] = {}
    for record, number, raw in sets:
        if record == 2 and number in IPTC_NAMES:
            raw = raw.removesuffix(b"\0")
            try:
                text = raw.decode("utf-8", "replace" if declared else "strict")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            out[f"iptc:{IPTC_NAMES[number]}", text] = None
    return Findings(list(out))


def _words(key: str) -> str | None:
    """A key as a legal attribute name, or None."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-", key).lower()
    return name if re.fullmatch(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?", name) else None


def _pdf_info(data: bytes) -> Findings:
    file = pdf.Document(data)
    return Findings([(f"pdf:{name}", v) for k, v in file.info().items() if (name := _words(k))] if file.readable else [])


def pdf_info(data: bytes) -> Findings:
    """The information dictionary as the file spells it."""
    return limited(_pdf_info, data)


def junk_verdict(text: str) -> str | None:
    """Why *text* is noise: more than half of its ink cannot be written text."""
    ink = re.sub(r"\s", "", text)
    junk = sum(map(unwritable, ink))
    return f"{(junk * 100 + len(ink) // 2) // len(ink)}% of the extracted characters are invalid; text discarded" if junk * 2 > len(ink) else None


def unwritable(c: str) -> bool:
    """Controls, the replacement character, private use and what is no character."""
    code = ord(c)
    return unicodedata.category(c) in ("Cc", "Co") or c == "\ufffd" or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE


def pdf_text(data: bytes) -> Findings:
    """The information dictionary, and the text that the program ``pdftotext`` reads, where it is installed; noise is discarded with a note."""
    out = pdf_info(data)
    program = shutil.which("pdftotext")
    if program is None:
        out.remarks.append("pdftotext is not installed; no text")
        return out
    ran = subprocess.run([program, "-enc", "UTF-8", "-", "-"], input=data, capture_output=True)
    if ran.returncode == 3:
        out.facts.append(("prov:note", "the document does not permit text extraction"))
    elif ran.returncode == 1:
        out.facts.append(("prov:note", "pdftotext could not read this document"))
    elif ran.returncode:
        raise OSError(f"pdftotext failed: {ran.returncode}")
    elif ran.stdout.strip():
        why = junk_verdict(ran.stdout.decode("utf-8", "replace"))
        out.facts += [("prov:note", why)] if why else []
        out.files += [] if why else [(ran.stdout, [("file:mime", "text/plain")])]
    return out


def _pdf_attachments(data: bytes) -> Findings:
    out, file = Findings(), pdf.Document(data)
    stays = lambda what, why: out.facts.append(("prov:note", f"attachment {what} not extracted: {why}"))
    for spec, at in file.embedded() if file.readable else ():
        spelled = next((t for k in ("UF", "F") if (t := pdf.spoken(file.at(spec.get(k))))), None)
        name = re.split(r"[/\\\\]", spelled or "")[-1].strip()
        if name in ("", ".", "..") or not fitted(name):
            stays(json.dumps(spelled, ensure_ascii=False) if spelled else f"(object {at.number} 0)", "no file name")
            continue
        stream = file.at(at)
        if not isinstance(stream, pdf.Stream):
            stays(spelled, "embedded file missing" if stream is None else "embedded file damaged")
            continue
        try:
            content = stream.decoded(MOST_UNPACKED)
        except ValueError as e:
            stays(spelled, str(e))
            continue
        if len(content) > MOST_UNPACKED:
            stays(spelled, "larger than 1 GiB")
            continue
        declared, params = str(file.at(stream.entries.get("Subtype")) or ""), file.entries(stream.entries.get("Params"))
        facts = [("file:mime", declared if re.fullmatch(r"[a-z0-9.+-]+/[a-z0-9.+-]+", declared) else "application/octet-stream"), ("file:name", name), ("file:path", "@" + spelled)]
        told = [(own, k) for own, k in ((spec, "Desc"), (spec, "AFRelationship"), (params, "CreationDate"), (params, "ModDate"))]
        out.files.append((content, facts + [(f"pdf:{_words(k)}", v) for own, k in told if (v := pdf.spoken(file.at(own.get(k))))]))
    return out


def pdf_attachments(data: bytes) -> Findings:
    """Embedded files as derived files, with what the document says of them; what stays inside leaves a note."""
    return limited(_pdf_attachments, data)


def text_stats(data: bytes) -> Findings:
    text = data.decode("utf-8", "replace")
    return Findings([("text:lines", text.count("\n") + 1), ("text:words", len(text.split()))])


CONTRACTS = {
    c.source: c
    for c in (
        Contract("extractor:mail-headers/1", ("message/rfc822",), mail_headers), Contract("extractor:mail-attachments/1", ("message/rfc822",), mail_attachments),
        Contract("extractor:mail-text/1", ("message/rfc822",), mail_text), Contract("extractor:packed-list/1", ("application/zip",), packed_list),
        Contract("extractor:packed-unpack/1", ("application/zip",), packed_unpack), Contract("extractor:image-raster/3", ("image/png", "image/jpeg", "image/tiff", "image/webp", "image/heic", "image/heif", "image/avif"), image_raster),
        Contract("extractor:image-xmp/1", ("image/jpeg", "image/png", "image/tiff", "image/webp", "image/heic", "image/heif", "image/avif"), image_xmp), Contract("extractor:image-iptc/1", ("image/jpeg", "image/tiff"), image_iptc),
        Contract("extractor:pdf-text/1", ("application/pdf",), pdf_text), Contract("extractor:pdf-attachments/1", ("application/pdf",), pdf_attachments), Contract("extractor:text-stats/1", ("text/plain",), text_stats),
    )
}


#: Troubles that are no file's own: the run stops.
STOPS = (MemoryError, OSError, ImportError)


def _spelt(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _answer(contract: Contract, subject: str, data: bytes) -> tuple[list[tuple], list[tuple[str, bytes, list]]]:
    """The rows of ANSWER of *contract* on one file, and its derived files (digest, content, own facts)."""
    try:
        found = contract.read(bytes(data))
        out = [(subject, contract.source, None, a, _spelt(v), None) for a, v in found.facts]
        files = [(hashlib.sha256(content).hexdigest(), content, facts) for content, facts in found.files]
        for digest, content, facts in files:
            own = [("prov:origin", subject), ("file:size", len(content)), *facts]
            out += [(subject, contract.source, digest, a, _spelt(v), None) for a, v in own]
        # An examination that finds nothing is one all the same: it has a row, and so a receipt.
        return sorted(set(out), key=lambda r: tuple(x or "" for x in r)) or [(subject, contract.source, None, None, None, None)], files
    except STOPS:
        raise
    except Exception as e:  # whatever a file's bytes provoke is that file's trouble
        return [(subject, contract.source, None, None, None, f"{type(e).__name__}: {e}"[:200])], []


def examine(files: DataFrame, contract: Contract) -> DataFrame:
    """The answer of *contract* on *files* (subject, content): facts, derived files, errors; a row without attribute where nothing was found."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ANSWER.split(", ")]
        for part in parts:
            yield pd.DataFrame([r for s, d in zip(part["subject"], part["content"]) if d is not None for r in _answer(contract, s, d)[0]], columns=names)

    return files.select("subject", "content").mapInPandas(batches, ANSWER)


def _round(work: DataFrame, runs: list[Contract]) -> DataFrame:
    """One round: the answers (ROUND) of every contract that takes the kind of a file of *work* (subject, mime, content).

    A file without a mime is sniffed, and so is a derived file that comes without one; that
    kind is then one of its facts. Each examined file has at least one row. The bytes of
    derived files go on only where some contract takes them.
    """
    names = [c.split()[0] for c in ROUND.split(", ")]
    taken = {m for c in runs for m in c.mimes}

    def rows(subject: str, kind: str | None, data: bytes) -> Iterator[tuple]:
        kind = kind or sniff.kind(data)
        for contract in runs:
            if kind not in contract.mimes:
                continue
            answer, files = _answer(contract, subject, data)
            for row in answer:
                yield *row, kind, None, None
            for digest, content, facts in files:
                told, found = dict(facts).get("file:mime"), sniff.kind(content)
                if told != found:
                    yield subject, contract.source, digest, "file:mime", _spelt(found), None, kind, None, None
                for own in {told, found} & taken:
                    yield subject, contract.source, digest, None, None, None, kind, own, content

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, held = [], 0
            for subject, kind, data in zip(part["subject"], part["mime"], part["content"]):
                if data is None:
                    continue
                for row in rows(subject, kind, bytes(data)):
                    out.append(row)
                    held += len(row[-1] or b"")
                if held > HANDED_ON:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return work.select("subject", "mime", "content").mapInPandas(batches, ROUND)


def settle(files: DataFrame, runs: list[Contract] | None = None) -> DataFrame:
    """All *runs* on *files* (subject, content) and on what is derived from them, in rounds until one examines nothing.

    A round's answers and derived bytes are written to the shared folder, which cuts its
    lineage; the next works on the derived files that no round has examined under their
    kind. Rounds without an end are an error.
    """
    spark = files.sparkSession
    runs = list(CONTRACTS.values()) if runs is None else runs
    folder = work_folder(spark, "rounds")
    work, paths = files.select("subject", F.lit(None).cast("string").alias("mime"), "content"), []
    while True:
        paths.append(f"{folder}/{len(paths)}")
        _round(work, runs).write.parquet(paths[-1])
        last = spark.read.schema(ROUND).parquet(paths[-1])
        if last.isEmpty():
            break
        if len(paths) == MOST_ROUNDS:
            raise RuntimeError(f"stopped after {MOST_ROUNDS} rounds with files still waiting")
        seen = spark.read.schema(ROUND).parquet(*paths).select("subject", F.col("kind").alias("mime")).distinct()
        fresh = last.where(F.col("content").isNotNull()).select(F.col("derived").alias("subject"), "mime", "content").dropDuplicates(["subject", "mime"])
        work = fresh.join(seen, ["subject", "mime"], "left_anti")
    return spark.read.schema(ROUND).parquet(*paths).select(*[c.split()[0] for c in ANSWER.split(", ")])


def named(words: list[str]) -> list[Contract]:
    """The contracts that *words* name: ``NAME`` all of an extractor, ``NAME:CONTRACT`` one; unknown ones and repeats are refused."""
    out: list[Contract] = []
    for word in words:
        if not re.fullmatch(r"[a-z0-9]+(?::[a-z0-9-]+)?", word):
            raise ValueError(f"not NAME or NAME:CONTRACT: {word}")
        name, _, own = word.partition(":")
        found = [c for c in CONTRACTS.values() if re.fullmatch(rf"extractor:{name}-{own or '[a-z0-9-]+'}/[0-9]+", c.source)]
        if not found:
            raise ValueError(f"no such contract: {word}")
        if twice := [c.source for c in found if c in out]:
            raise ValueError(f"named twice: {', '.join(twice)}")
        out += found
    return out


def work(claims: DataFrame, runs: list[Contract], subjects: DataFrame | None = None, full: bool = False) -> DataFrame:
    """What *runs* have to examine: rows (subject, source).

    By default the files of the kinds of a contract that have no receipt of it; with *full*, also
    those that have one. *subjects* (subject) are examined whatever their kind and receipts. As a dry
    run this is the answer.
    """
    if subjects is not None:
        return union_all([subjects.select("subject", F.lit(c.source).alias("source")).distinct() for c in runs])
    rows = [(ask.kinds(claims, list(c.mimes)) if full else ask.worklist(claims, list(c.mimes), c.source)).withColumn("source", F.lit(c.source)) for c in runs]
    return union_all(rows)


def run(claims: DataFrame, files: DataFrame, runs: list[Contract], subjects: DataFrame | None = None, full: bool = False) -> DataFrame:
    """The answers (ANSWER) of *runs* on their ``work``, with the bytes of *files* (subject, content)."""
    todo = work(claims, runs, subjects, full)
    return union_all([examine(todo.where(F.col("source") == c.source).join(files, "subject"), c) for c in runs])


def recorded(answers: DataFrame, time: str, run: str) -> DataFrame:
    """Claims of *answers*: findings and facts of derived files, then a receipt per file without error."""
    made = lambda df: df.withColumns({"time": F.lit(time), "run": F.lit(run), "retracts": F.lit(None).cast("array<string>")})
    good = answers.where(F.col("error").isNull())
    facts = good.select(F.coalesce("derived", "subject").alias("subject"), "attribute", "value", "source").where(F.col("attribute").isNotNull())
    receipts = good.select("subject", F.lit("prov:examined").alias("attribute"), F.concat(F.lit('"'), F.col("source"), F.lit('"')).alias("value"), "source").distinct()
    return made(facts.unionByName(receipts))
