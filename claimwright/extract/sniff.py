"""Kinds of files from their bytes: mail and mailboxes, containers, magic numbers; lenient transfer decoders."""

from __future__ import annotations

import base64
import binascii
import io
import re
import zipfile

# First bytes of formats.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"), (b"PK\x05\x06", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"BZh", "application/x-bzip2"), (b"\xfd7zXZ\0", "application/x-xz"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/x-flac"),
]
OFFICE = {"word/": "wordprocessingml.document", "xl/": "spreadsheetml.sheet", "ppt/": "presentationml.presentation"}
#: Names of headers that only a message has.
HEADERS = {"from", "sender", "reply-to", "to", "cc", "bcc", "subject", "date", "message-id", "in-reply-to", "references", "received", "return-path", "delivered-to"}


def header_names(data: bytes) -> list[str] | None:
    """The names of a well-formed header block, or None. Lines are read to the first empty one, however far."""
    out: list[str] = []
    for line in io.BytesIO(data):
        line = line.removesuffix(b"\n").removesuffix(b"\r")
        if not line:
            break
        if line[:1] in (b" ", b"\t"):
            if not out:
                return None
            continue
        m = re.match(rb"([!-9;-~]+):", line)
        if not m:
            return None
        out.append(m[1].decode("ascii").lower())
    return out


def looks_like_mail(data: bytes) -> bool:
    """A header block with two different names that only a message has; the first line of a mailbox is none."""
    names = None if data.startswith(b"From ") else header_names(data)
    return names is not None and len(HEADERS & set(names)) >= 2


def looks_like_mbox(data: bytes) -> bool:
    """A line that begins with ``From`` and a space, and a message behind it."""
    first, end, rest = data.partition(b"\n") if data.startswith(b"From ") else (b"", b"", b"")
    return bool(end) and looks_like_mail(rest)


def container_kind(z: zipfile.ZipFile) -> str | None:
    """The kind of a document in a zip: what its first entry ``mimetype`` declares, or the office file that its parts make.

    Empty for an office file of no known kind, None for an archive.
    """
    first = next(iter(z.infolist()), None)
    if first and first.filename == "mimetype" and first.file_size <= 100:
        try:
            declared = z.read(first).decode("utf-8").strip()
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, UnicodeDecodeError):
            declared = ""
        if re.fullmatch(r"[a-z0-9.+-]+/[a-z0-9.+-]+", declared):
            return declared
    names = z.namelist()
    if "[Content_Types].xml" in names:
        kinds = [k for part, k in OFFICE.items() if any(n.startswith(part) for n in names)]
        return f"application/vnd.openxmlformats-officedocument.{kinds[0]}" if kinds else ""
    return None


def _zip_kind(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return container_kind(z) or "application/zip"
    except zipfile.BadZipFile:
        return "application/zip"


def kind(data: bytes) -> str:
    """The mime of bytes; text is what decodes and has no control characters."""
    for head, mime in MAGIC:
        if data.startswith(head):
            return _zip_kind(data) if mime == "application/zip" else mime
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data[4:8] == b"ftyp":
        return {b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heif", b"avif": "image/avif"}.get(data[8:12], "video/mp4")
    if looks_like_mbox(data):
        return "application/mbox"
    if looks_like_mail(data):
        return "message/rfc822"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    if re.search(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]", text):
        return "application/octet-stream"
    return "text/html" if re.match(r"\s*<(?:!doctype html|html)\b", text, re.I) else "text/plain"


def lenient_base64(data: bytes) -> bytes:
    """Base64 with anything foreign left out; padding ends a group and decoding goes on, a group cut short gives what it holds."""
    groups = (g[: len(g) - (len(g) % 4 == 1)] for g in re.sub(rb"[^A-Za-z0-9+/=]", b"", data).split(b"="))
    return b"".join(base64.b64decode(g + b"=" * (-len(g) % 4)) for g in groups)


def lenient_quoted(data: bytes, line: bool = True) -> bytes:
    """Quoted-printable; an escape that is none stays as it is written. Without *line*, the form of encoded words."""
    if line:
        data = re.sub(rb"[ \t]+(?=\r?\n|\Z)", b"", data)
        data = re.sub(rb"=\r?(?:\n|\Z)", b"", data)
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data)


def lenient_uu(data: bytes) -> bytes:
    """The lines behind ``begin`` up to ``end``, short ones filled with zeros. Without a ``begin`` line, *data* as it is."""
    start = re.search(rb"(?m)^begin [0-7]+(?: .*)?$", data)
    if not start:
        return data
    out = []
    for line in data[start.end() :].splitlines():
        if line.strip() == b"end":
            break
        if line:
            size = (line[0] - 32) & 63
            letters = bytes(((c - 32) & 63) + 32 for c in line[1 : 1 + (size + 2) // 3 * 4])
            out.append(binascii.a2b_uu(bytes([size + 32]) + letters))
    return b"".join(out)
