"""PDF files as far as their structure goes: objects, the information dictionary, embedded files.

Objects are found by their own marks, not through the cross reference, so files with a
broken table read too; of several definitions of an object the last counts. Object streams
are opened. Encrypted files have nothing to say.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# Where PDFDocEncoding leaves Latin-1.
_DOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0xA1)], "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž\ufffd€"))
_SPACE = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])")
_NAME = re.compile(rb"/([^\0\t\n\f\r ()<>\[\]{}/%]*)")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj(?![A-Za-z])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
DEEPEST = 200


class Name(str):
    """A name object."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    entries: dict
    raw: bytes

    def decoded(self, most: int | None = None) -> bytes:
        """The bytes without their filter; of damaged ones what comes before the damage, and no more than *most* + 1."""
        filters = self.entries.get("Filter", [])
        filters = filters if isinstance(filters, list) else [filters]
        if not filters:
            return self.raw
        if filters != ["FlateDecode"] or "DecodeParms" in self.entries:
            raise ValueError(f"filter {' '.join(map(str, filters))} is not read")
        inflate, out = zlib.decompressobj(), b""
        for at in range(0, len(self.raw), 1 << 16):
            try:
                out += inflate.decompress(self.raw[at : at + (1 << 16)], 0 if most is None else most + 1 - len(out))
            except zlib.error:
                break
            if most is not None and len(out) > most:
                break
        return out


def text(data: bytes) -> str:
    """A text string: UTF-16BE or UTF-8 behind their marks, else PDFDocEncoding."""
    if data.startswith(b"\xfe\xff"):
        return (data[2:] + b"\0" * (len(data) % 2)).decode("utf-16-be", "replace")
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    return "".join(_DOC.get(b, chr(b)) for b in data)


class _Reader:
    def __init__(self, data: bytes):
        self.data = data

    def value(self, at: int, depth: int = 0):
        """(object, end) of the object at *at*."""
        data, at = self.data, _SPACE.match(self.data, at).end()
        if depth > DEEPEST:
            raise ValueError("nested too deep")
        if data.startswith(b"<<", at):
            at, out = at + 2, {}
            while True:
                at = _SPACE.match(data, at).end()
                if data.startswith(b">>", at):
                    return out, at + 2
                key, at = self.value(at, depth + 1)
                if not isinstance(key, Name):
                    raise ValueError("a key is no name")
                out[str(key)], at = self.value(at, depth + 1)
        if data[at : at + 1] == b"[":
            at, items = at + 1, []
            while True:
                at = _SPACE.match(data, at).end()
                if data[at : at + 1] == b"]":
                    return items, at + 1
                item, at = self.value(at, depth + 1)
                items.append(item)
        if data[at : at + 1] == b"(":
            return self._string(at + 1)
        if data[at : at + 1] == b"<":
            end = data.index(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
        if m := _NAME.match(data, at):
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1]).decode("utf-8", "replace")), m.end()
        if m := _REF.match(data, at):
            return Ref(int(m[1])), m.end()
        if m := _NUMBER.match(data, at):
            return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
        for word, meant in ((b"true", True), (b"false", False), (b"null", None)):
            if data.startswith(word, at):
                return meant, at + len(word)
        raise ValueError(f"no object at {at}")

    def _string(self, at: int) -> tuple[bytes, int]:
        out, depth = b"", 1
        for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|[()]|\r\n?|[^\\()\r]+", re.S).finditer(self.data, at):
            whole, escaped = m[0], m[1]
            if escaped is not None:
                octal = re.fullmatch(rb"[0-7]{1,3}", escaped)
                out += bytes([int(escaped, 8) & 255]) if octal else b"" if escaped in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(escaped, escaped)
                continue
            depth += {b"(": 1, b")": -1}.get(whole, 0)
            if depth == 0:
                return out, m.end()
            out += b"\n" if whole[:1] == b"\r" else whole
        raise ValueError("a string without an end")


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        reader, packed = _Reader(data), []
        for m in _OBJECT.finditer(data):
            try:
                value, end = reader.value(m.end())
            except (ValueError, IndexError, RecursionError):
                continue
            begin = re.compile(rb"[\0\t\f ]*\r?\n?[\0\t\n\f\r ]*stream\r?\n").match(data, end)
            if isinstance(value, dict) and begin:
                length = value.get("Length")
                stop = begin.end() + length if isinstance(length, int) and re.match(rb"[\r\n ]*endstream", data[begin.end() + length : begin.end() + length + 16]) else data.find(b"endstream", begin.end())
                raw = data[begin.end() : stop if stop >= 0 else len(data)]
                value = Stream(value, raw if isinstance(length, int) else re.sub(rb"\r?\n\Z", b"", raw))
                kind = value.entries.get("Type")
                if kind == "ObjStm":
                    packed.append(value)
                elif kind == "XRef":
                    self.trailer |= {k: v for k, v in value.entries.items() if k in ("Root", "Info", "Encrypt")}
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"trailer", data):
            try:
                self.trailer |= reader.value(m.end())[0]
            except (ValueError, IndexError, TypeError, RecursionError):
                continue
        for stream in packed:
            self._open(stream)

    def _open(self, stream: Stream) -> None:
        try:
            data, first, n = stream.decoded(), int(stream.entries["First"]), int(stream.entries["N"])
            heads = [int(x) for x in data[:first].split()[: 2 * n]]
            for number, at in zip(heads[::2], heads[1::2]):
                self.objects.setdefault(number, _Reader(data).value(first + at)[0])
        except (ValueError, KeyError, IndexError, TypeError, RecursionError):
            return

    def at(self, value):
        """What *value* is, or refers to."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def entries(self, value) -> dict:
        value = self.at(value)
        return value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    @property
    def readable(self) -> bool:
        return "Encrypt" not in self.trailer

    def info(self) -> dict[str, str]:
        """The text and name entries of the information dictionary."""
        return {k: own for k, v in self.entries(self.trailer.get("Info")).items() if (own := spoken(self.at(v)))}

    def embedded(self) -> Iterator[tuple[dict, object]]:
        """(specification, what its stream is named by) of embedded files: of the name tree, then of the pages' annotations, each stream once."""
        root, seen = self.entries(self.trailer.get("Root")), set()
        for spec in (*self._tree(self.entries(root.get("Names")).get("EmbeddedFiles"), set()), *self._attached(root.get("Pages"), set())):
            own = self.entries(spec)
            files = self.entries(own.get("EF"))
            stream = files.get("UF", files.get("F"))
            if isinstance(stream, Ref) and stream not in seen:
                seen.add(stream)
                yield own, stream

    def _tree(self, node, seen: set) -> Iterator[object]:
        if isinstance(node, Ref):
            if node in seen:
                return
            seen.add(node)
        own = self.entries(node)
        names = self.at(own.get("Names"))
        if isinstance(names, list):
            yield from names[1::2]
        kids = self.at(own.get("Kids"))
        for kid in kids if isinstance(kids, list) else ():
            yield from self._tree(kid, seen)

    def _attached(self, node, seen: set) -> Iterator[object]:
        if node in seen:
            return
        if isinstance(node, Ref):
            seen.add(node)
        own = self.entries(node)
        kids, notes = self.at(own.get("Kids")), self.at(own.get("Annots"))
        for kid in kids if isinstance(kids, list) else ():
            if isinstance(kid, Ref):
                yield from self._attached(kid, seen)
        for note in map(self.entries, notes if isinstance(notes, list) else ()):
            if note.get("Subtype") == "FileAttachment" and "FS" in note:
                yield note["FS"]


def spoken(value) -> str | None:
    """The text of a string or a name; None of anything else, and of nothing."""
    return (str(value) if isinstance(value, Name) else text(value) if isinstance(value, bytes) else None) or None
