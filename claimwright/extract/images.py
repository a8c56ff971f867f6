"""Pixel grids and XMP packets of pictures, from their headers; no pixel is decoded.

Each reader gives None or nothing for bytes that it cannot read. A picture's kind is what its
first bytes announce.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

PNG, WEBP_HEADS = b"\x89PNG\r\n\x1a\n", (b"VP8 ", b"VP8L", b"VP8X")


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    depth: int
    alpha: bool
    color: str | None


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, bytes) of a JPEG's segments before its picture."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def _chunks(data: bytes, start: int, order: str, name_first: bool) -> Iterator[tuple[bytes, bytes]]:
    """(name, bytes) of the chunks of a PNG or RIFF file; the last may be cut."""
    at = start
    while at + 8 <= len(data):
        name, size = (data[at : at + 4], data[at + 4 : at + 8]) if name_first else (data[at + 4 : at + 8], data[at : at + 4])
        length = int.from_bytes(size, order)
        yield name, data[at + 8 : at + 8 + length]
        at += 8 + length + (length % 2 if name_first else 4)


def _png(data: bytes) -> list[tuple[bytes, bytes]]:
    out = []
    for name, body in _chunks(data, 8, "big", False):
        if name == b"IDAT":
            break
        out.append((name, body))
    return out


def _riff(data: bytes) -> list[tuple[bytes, bytes]]:
    return list(_chunks(data, 12, "little", True))


def _tiff(data: bytes) -> dict[int, tuple[int, bytes]]:
    from claimwright.extract.exif import entries

    found: dict[int, tuple[int, bytes]] = {}
    for tag, kind, _, raw in entries(data):
        found.setdefault(tag, (kind, raw))
    return found


def _tiff_number(data: bytes, found: dict, tag: int, default: int | None = None) -> int | None:
    kind, raw = found.get(tag, (0, b""))
    size = {1: 1, 3: 2, 4: 4}.get(kind)
    return int.from_bytes(raw[:size], "little" if data[:2] == b"II" else "big") if size and len(raw) >= size else default


class Heif:
    """The items of a HEIF file and what its boxes say about them."""

    def __init__(self, data: bytes):
        self.data, self.types, self.places, self.properties = data, {}, {}, []
        self.owned, self.refers, self.primary, self.own = {}, [], 0, b""
        meta = next((body for name, body in self.boxes(data) if name == b"meta"), b"")
        for name, body in self.boxes(meta[4:]):
            reader = getattr(self, "_" + name.decode("latin-1").strip(), None)
            if reader:
                reader(body)

    @staticmethod
    def boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 8 <= len(data):
            size, head = int.from_bytes(data[at : at + 4], "big"), 8
            if size == 0:
                size = len(data) - at
            elif size == 1:
                size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            if size < head or at + size > len(data):
                return
            yield data[at + 4 : at + 8], data[at + head : at + size]
            at += size

    @staticmethod
    def _ids(wide: bool) -> str:
        return "I" if wide else "H"

    def _pitm(self, body: bytes) -> None:
        (self.primary,) = struct.unpack_from(">" + self._ids(body[0] > 0), body, 4)

    def _iinf(self, body: bytes) -> None:
        for name, item in self.boxes(body[6 if body[0] == 0 else 8 :]):
            if name == b"infe" and item[0] >= 2:
                shape = ">" + self._ids(item[0] > 2) + "H4s"
                key, _, kind = struct.unpack_from(shape, item, 4)
                rest = item[4 + struct.calcsize(shape) :].split(b"\0")
                self.types[key] = kind, rest[1].decode("latin-1") if kind == b"mime" and len(rest) > 2 else None

    def _iloc(self, body: bytes) -> None:
        stream, version = io.BytesIO(body), body[0]
        number = lambda size: int.from_bytes(stream.read(size), "big")
        stream.seek(4)
        sizes = number(2)
        offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
        for _ in range(number(2 if version < 2 else 4)):
            key = number(2 if version < 2 else 4)
            method = number(2) & 15 if version else 0
            stream.read(2)
            base, spans = number(base_size), []
            for _ in range(number(2)):
                stream.read(index_size if version else 0)
                start, length = number(offset_size), number(length_size)
                spans.append((base + start, length))
            self.places.setdefault(key, (method, spans))

    def _iprp(self, body: bytes) -> None:
        for name, inner in self.boxes(body):
            if name == b"ipco":
                self.properties = list(self.boxes(inner))
            elif name == b"ipma":
                at, wide = 8, inner[3] & 1
                for _ in range(int.from_bytes(inner[4:8], "big")):
                    (key,) = struct.unpack_from(">" + self._ids(inner[0] > 0), inner, at)
                    at += 4 if inner[0] else 2
                    count, at = inner[at], at + 1
                    own = [int.from_bytes(inner[at + k * (1 + wide) : at + (k + 1) * (1 + wide)], "big") & (0x7FFF if wide else 0x7F) for k in range(count)]
                    at += count * (1 + wide)
                    self.owned.setdefault(key, own)

    def _iref(self, body: bytes) -> None:
        for name, inner in self.boxes(body[4:]):
            one = self._ids(body[0] > 0)
            start, count = struct.unpack_from(">" + one + "H", inner)
            self.refers.append((name, start, struct.unpack_from(f">{count}{one}", inner, struct.calcsize(">" + one + "H"))))

    def _idat(self, body: bytes) -> None:
        self.own = body

    def of(self, key: int, name: bytes) -> bytes | None:
        return next((body for i in self.owned.get(key, ()) if 0 < i <= len(self.properties) for n, body in [self.properties[i - 1]] if n == name), None)

    def content(self, key: int) -> bytes:
        method, spans = self.places.get(key, (2, []))
        source = {0: self.data, 1: self.own}.get(method, b"")
        return b"".join(source[a : a + n] for a, n in spans)

    def grid(self) -> Grid | None:
        size = self.of(self.primary, b"ispe")
        if not size or len(size) < 12:
            return None
        tiles = [self.primary, *(t for n, start, to in self.refers if n == b"dimg" and start == self.primary for t in to)]
        first = lambda name: next((p for t in tiles if (p := self.of(t, name))), b"")
        bits = first(b"pixi")[5 : 5 + (first(b"pixi")[4:5] or b"\0")[0]]
        hevc, av1 = first(b"hvcC"), first(b"av1C")
        depth = bits[0] if bits else (hevc[17] & 7) + 8 if len(hevc) > 17 else (12 if av1[2] & 0x20 else 10) if len(av1) > 2 and av1[2] & 0x40 else 8
        gray = len(bits) == 1 or (len(hevc) > 16 and hevc[16] & 3 == 0) or (len(av1) > 2 and av1[2] & 0x10 != 0)
        roles = [(self.of(start, b"auxC") or b"")[4:].split(b"\0")[0] for n, start, to in self.refers if n == b"auxl" and self.primary in to]
        alpha = any(r == b"urn:mpeg:hevc:2015:auxid:1" or b"alpha" in r for r in roles)
        return Grid(*struct.unpack(">II", size[4:12]), depth, alpha, "gray" if gray else "rgb")


def grid(data: bytes) -> Grid | None:
    """The pixel grid as the file's header has it: bits a channel as stored, and the color model of the pixels."""
    if data.startswith(PNG):
        chunks = dict(_png(data))
        head = chunks.get(b"IHDR", b"")
        models = {0: ("gray", False), 2: ("rgb", False), 3: ("indexed", False), 4: ("gray", True), 6: ("rgb", True)}
        if len(head) < 10 or head[9] not in models:
            return None
        color, alpha = models[head[9]]
        return Grid(*struct.unpack(">II", head[:8]), head[8], alpha or b"tRNS" in chunks, color)
    if data[:2] == b"\xff\xd8":
        frame = next((b for m, b in _segments(data) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)), b"")
        color = {1: "gray", 3: "rgb", 4: "cmyk"}.get(frame[5]) if len(frame) > 5 and frame[0] == 8 else None
        return Grid(int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big"), 8, False, color) if color else None
    if data[:4] in (b"II*\0", b"MM\0*"):
        found = _tiff(data)
        width, height, kind = (_tiff_number(data, found, t) for t in (256, 257, 262))
        depth, samples = _tiff_number(data, found, 258, 1), _tiff_number(data, found, 277, 1)
        if not width or not height or kind is None:
            return None
        plain = {0: ("gray", 1), 1: ("gray", 1), 2: ("rgb", 3), 3: ("indexed", 1), 5: ("cmyk", 4), 6: ("rgb", 3)}.get(kind)
        if plain is None:
            return None
        color, own = plain
        if samples == own:
            return Grid(width, height, depth, False, color)
        return Grid(width, height, depth, True, color) if samples == own + 1 and kind in (0, 1, 2, 5) else Grid(width, height, depth, False, None)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        name, body = next(iter(_riff(data)), (b"", b""))
        if name == b"VP8X" and len(body) >= 10:
            return Grid(int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1, 8, bool(body[0] & 0x10), "rgb")
        if name == b"VP8L" and body[:1] == b"\x2f" and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            return Grid((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 8, bool(bits >> 28 & 1), "rgb")
        if name == b"VP8 " and body[3:6] == b"\x9d\x01\x2a" and len(body) >= 10:
            return Grid(int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF, 8, False, "rgb")
        return None
    return Heif(data).grid() if data[4:8] == b"ftyp" else None


# -- XMP

RDF, XML = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
# Namespaces and the prefixes they are known by, whatever a packet calls them.
PREFIXES = {
    "http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/xap/1.0/rights/": "xmpRights", "http://ns.adobe.com/xap/1.0/mm/": "xmpMM", "http://ns.adobe.com/xap/1.0/bj/": "xmpBJ",
    "http://ns.adobe.com/xap/1.0/t/pg/": "xmpTPg", "http://ns.adobe.com/xmp/1.0/DynamicMedia/": "xmpDM", "http://ns.adobe.com/xmp/note/": "xmpNote", "http://ns.adobe.com/xmp/Identifier/qual/1.0/": "xmpidq",
    "http://ns.adobe.com/xap/1.0/sType/ResourceEvent#": "stEvt", "http://ns.adobe.com/xap/1.0/sType/ResourceRef#": "stRef", "http://ns.adobe.com/xap/1.0/sType/Dimensions#": "stDim", "http://ns.adobe.com/xap/1.0/sType/Version#": "stVer",
    "http://ns.adobe.com/xap/1.0/sType/Job#": "stJob", "http://ns.adobe.com/pdf/1.3/": "pdf", "http://ns.adobe.com/photoshop/1.0/": "photoshop", "http://ns.adobe.com/camera-raw-settings/1.0/": "crs", "http://ns.adobe.com/tiff/1.0/": "tiff",
    "http://ns.adobe.com/exif/1.0/": "exif", "http://cipa.jp/exif/1.0/": "exifEX", "http://ns.adobe.com/exif/1.0/aux/": "aux", "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "Iptc4xmpCore", "http://iptc.org/std/Iptc4xmpExt/2008-02-29/": "Iptc4xmpExt",
    "http://ns.useplus.org/ldf/xmp/1.0/": "plus", "http://ns.adobe.com/lightroom/1.0/": "lr", "http://ns.google.com/photos/1.0/panorama/": "GPano", "http://ns.google.com/photos/1.0/camera/": "GCamera", "http://ns.microsoft.com/photo/1.0/": "MicrosoftPhoto",
    "http://ns.microsoft.com/photo/1.2/": "MP", "http://www.digikam.org/ns/1.0/": "digiKam", "http://ns.adobe.com/hdr-gain-map/1.0/": "hdrgm", "http://ns.apple.com/pixeldatainfo/1.0/": "apdi",
    "http://www.metadataworkinggroup.com/schemas/regions/": "mwg-rs", "http://ns.adobe.com/xmp/sType/Area#": "stArea",
}


def packets(data: bytes) -> list[bytes]:
    """The XMP packets, where each kind of file keeps them."""
    if data.startswith(PNG):
        out = []
        for name, body in _png(data):
            key, _, rest = body.partition(b"\0")
            if name == b"iTXt" and key == b"XML:com.adobe.xmp" and len(rest) > 1:
                text = rest[2:].split(b"\0", 2)[-1]
                try:
                    out.append(zlib.decompress(text) if rest[0] else text)
                except zlib.error:
                    continue
        return out
    if data[:2] == b"\xff\xd8":
        plain, longer = [], {}
        for marker, body in _segments(data):
            if marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                plain.append(body[29:])
            elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xmp/extension/\0"):
                longer.setdefault(body[35:67], []).append((int.from_bytes(body[71:75], "big"), body[75:]))
        return plain[:1] + [b"".join(piece for _, piece in sorted(own)) for own in longer.values()]
    if data[:4] in (b"II*\0", b"MM\0*"):
        found = _tiff(data).get(700)
        return [found[1]] if found else []
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return [body for name, body in _riff(data) if name == b"XMP "][:1]
    if data[4:8] == b"ftyp":
        file = Heif(data)
        return [file.content(k) for k, (kind, mime) in file.types.items() if kind == b"mime" and mime == "application/rdf+xml"][:1]
    return []


def _legal(name: str) -> str:
    """Words in lower case with one ``-`` between; other characters fall away."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-", name).lower()
    return re.sub(r"-+", "-", re.sub(r"[^a-z0-9-]", "", re.sub(r"[-_.: ]+", "-", words))).strip("-")


@dataclass
class Properties:
    """Values by attribute: items of unordered lists each once, all others together in order."""

    single: dict[tuple[str, str], None] = field(default_factory=dict)
    listed: dict[str, list[str]] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)

    def facts(self) -> list[tuple[str, object]]:
        return [*self.single, *((name, own[0] if len(own) == 1 else own) for name, own in self.listed.items())]

    def read(self, packet: bytes) -> None:
        if b"<!DOCTYPE" in packet or b"<!ENTITY" in packet:
            return
        text = re.sub(r"\A<\?xml[^>]*\?>", "", packet.decode("utf-8", "replace").strip("\0 \t\r\n﻿"))
        try:
            for event, what in ElementTree.iterparse(io.StringIO(text), ("start-ns", "end")):
                if event == "start-ns":
                    self.prefixes.setdefault(what[1], what[0])
                elif what.tag == RDF + "RDF":
                    for own in what.findall(RDF + "Description"):
                        self._fields(own, "", False)
        except ElementTree.ParseError:
            return

    def _put(self, name: str, value: str, in_bag: bool) -> None:
        if in_bag:
            self.single["xmp:" + name, value] = None
        else:
            self.listed.setdefault("xmp:" + name, []).append(value)

    def _named(self, path: str, tag: str) -> str | None:
        space, bracket, local = tag[1:].rpartition("}")
        if not bracket or tag.startswith((RDF, XML)):
            return None
        own = _legal("-".join(x for x in (PREFIXES.get(space, self.prefixes.get(space, "")), local) if x))
        return ("-".join(x for x in (path, own) if x)) if own else None

    def _fields(self, node: ElementTree.Element, path: str, in_bag: bool) -> None:
        for tag, value in node.attrib.items():
            if name := self._named(path, tag):
                self._put(name, value, in_bag)
        for child in node:
            if name := self._named(path, child.tag):
                self._value(child, name, in_bag)

    def _value(self, node: ElementTree.Element, name: str, in_bag: bool) -> None:
        value = node.find(RDF + "value")
        if value is not None:  # its qualifiers stay aside
            self._value(value, name, in_bag)
        elif not len(node):
            self._fields(node, name, in_bag)
            if node.text and node.text.strip():
                self._put(name, node.text.strip(), in_bag)
        elif len(node) == 1 and node[0].tag in (RDF + "Bag", RDF + "Seq"):
            for item in node[0].findall(RDF + "li"):
                self._value(item, name, node[0].tag == RDF + "Bag")
        elif len(node) == 1 and node[0].tag == RDF + "Alt":
            items = node[0].findall(RDF + "li")
            best = next((i for i in items if i.get(XML + "lang") == "x-default"), items[0] if items else None)
            if best is not None:
                self._value(best, name, in_bag)
        else:
            self._fields(node[0] if len(node) == 1 and node[0].tag == RDF + "Description" else node, name, in_bag)
