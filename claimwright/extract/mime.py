"""The structure of a message as spans of its bytes, found from the outside in.

A part ends at the next delimiter line of its own multipart, whatever stands inside; the
first close delimiter ends the multipart; without one the last part runs to the end. A
delimiter is a whole line, and the line break before it is part of it. The head of an entity
is its run of field lines. An attached message is one leaf and is not opened. A multipart
without a boundary, without an opening delimiter or too deep is a single part. Nothing here
fails: bytes without structure are one part. Decoding keeps what can be decoded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import unquote_to_bytes

from claimwright.extract import sniff

DEEPEST = 64
_HEAD = re.compile(rb"(?:[!-9;-~]+[ \t]*:[^\n]*(?:\n|\Z)(?:[ \t][^\n]*(?:\n|\Z))*)*")
_EMPTY = re.compile(rb"\r?(?:\n|\Z)")
_FIELD = re.compile(rb"([!-9;-~]+)[ \t]*:([^\n]*(?:\n[ \t][^\n]*)*)(?:\n|\Z)")
_WORD = re.compile(r"=\?([^?\s*]+)(?:\*[^?]*)?\?([bBqQ])\?([^?\s]*)\?=")
_PARAMETER = re.compile(r';\s*([^\s;=*]+)(\*\d+)?(\*)?\s*=\s*("(?:\\.|[^"\\])*"|[^;\s]*)', re.S)


def as_text(data: bytes, *charsets: str | None) -> str:
    """*data* in the first of *charsets* that is known and fits, else in UTF-8, else in Windows-1252."""
    for charset in (*charsets, "utf-8"):
        try:
            return data.decode(charset.strip())
        except (AttributeError, LookupError, UnicodeDecodeError, ValueError):
            continue
    return data.decode("windows-1252", "replace")


def words_decoded(text: str) -> str:
    """*text* with its encoded words decoded; white space between two of them goes."""
    def one(m: re.Match) -> str:
        raw = sniff.lenient_base64(m[3].encode("ascii", "ignore")) if m[2] in "bB" else sniff.lenient_quoted(m[3].replace("_", " ").encode("utf-8"), line=False)
        try:
            return raw.decode(m[1], "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")

    return _WORD.sub(one, re.sub(rf"({_WORD.pattern})\s+(?={_WORD.pattern})", r"\1", text))


def unfolded(raw: bytes) -> str:
    """A header's value on one line, encoded words decoded."""
    return words_decoded(re.sub(r"[ \t]*\r?\n[ \t]+", " ", raw.decode("utf-8", "replace")).strip())


def parameters(value: str) -> dict[str, str]:
    """The parameters of a header value by lower-cased name: quoted, encoded, and continued over several."""
    pieces: dict[str, list[tuple[int, bool, str]]] = {}
    for name, number, starred, given in _PARAMETER.findall(";" + value.partition(";")[2]):
        given = re.sub(r"\\(.)", r"\1", given[1:-1]) if given[:1] == '"' and given[-1:] == '"' and len(given) > 1 else given
        pieces.setdefault(name.lower(), []).append((int(number[1:] or 0) if number else 0, bool(starred), given))
    out = {}
    for name, own in pieces.items():
        own.sort(key=lambda p: p[0])
        if not any(starred for _, starred, _ in own):
            out[name] = words_decoded("".join(text for *_, text in own))
            continue
        charset, _, rest = own[0][2].partition("'") if own[0][2].count("'") >= 2 else ("utf-8", "", own[0][2])
        first = rest.partition("'")[2] if own[0][2].count("'") >= 2 else rest
        data = b"".join(unquote_to_bytes(text) if starred else text.encode() for (_, starred, _), text in zip(own, [first, *(t for *_, t in own[1:])]))
        out[name] = as_text(data, charset)
    return out


@dataclass
class Entity:
    """A message or a part: its fields in order, its body, and its parts if it can be split."""

    fields: list[tuple[str, bytes]]
    body: bytes
    digest: bool = False
    depth: int = 0
    kind: str | None = None
    given: dict[str, str] = field(default_factory=dict)
    disposed: dict[str, str] = field(default_factory=dict)

    @cached_property
    def parts(self) -> list[Entity] | None:
        """The parts of a multipart that can be split, looked for when they are asked for."""
        splits = self.kind and self.kind.startswith("multipart/") and self.depth < DEEPEST and self.given.get("boundary")
        return _parts(self, self.depth + 1) if splits else None

    def last(self, name: str) -> str | None:
        found = [raw for n, raw in self.fields if n == name]
        return re.sub(r"\r?\n(?=[ \t])", "", found[-1].decode("utf-8", "replace")).strip() if found else None

    @property
    def is_message(self) -> bool:
        return self.kind in ("message/rfc822", "message/global") or (self.kind is None and self.digest)

    @property
    def name(self) -> str | None:
        return self.disposed.get("filename") or self.given.get("name") or None

    @property
    def is_attachment(self) -> bool:
        """Whether it becomes a file of its own: it has a name or is a message. Any other leaf is body."""
        return self.name is not None or self.is_message

    def leaves(self) -> Iterator[Entity]:
        waiting = [self]
        while waiting:
            own = waiting.pop()
            if own.parts is None:
                yield own
            else:
                waiting += reversed(own.parts)

    def decoded(self) -> bytes:
        """The body with its transfer encoding undone, as far as the bytes allow."""
        how = (self.last("content-transfer-encoding") or "").lower()
        if how == "base64":
            return sniff.lenient_base64(self.body)
        if how == "quoted-printable":
            return sniff.lenient_quoted(self.body)
        if how in ("x-uuencode", "uuencode", "x-uue", "uue"):
            return sniff.lenient_uu(self.body)
        return self.body


def parse(data: bytes, in_digest: bool = False, depth: int = 0) -> Entity:
    """The structure of *data*, read as one entity."""
    end = _HEAD.match(data).end()
    empty = _EMPTY.match(data, end)
    own = Entity([(n.decode("ascii").lower(), raw) for n, raw in _FIELD.findall(data[:end])], data[empty.end() if empty else end :], in_digest, depth)
    declared = own.last("content-type")
    if declared:
        kind = declared.partition(";")[0].strip().lower()
        own.kind, own.given = (kind if re.fullmatch(r"[^\s/]+/[^\s/]+", kind) else None), parameters(declared)
    own.disposed = parameters(own.last("content-disposition") or "")
    return own


def _parts(own: Entity, depth: int) -> list[Entity] | None:
    line = re.compile(rb"(?m)^--" + re.escape(own.given["boundary"].encode("utf-8")) + rb"(--)?[ \t]*\r?(?:\n|\Z)")
    begins, spans = None, []
    for m in line.finditer(own.body):
        at, floor = m.start(), begins if begins is not None else 0
        # The line break before a delimiter is its own, unless the delimiter before it took it.
        before = at - (2 if own.body[max(floor, at - 2) : at] == b"\r\n" else 1) if at > floor else at
        if begins is not None:
            spans.append((begins, before))
        begins = m.end()
        if m[1]:
            begins = None
            break
        if not spans and begins is None:
            return None
    if begins is not None:
        spans.append((begins, len(own.body)))
    return [parse(own.body[a:b], own.kind == "multipart/digest", depth) for a, b in spans] or None
