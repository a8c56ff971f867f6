"""The values of mail headers as they are recorded, and why a part of one is not."""

from __future__ import annotations

import re
from datetime import date

from claimwright.extract.mime import unfolded, words_decoded

# The headers that are recorded, month names, and zones in hours east.
RECORDED = ("from", "sender", "reply-to", "to", "cc", "bcc", "subject", "date", "message-id", "in-reply-to", "references")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6, "MST": -7, "PDT": -7, "PST": -8,
    "CET": 1, "MET": 1, "MEZ": 1, "WEST": 1, "CEST": 2, "MEST": 2, "MESZ": 2, "EET": 2, "EEST": 3,
}


def _parted(text: str) -> tuple[str, list[str]]:
    """*text* without its comments, and the comments; parentheses nest, and one left open runs to the end. Quotes hide them."""
    out, comments, depth = [], [], 0
    for token in re.findall(r'"(?:\\.|[^"\\])*"|\\.|[()]|["\\]|[^()"\\]+', text, re.S):
        if token == "(":
            comments += [""] * (depth == 0)
            depth += 1
        elif token == ")" and depth:
            depth -= 1
            out.append(" " * (depth == 0))
        if depth == 0 and not (token == ")" and comments):
            out.append(token)
        elif depth and (depth > 1 or token != "("):
            comments[-1] += token
    return "".join(out), comments


def without_comments(text: str) -> str:
    return _parted(text)[0]


def _month(word: str) -> int | None:
    word = word.lower()
    return next((i for i, name in enumerate(MONTHS, 1) if name.startswith(word)), None) if len(word) > 2 else None


def _year(word: str) -> int | None:
    if not re.fullmatch("[0-9]{2,4}", word):
        return None
    value = int(word) + {2: 1900 + 100 * (int(word) < 50), 3: 1900, 4: 0}[len(word)]
    return value if value >= 1900 else None


def _offset(word: str | None) -> int | None:
    """Minutes east of UTC; None for a word that names no zone."""
    if not word:
        return None
    if m := re.fullmatch(r"([+-])([0-9]{2}):?([0-9]{2})", word):
        return (-1 if m[1] == "-" else 1) * (int(m[2]) * 60 + int(m[3])) if int(m[2]) < 24 and int(m[3]) < 60 else None
    name = word.upper()
    if name in ZONES:
        return ZONES[name] * 60
    return 0 if re.fullmatch("[A-IK-Z]", name) else None


def moment(text: str | None) -> str | None:
    """A Date header in RFC 3339: in UTC with ``Z``, or as local time where no zone can be read; None for no date.

    Second 60 stays 60. The form of ``date`` and ``asctime`` is read too; the day of the week never counts.
    """
    if text is None:
        return None
    words = re.findall(r"[^\s,]+", without_comments(text))
    if words and words[0].isalpha() and not _month(words[0]):
        words = words[1:]
    words += [""] * (6 - len(words))
    if _month(words[0]):
        month, day, clock, year, zone = words[0], words[1], words[2], words[3], None
        if _year(year) is None:
            zone, year = words[3], words[4]
    else:
        day, month, year, clock, zone = words[:5]
    at = re.fullmatch(r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?", clock)
    if not (at and _month(month) and _year(year) and re.fullmatch("[0-9]{1,2}", day)):
        return None
    hour, minute, second = (int(x or 0) for x in at.groups())
    try:
        days = date(_year(year), _month(month), int(day)).toordinal()
    except ValueError:
        return None
    if hour > 23 or minute > 59 or second > 60:
        return None
    offset = _offset(zone)
    shifted, minutes = divmod(days * 1440 + hour * 60 + minute - (offset or 0), 1440)
    try:
        shown = date.fromordinal(shifted).isoformat()
    except (ValueError, OverflowError):
        return None
    return f"{shown}T{minutes // 60:02}:{minutes % 60:02}:{second:02}" + ("" if offset is None else "Z")


def ids(text: str) -> list[str]:
    """The ids of a header: from each ``<`` to the next bracket; of a text without any, the one word that it is."""
    if "<" not in text:
        return [text.strip()] if re.fullmatch(r"\s*\S+\s*", text) else []
    return [x for m in re.finditer(r"<([^<>]*)", text) if (x := m[1].strip())]


def one_id(text: str) -> str | None:
    """The first id of a header, or the whole value where it has no bracket."""
    return next(iter(ids(text)), None) if "<" in text else text.strip() or None


def _told(reason: str, text: str) -> str:
    shown = "".join(c if c.isprintable() or not c.isascii() else c.encode("unicode_escape").decode() for c in " ".join(text.split()))
    return f"{reason}: {shown[:200]}{'…' * (len(shown) > 200)}"


#: A piece of an address list that no separator can stand in, or one character.
_UNIT = re.compile(r'"(?:\\.|[^"\\])*"?|=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?=|<[^>]*>?|\\.|.', re.S)


def _entries(text: str) -> list[str]:
    """The entries of an address list, those of groups without the group's name."""
    out, own, depth = [], "", 0
    for unit in _UNIT.findall(text):
        if unit in "()" and (depth or unit == "("):
            depth += 1 if unit == "(" else -1
        if depth == 0 and unit in ",;":
            out.append(own)
            own = ""
        elif depth == 0 and unit == ":":
            own = ""
        else:
            own += unit
    return [e for e in (*out, own) if e.strip()]


def _is_address(text: str) -> bool:
    local, at, domain = text.rpartition("@")
    if not at:
        return bool(text) and all(c.isalnum() or c in ".-_+" for c in text)
    quoted = len(local) > 1 and local[0] == local[-1] == '"'
    return bool(local and domain) and not re.search(r"\s", domain) and (quoted or not re.search(r"\s", local))


def mailbox(entry: str) -> tuple[str | None, str | None]:
    """(``Name <address>``, None) of one entry of an address list, or (None, why it gives no address)."""
    bare, comments = _parted(entry)
    plain = re.sub(r"\s+", " ", bare).strip()
    angle = re.search(r"<([^>]*)>?\s*$", plain)
    address = angle[1].strip() if angle else plain if "@" in plain else ""
    name = plain[: angle.start()].strip() if angle else ""
    if len(name) > 1 and name[0] == name[-1] == '"':
        name = re.sub(r"\\(.)", r"\1", name[1:-1])
    name = words_decoded(name or (comments[-1] if comments else "")).strip()
    if address and _is_address(address):
        return f"{name} <{address.lower()}>" if name else f"<{address.lower()}>", None
    outside, shown = re.sub(r"=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?=", "", entry), words_decoded(entry)
    if "@" not in outside and "@" in shown:
        where = "in angle brackets is MIME-encoded, which RFC 2047 does not allow" if "<" in outside else "is part of a MIME-encoded name, so there is no address"
        return None, _told(f"the address {where}", shown)
    inner = re.search(r"<([^>]*)", outside)
    reason = "the address is empty" if inner and not inner[1].strip() else "not an address" if inner or "@" in outside else "no address"
    return None, _told(reason, shown)


def read(name: str, raw: bytes) -> tuple[list[str], list[str]]:
    """The values to record of one header, and the remarks on what of it is not recorded."""
    text = unfolded(raw)
    if not text.strip():
        return [], []
    if name == "subject":
        return [text], []
    if name == "date":
        found = moment(text)
        return ([found], []) if found else ([], [_told("not a date", text)])
    if name in ("message-id", "in-reply-to", "references"):
        found = [x for x in [one_id(text)] if x] if name == "message-id" else ids(text)
        return (found, []) if found else ([], [_told("no message id", text)])
    pairs = [mailbox(e) for e in _entries(re.sub(r"\r?\n(?=[ \t])", "", raw.decode("utf-8", "replace")))]
    return [v for v, _ in pairs if v], [r for _, r in pairs if r]
