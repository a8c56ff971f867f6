"""The term language: patterns on JSON text and on plain text, as Spark conditions.

A pattern is read in this order; the first that fits wins: ``"literal"`` in quotes, a
glob with ``*`` or ``?``, ``lo..hi`` (numeric if each given bound is a JSON number, else
text on the quoted spelling; bare ``..`` is presence), a JSON scalar (which matches its
own spelling and the string of it), and plain text.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, functions as F

from claimwright.functions.grammar import valid_time
from claimwright.functions.jsontext import NUMBER

CLAIM_FIELDS = ("subject", "attribute", "source", "run", "time", "retract")


def quote(text: str) -> str:
    """JSON text of a string, spelt minimally."""
    return json.dumps(text, ensure_ascii=False)


def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression: ``*`` any run, ``?`` one character, ``[…]`` and ``[^…]`` classes.

    ``]`` right after the opening stands for itself, ``!`` does not negate, and a class
    that is never closed matches nothing.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[":
            start = i + 1 + glob.startswith("^", i + 1)
            end = glob.find("]", start + 1)
            if end < 0:
                return r"(?s)\A(?!)\z"
            inside = re.sub(r"([\\\[\]&^~])", r"\\\1", glob[start:end])
            out.append(("[^" if start == i + 2 else "[") + inside + "]")
            i = end
        else:
            out.append(re.escape(c) if ord(c) < 128 else c)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def _number(text: str) -> bool:
    return re.fullmatch(NUMBER.strip("^").replace(r"\z", ""), text) is not None


def _bounds(pattern: str) -> tuple[str, str] | None:
    low, dots, high = pattern.partition("..")
    return (low, high) if dots else None


def _between(value: Column, low, high) -> Column:
    parts = [value >= F.lit(low)] * (low is not None) + [value <= F.lit(high)] * (high is not None)
    return reduce(lambda a, b: a & b, parts)


def number_of(value: Column) -> Column:
    """The number that JSON text is, as double, else null."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def _no_constant(name: str):
    raise ValueError(f"no JSON: {name}")


def value_matches(value: Column, pattern: str) -> Column:
    """Whether JSON text *value* matches *pattern*."""
    if len(pattern) >= 2 and pattern[0] == pattern[-1] == '"':
        return value == quote(pattern[1:-1])
    if "*" in pattern or "?" in pattern:
        return value.rlike(glob_to_regex(f'"{pattern}"'))
    if bounds := _bounds(pattern):
        given = [b for b in bounds if b]
        if not given:
            return value.isNotNull()
        if all(map(_number, given)):
            return _between(number_of(value), *(float(b) if b else None for b in bounds))
        return value.startswith('"') & _between(value, *(quote(b) if b else None for b in bounds))
    try:
        scalar = json.loads(pattern, parse_int=lambda t: float(t) if t == "-0" else int(t), parse_constant=_no_constant)
    except ValueError:
        scalar = ""
    if not isinstance(scalar, str):
        return value.isin(spelled_json(scalar), quote(pattern))
    return value == quote(pattern)


def spelled_json(value) -> str:
    """The one spelling of a JSON value: members in order, no spaces, numbers as ``spelled_number`` has them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{quote(k)}:{spelled_json(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(spelled_json, value)) + "]"
    return spelled_number(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else json.dumps(value, ensure_ascii=False)


def spelled_number(value: int | float) -> str:
    """A number as the record spells it: 64-bit integers as they are, others as the shortest double, always with a point or an exponent."""
    if isinstance(value, int) and -(1 << 63) <= value < 1 << 64:
        return str(value)
    sign, digits, power = Decimal(repr(float(value))).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + power
    if text == "0":
        out = "0.0"
    elif 0 < point <= 16:
        out = f"{text[:point].ljust(point, '0')}.{text[point:] or '0'}"
    elif -5 < point <= 0:
        out = f"0.{'0' * -point}{text}"
    else:
        out = f"{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{point - 1}"
    return "-" * sign + out


def text_matches(text: Column, pattern: str) -> Column:
    """Whether plain text matches *pattern*."""
    if len(pattern) >= 2 and pattern[0] == pattern[-1] == '"':
        return text == pattern[1:-1]
    if "*" in pattern or "?" in pattern:
        return text.rlike(glob_to_regex(pattern))
    if bounds := _bounds(pattern):
        return _between(text, *(b or None for b in bounds)) if any(bounds) else text.isNotNull()
    return text == pattern


def is_date(text: str) -> bool:
    return re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text, re.ASCII) is not None


def _moment(given: str, edge: str) -> str:
    """*given* as a strict UTC time: a date is widened by *edge*, a moment may lack its ``Z``; all else is refused."""
    text = given.strip()
    text += edge if is_date(text) else ""
    text += "Z" if len(text) == 19 and not text.endswith("Z") else ""
    try:
        date.fromisoformat(text[:10])
    except ValueError:
        raise ValueError(f"no time: {given}") from None
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)Z", text, re.ASCII):
        raise ValueError(f"no time: {given}")
    return text


def opening(given: str) -> str:
    """The first moment of what *given* names."""
    return _moment(given, "T00:00:00")


def closing(given: str) -> str:
    """The last moment of what *given* names."""
    return _moment(given, "T23:59:59")


def widened(given: Column, edge: str) -> Column:
    """``opening`` (edge ``T00:00:00``) or ``closing`` (``T23:59:59``) of a column; null where it is refused."""
    text = F.regexp_replace(given, r"(?U)^\s+|\s+\z", "")
    text = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.concat(text, F.lit(edge))).otherwise(text)
    text = F.when((F.length(text) == 19) & ~text.endswith("Z"), F.concat(text, F.lit("Z"))).otherwise(text)
    return F.when(valid_time(text), text)


def time_matches(time: Column, pattern: str) -> Column:
    """Whether a claim's time matches: a date is its whole day, a range opens and closes with its days, a moment is itself."""
    if (len(pattern) >= 2 and pattern[0] == pattern[-1] == '"') or "*" in pattern or "?" in pattern:
        return text_matches(time, pattern)
    if bounds := _bounds(pattern):
        low, high = bounds
        return _between(time, opening(low) if low else None, closing(high) if high else None) if low or high else time.isNotNull()
    return time.between(opening(pattern), closing(pattern)) if is_date(pattern) else time == closing(pattern)


def field_matches(field: str, pattern: str) -> Column:
    """Whether a claim's field matches *pattern*."""
    if field == "time":
        return time_matches(F.col("time"), pattern)
    if field == "retract":
        if pattern.strip('"') not in ("true", "false"):
            raise ValueError("retract is true or false")
        return F.col("retracts").isNotNull() == (pattern.strip('"') == "true")
    return text_matches(F.col(field), pattern.lower() if field == "subject" else pattern)


def part_path(part: str) -> str:
    """The JSON path of the steps of a part; digits are places of an array."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in part.split("."))


def part_of(value: Column, part: str) -> Column:
    """The JSON text of a part of a value, null where it is missing. Numbers are spelt anew."""
    got = F.try_variant_get(F.try_parse_json(value), part_path(part), "variant")
    return F.to_json(got)


@dataclass(frozen=True)
class Term:
    """``name=pattern``: of an attribute, of a part of one (``ns:name.step…``), or of a claim field."""

    name: str
    pattern: str

    @property
    def is_field(self) -> bool:
        return self.name in CLAIM_FIELDS

    @property
    def attribute(self) -> str:
        return self.name.split(".", 1)[0]

    @property
    def part(self) -> str | None:
        return self.name.split(".", 1)[1] if "." in self.name else None

    @classmethod
    def parse(cls, word: str) -> Term:
        name, is_term, pattern = word.partition("=")
        if not is_term or not (name in CLAIM_FIELDS or re.fullmatch(r"[a-z0-9-]+:[a-z0-9-]+(?:\.[a-z0-9-]+)*", name)):
            raise ValueError(f"no term: {word}")
        return cls(name, pattern)
