"""The grammar of claims: what a subject, attribute, time, source and run may be, and a claim's line."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from claimwright.functions.batched import batched


def valid_subject(text: Column) -> Column:
    return F.lower(text).rlike(r"^(?:[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\z")


def valid_attribute(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9-]+:[a-z0-9-]+\z")


def valid_source(text: Column) -> Column:
    return text.rlike(r"^[^\s\p{Cntrl}]+\z")


def valid_run(text: Column) -> Column:
    return text.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")


def valid_time(text: Column) -> Column:
    """The strict spelling with a day that exists; second 60 is allowed here."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)Z\z")
    return shape & F.substring(text, 1, 10).try_cast("date").isNotNull()


def namespace(attribute: Column) -> Column:
    return F.split_part(attribute, F.lit(":"), F.lit(1))


def json_quote(text: Column) -> Column:
    """The JSON spelling of a string; null of null."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}\z', "$1"))


def json_type(value: Column) -> Column:
    """``string``, ``number``, ``boolean``, ``array``, ``object`` or ``null`` by the text's first character."""
    c = F.substring(F.ltrim(value), 1, 1)
    return (
        F.when(c == '"', "string").when(c == "{", "object").when(c == "[", "array").when(c.isin("t", "f"), "boolean").when(c == "n", "null").when(c.rlike("[-0-9]"), "number")
    )


def claim_line() -> Column:
    """The line of the claim in the columns at hand: members in the order of the format, without spaces."""
    members = [("subject", json_quote(F.col("subject"))), ("attribute", json_quote(F.col("attribute"))), ("value", F.col("value")),
               ("retracts", F.when(F.col("retracts").isNotNull(), F.to_json("retracts"))), ("time", json_quote(F.col("time"))),
               ("source", json_quote(F.col("source"))), ("run", json_quote(F.col("run")))]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in members]), F.lit("}"))


def claim_id() -> Column:
    return F.sha2(claim_line(), 256)


class _Spelt(float):
    """A number that keeps the text it was read from."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made

    def __repr__(self) -> str:
        return self.text


def _spell(node) -> str:
    """JSON text with sorted members and no spaces, numbers as they were read."""
    if isinstance(node, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_spell(node[k])}" for k in sorted(node)) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(_spell, node)) + "]"
    return node.text if isinstance(node, _Spelt) else json.dumps(node, ensure_ascii=False)


def canonical_text(text: str | None) -> str | None:
    """The one spelling of a JSON value; null where it is no JSON or null."""
    try:
        value = json.loads(text, parse_float=_Spelt, parse_int=_Spelt)
    except (TypeError, ValueError, RecursionError):
        return None
    return None if value is None else _spell(value)


def part_text(text: str | None, part: str | None) -> str | None:
    """The exact JSON text of a part of a value (steps joined by dots); null where it is missing."""
    try:
        node = json.loads(text, parse_float=_Spelt, parse_int=_Spelt)
        for step in part.split("."):
            node = node[int(step)] if isinstance(node, list) and step.isdigit() else node[step]
    except (AttributeError, TypeError, ValueError, KeyError, IndexError, RecursionError):
        return None
    return _spell(node)


_READER = json.JSONDecoder(parse_float=str, parse_int=str)
_SPACE, _COLON = re.compile(r"[ \t\r\n]*"), re.compile(r"[ \t\r\n]*:[ \t\r\n]*")


def value_text(line: str | None) -> str | None:
    """The member ``value`` of a JSON object exactly as it is written, the last if there are many; null where it is missing."""
    try:
        out, at = None, line.index("{") + 1
        while True:
            name, at = _READER.raw_decode(line, _SPACE.match(line, at).end())
            at = _COLON.match(line, at).end()
            end = _READER.raw_decode(line, at)[1]
            if name == "value":
                out = line[at:end]
            at = _SPACE.match(line, end).end()
            if line[at] != ",":
                return out
            at += 1
    except (AttributeError, TypeError, ValueError, IndexError, RecursionError):
        return None


#: For the write door only; queries compare the text that it wrote.
canonical = batched(canonical_text, "string")
json_part = batched(part_text, "string")
written_value = batched(value_text, "string")
