"""Reading typed values out of JSON text, as Spark expressions only.

Values of the record are JSON text. ``"7"`` and ``7`` are different values, so the
readers below look at the text's first character before they unquote anything.
All of them give null where the text is null, is no JSON, or has another type.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A JSON number, with white space around it (fixed by the JSON grammar).
NUMBER = r"^\s*-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\s*\z"
_INTEGERS = "decimal(38,18)"


def text_of(value: Column) -> Column:
    """The text of a JSON string, unescaped."""
    return F.when(value.rlike(r'^\s*"'), F.get_json_object(value, "$"))


def _whole(number: Column) -> Column:
    wide = number.try_cast(_INTEGERS)
    return F.when(wide == F.floor(wide), wide.try_cast("bigint"))


def integer_of(value: Column) -> Column:
    """A JSON number of whole value, or a JSON string of decimal digits, as bigint."""
    inner = F.regexp_extract(text_of(value), r"^ *([0-9]+) *\z", 1)
    return F.when(value.rlike(NUMBER), _whole(F.trim(value))).when(inner != "", inner.try_cast("bigint"))


def truth_of(value: Column) -> Column:
    """A JSON boolean, or the string true or false in any case, as text."""
    bare = F.regexp_extract(value, r"^\s*(true|false)\s*\z", 1)
    quoted = F.lower(text_of(value))
    return F.when(bare != "", bare).when(quoted.isin("true", "false"), quoted)


def word_of(value: Column, *words: str) -> Column:
    """A JSON string that, trimmed and in lower case, is one of *words*."""
    word = F.lower(F.regexp_replace(text_of(value), r"^\s+|\s+\z", ""))
    return F.when(word.isin(*words), word)


def decimal_member(value: Column, member: str) -> Column:
    """Member *member* of a JSON object, a number or a string of a plain decimal number, as double."""
    part = F.try_variant_get(F.try_parse_json(value), f"$.{member}", "variant")
    kind = F.schema_of_variant(part)
    text = F.try_variant_get(part, "$", "string")
    return F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"), text.try_cast("double"))).when(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(part, "$", "double")
    )
