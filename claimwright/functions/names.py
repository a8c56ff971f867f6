"""Scalar functions on names, places, sizes and texts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")


def basename(name: Column) -> Column:
    """What stands behind the last ``/`` or ``\\``, trimmed; null for nothing, ``.`` and ``..``."""
    last = F.trim(F.regexp_extract(name, r"([^/\\]*)\z", 1))
    return F.when(~last.isin("", ".", ".."), last)


def kebab(name: Column) -> Column:
    """Words in lower case joined by ``-``: breaks before a capital that follows a small letter or digit, or that starts a word."""
    text = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2")
    text = F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(text)


def legal(name: Column) -> Column:
    """A legal attribute name: other characters become one ``-``, none at the ends; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(kebab(name), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.when(text != "", text)


def byte_count(size: Column) -> Column:
    """A size for people: bytes below 1024, else in the binary unit that leaves less than 1024, one decimal below ten."""
    size = size.cast("double")
    out = F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(UNITS, 1):
        scaled = size / float(1024**power)
        shown = F.when(scaled < 10, F.format_string("%.1f " + unit, F.bround(scaled, 1))).otherwise(F.format_string("%.0f " + unit, F.bround(scaled, 0)))
        out = out.when(scaled < 1024, shown) if unit != UNITS[-1] else out.otherwise(shown)
    return out


def whole_byte_count(size: Column) -> Column:
    """A bound as it is said: in the greatest unit of up to a TiB that divides it."""
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(UNITS[:4], 1):
        step = F.lit(1024**power).cast("bigint")
        out = F.when((size > 0) & (size % step == 0), F.concat((size / step).cast("bigint").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def place(account: Column, folder: Column) -> Column:
    return F.concat(account, F.lit(":"), folder)


def account_of(text: Column) -> Column:
    return F.split_part(text, F.lit(":"), F.lit(1))


def folder_of(text: Column) -> Column:
    return F.when(F.instr(text, ":") > 0, F.substr(text, F.instr(text, ":") + 1))


def label(name: Column) -> Column:
    """A label with a leading ``\\`` as a place of the service's own."""
    return F.regexp_replace(name, r"^\\", "/")


def compare_key(message_id: Column) -> Column:
    """A Message-ID as it is compared: no brackets, no white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(message_id, r"^\s*<|>\s*\z", ""), r"\s", ""))


def message_ids(header: Column) -> Column:
    """The ids of a References-like header, in order."""
    return F.filter(F.transform(F.regexp_extract_all(header, F.lit(r"<([^<>]*)>?"), F.lit(1)), F.trim), lambda x: x != "")


def epoch(time: Column) -> Column:
    """Whole seconds since 1970 that a recorded time spells; null for no time, and where 32 bits without sign cannot hold them.

    Read with leniency: fractions are dropped, ``Z`` may be missing, and a day beyond the month's end runs on.
    """
    shape = r"^\+?([0-9]{1,9})-\+?([0-9]{1,9})-\+?([0-9]{1,9})T\+?([0-9]{1,9}):\+?([0-9]{1,9}):\+?([0-9]{1,9})(?:\..*)?Z?\z"
    year, month, day, hour, minute, second = (F.regexp_extract(time, "(?s)" + shape, i).try_cast("bigint") for i in range(1, 7))
    good = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (year <= 9999)
    first = F.when(good, F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    seconds = (F.unix_date(first).cast("bigint") + day - 1) * 86_400 + hour * 3_600 + minute * 60 + second
    return F.when(seconds.between(0, 4294967295), seconds)


def modified_text(seconds: Column, nanos: Column) -> Column:
    """A modification time with its exact fraction, trailing zeros trimmed."""
    from claimwright.operators.instants import spelled

    fraction = F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0"))
    return F.when(nanos == 0, spelled(seconds)).otherwise(F.concat(F.regexp_replace(spelled(seconds), "Z$", "."), fraction, F.lit("Z")))


def line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*\z")


def junk_percent(text: Column) -> Column:
    """Characters that written text cannot hold, as a rounded percent of those that are no white space; null if there are none.

    They are controls, the replacement character, private use and what is no character.
    """
    ink = F.regexp_replace(text, r"(?U)\s", "")
    clean = F.regexp_replace(ink, r"[\p{Cc}\p{Co}\x{FFFD}\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" if p else r"\x{FFFE}\x{FFFF}" for p in range(17)) + "]", "")
    size, junk = F.length(ink), F.length(ink) - F.length(clean)
    return F.when(size > 0, F.floor((junk * 100 + F.floor(size / 2)) / size).cast("int"))


def degrees(dms: Column, ref: Column) -> Column:
    """Signed decimal degrees of ``d/1 m/1 s/100``-like rationals and a reference letter; null if out of range."""
    part = lambda i: F.try_divide(
        F.split_part(F.get(F.split(dms, " "), F.lit(i)), F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(F.get(F.split(dms, " "), F.lit(i)), F.lit("/"), F.lit(2)).try_cast("double")
    )
    value = part(0) + F.coalesce(part(1), F.lit(0.0)) / 60 + F.coalesce(part(2), F.lit(0.0)) / 3600
    top = F.when(F.upper(ref).isin("N", "S"), 90).when(F.upper(ref).isin("E", "W"), 180)
    return F.when(value.between(0, top), value * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1))


def image_kind(content: Column) -> Column:
    """The kind of image that the first bytes of *content* announce."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").when(F.substring(head, 9, 8) == "66747970", "image/heif").when(head.startswith("474946383"), "image/gif")
    )
