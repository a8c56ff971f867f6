"""Mixed timestamp spellings brought to one UTC spelling (problem 5).

Every format is an alternative of **one** regular expression with named groups. One
``regexp_replace`` pass writes the groups of the alternative that matched into a
separated list, from which the components are taken; nothing is matched twice. Ranges
are checked on integers, and the moment is assembled by integer day arithmetic. All of
it runs in the JVM; no Python touches a row.

Defined results: null, empty or blank text, text of no known form, an impossible day or
time of day (second 60 too), an unknown zone name, and local times without a known zone,
or that occur twice or never in it, all give null. Fractions are dropped, not rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Month names, and the zone names of RFC 5322 with their neighbours (minutes).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONES = {
    "z": 0, "gmt": 0, "ut": 0, "utc": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "cet": 60, "cest": 120,
}

SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"

_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
_PARTS = ("year", "month", "day", "first", "second", "hour", "minute", "sec", "half", "zone", "epoch", "milli")


def _format(tag: str, pattern: str) -> str:
    """The alternative *pattern*; <name:regex> is a named group, <clock> and <zone> are shared pieces."""
    clock = r"<hour:[0-9]{1,2}>:<minute:[0-9]{2}>(?::<sec:[0-9]{2}>(?:[.,][0-9]+)?)?(?:\s*<half:[ap]m>)?"
    zone = r"(?:\s*<zone:[+-][0-9]{2}(?::?[0-9]{2})?|[a-z]+>)?"
    text = pattern.replace("<clock>", clock).replace("<zone>", zone)
    for name in _PARTS:
        text = text.replace(f"<{name}:", f"(?<{name}{tag}>")
    return _close(text)


def _close(text: str) -> str:
    """Turns the ``>`` that ends a ``<name:…>`` piece into the ``)`` of its group."""
    out, depth, i = [], 0, 0
    while i < len(text):
        if text.startswith("(?<", i) and text[i + 3] not in "=!":
            end = text.index(">", i)
            out.append(text[i : end + 1])
            i, depth = end + 1, depth + 1
            continue
        out.append(")" if text[i] == ">" and depth else text[i])
        depth -= text[i] == ">" and depth > 0
        i += 1
    return "".join(out)


FORMATS = {
    "a": r"<year:[0-9]{4}>-<month:[0-9]{2}>-<day:[0-9]{2}>(?:t|\s+)<clock><zone>",
    "b": r"<year:[0-9]{4}><month:[0-9]{2}><day:[0-9]{2}>t<hour:[0-9]{2}><minute:[0-9]{2}>(?:<sec:[0-9]{2}>(?:[.,][0-9]+)?)?<zone>",
    "c": rf"{_WEEKDAY}<day:[0-9]{{1,2}}>(?:\s+|-)<month:{_MONTH}>\.?(?:,?\s+|-)<year:[0-9]{{4}}|[0-9]{{2}}>,?\s+<clock><zone>",
    "d": rf"{_WEEKDAY}<month:{_MONTH}>\.?\s+<day:[0-9]{{1,2}}>\s+<clock>(?:\s+<zone:[+-][0-9]{{2}}(?::?[0-9]{{2}})?|[a-z]+>)?\s+<year:[0-9]{{4}}>",
    "e": rf"{_WEEKDAY}<month:{_MONTH}>\.?\s+<day:[0-9]{{1,2}}>,?\s+<year:[0-9]{{4}}>,?\s+<clock><zone>",
    "f": r"<first:[0-9]{1,2}>[./-]<second:[0-9]{1,2}>[./-]<year:[0-9]{4}|[0-9]{2}>,?\s+<clock><zone>",
    "g": r"<epoch:[0-9]{10}>",
    "h": r"<milli:[0-9]{13}>",
}
PATTERN = "(?is)^(?:" + "|".join(_format(tag, p) for tag, p in FORMATS.items()) + r")\z|^.*\z"
_USED = {name: "".join(f"${{{name}{tag}}}" for tag in FORMATS if f"(?<{name}{tag}>" in PATTERN) for name in _PARTS}
_TEMPLATE = "|".join(_USED[name] for name in _PARTS)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a day of the proleptic Gregorian calendar, on integers."""
    shifted = y - (m <= 2).cast("int")
    month = (m + 9) % 12
    return (
        shifted * 365 + F.floor(shifted / 4) - F.floor(shifted / 100) + F.floor(shifted / 400)
        + F.floor((month * 153 + 2) / 5) + d - 1 - 719468
    ).cast("bigint")


def _month_days(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def spelled(seconds: Column) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DDThh:mm:ssZ``; null outside the years 1 to 9999."""
    day = F.floor(seconds / 86400)
    rest = seconds - day * 86400
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    text = F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z")
    )
    return F.when(seconds.between(-62135596800, 253402300799), text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of *value*, which is computed once; keeps deep expressions from being repeated in a plan."""
    return F.transform(F.array(value), body)[0]


def _fields(parts: Column, order: Column) -> Column:
    """The components of one reading, as a struct of numbers; null where there is none."""
    at = {name: parts[i] for i, name in enumerate(_PARTS)}
    number = {k: at[k].try_cast("int") for k in ("year", "day", "first", "second", "hour", "minute")}
    name = F.lower(F.substring(at["month"], 1, 3))
    named = reduce(lambda w, m: w.when(name == m[1][:3], m[0]), enumerate(MONTHS, 1), F.when(at["month"].rlike("^[0-9]"), at["month"].try_cast("int")))
    numeric, half = at["first"] != "", F.lower(at["half"])
    digits = F.regexp_replace(at["zone"], "[^0-9]", "")
    off_hours, off_minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    written = F.when((off_hours <= 23) & (off_minutes <= 59), (off_hours * 60 + off_minutes) * F.when(at["zone"].startswith("-"), -1).otherwise(1))
    known = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    half_hour = number["hour"] % 12 + F.when(half == "pm", 12).otherwise(0)
    fields = {
        "y": F.when(F.length(at["year"]) == 2, number["year"] + 2000).otherwise(number["year"]),
        "m": F.when(numeric, F.when(order == "dmy", number["second"]).when(order == "mdy", number["first"])).otherwise(named),
        "d": F.when(numeric, F.when(order == "dmy", number["first"]).when(order == "mdy", number["second"])).otherwise(number["day"]),
        "h": F.when(half == "", F.when(number["hour"] <= 23, number["hour"])).otherwise(F.when(number["hour"].between(1, 12), half_hour)),
        "mi": number["minute"],
        "s": F.when(at["sec"] == "", 0).otherwise(at["sec"].try_cast("int")),
        "zoned": at["zone"] != "",
        "offset": F.when(at["zone"].rlike("^[+-]"), written).otherwise(F.try_element_at(known, F.lower(at["zone"]))),
        "epoch": F.when(at["epoch"] != "", at["epoch"].try_cast("bigint")).when(at["milli"] != "", F.floor(at["milli"].try_cast("bigint") / 1000)),
    }
    # Names as arguments: aliases inside a lambda are lost where a generator stands in the same projection.
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def _seconds(r: Column, zone: Column) -> Column:
    y, m, d = r["y"], r["m"], r["d"]
    valid = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m)) & r["h"].isNotNull() & (r["mi"] <= 59) & (r["s"] <= 59)
    wall = F.when(valid, _days(y, m, d) * 86400 + r["h"] * 3600 + r["mi"] * 60 + r["s"])
    placed = _let(wall, lambda w: F.when(r["zoned"], w - r["offset"] * 60).otherwise(from_local(w, zone)))
    return F.coalesce(r["epoch"], placed).cast("bigint")


def _nested(levels: int) -> str:
    """A pair of parentheses with up to *levels* pairs inside one another; possessive, so text without an end costs one look."""
    out = r"\([^()]*+\)"
    for _ in range(levels - 1):
        out = rf"\((?:[^()]++|{out})*+\)"
    return out


#: Levels of parentheses that one pass takes away.
LEVELS = 8
_COMMENT = _nested(LEVELS)


def without_comments(text: Column) -> Column:
    """*text* with what stands in parentheses, at any depth, as a space; passes go on until one changes nothing."""
    state = lambda now, done: F.named_struct(F.lit("now"), now, F.lit("done"), done)
    most = F.floor((F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))) / LEVELS).cast("int") + 1
    one = lambda acc, _: F.when(acc["done"], acc).otherwise(_let(F.regexp_replace(acc["now"], _COMMENT, " "), lambda n: state(n, n == acc["now"])))
    passed = F.aggregate(F.sequence(F.lit(1), most), state(text, F.lit(False)), one)["now"]
    return F.when(F.contains(text, F.lit("(")), passed).otherwise(text)


def read_text(text: Column, zone: Column | None = None, order: Column | None = None) -> Column:
    """Seconds since 1970 of the one moment that *text* names, or null.

    *zone* is the IANA zone of local times, *order* the order (``dmy`` or ``mdy``) of
    all-numeric dates; without them such texts name no moment.
    """
    missing = F.lit(None).cast("string")
    parts = F.split(F.regexp_replace(F.regexp_replace(without_comments(text), r"^\s+|\s+\z", ""), PATTERN, _TEMPLATE), r"\|")
    fields = lambda p: _let(_fields(p, missing if order is None else order), lambda r: _seconds(r, missing if zone is None else zone))
    return F.when(text.isNotNull(), _let(parts, fields))


def from_local(wall: Column, zone: Column) -> Column:
    """The moment of local seconds *wall* in *zone*; null if it occurs twice or never there.

    The zone's offsets a day before and a day after give the two candidates; those that
    read back as *wall* are moments of it. The zone must be a name that Spark knows.
    """
    there = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone))
    guesses = F.array_distinct(F.array(2 * wall - 86400 - there(wall - 86400), 2 * wall + 86400 - there(wall + 86400)))
    hits = F.filter(guesses, lambda g: there(g) == wall)
    return F.when(wall.isNotNull() & zone.isNotNull(), _let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0)))))


def instant_of(time: Column) -> Column:
    """The instant of a claim's time as text: itself if well spelt, else its reading."""
    strict = time.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z")
    day = F.substring(time, 1, 10)
    return F.when(strict, F.when(day.try_cast("date").isNotNull() & ~day.startswith("0000"), time)).otherwise(_let(read_text(time), spelled))


def known_zones(accounts: DataFrame) -> DataFrame:
    """Accounts whose zone name Spark knows, one row per mailbox, as (mailbox, zone, date_order).

    Of several rows of a mailbox the least counts if they agree on the zone; a mailbox
    with two zones has no known zone and is left out.
    """
    good = F.expr("try_make_timestamp(2000, 1, 1, 0, 0, 0, zone)").isNotNull()
    rows = accounts.where(F.col("mailbox").isNotNull() & F.col("zone").isNotNull() & good)
    merged = rows.groupBy("mailbox").agg(F.min("zone").alias("zone"), F.max("zone").alias("_other"), F.min("date_order").alias("_low"), F.max("date_order").alias("_high"))
    return merged.where(F.col("zone") == F.col("_other")).select("mailbox", "zone", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("date_order"))


def log_instants(vault_logs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows (row_key, instant) of the vault logs whose date names exactly one moment.

    The accounts are joined by mailbox; Spark broadcasts them if they are small.
    Repeated rows count once; a null log_id has no key and is left out.
    """
    logs = vault_logs.select("log_id", "mailbox", "date").where(F.col("log_id").isNotNull() & F.col("date").isNotNull())
    joined = logs.join(known_zones(accounts), "mailbox", "left")
    instant = _let(read_text(F.col("date"), F.col("zone"), F.col("date_order")), spelled)
    rows = joined.select(F.col("log_id").cast("string").alias("row_key"), instant.alias("instant"))
    return rows.where(F.col("instant").isNotNull()).distinct()


def claim_instants(claims: DataFrame) -> DataFrame:
    """Rows (row_key, instant) of the claims whose time is not yet in the one spelling but names a moment."""
    odd = claims.select("cid", "time").where(F.col("cid").isNotNull() & ~F.col("time").rlike(SHAPE))
    return odd.select(F.lower("cid").alias("row_key"), instant_of(F.col("time")).alias("instant")).where(F.col("instant").isNotNull()).distinct()


def found(vault_logs: DataFrame, accounts: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows (place, row_key, instant) of both tables."""
    both = log_instants(vault_logs, accounts).withColumn("place", F.lit("vault_logs")).unionByName(claim_instants(claims).withColumn("place", F.lit("claims")))
    return both.select("place", "row_key", "instant")
