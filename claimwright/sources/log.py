"""Segments of the record as text: strict reading, writing in sealed order, the chain."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.functions import grammar
from claimwright.plans.skew import union_all

LINE = "subject string, attribute string, value string, retracts array<string>, time string, source string, run string"
MEMBERS = [c.split()[0] for c in LINE.split(", ")]
#: The member of a header that holds the generation; a parameter of an archive.
HEADER = "segment"


def parse_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Claim lines (value) as claims with their id, ``fault`` where a line is none, and the columns *keep*.

    The id is that of the bytes read, and a value keeps the spelling of the line. Unknown members, both or neither of value and
    retracts, a null value and ill-formed fields are faults.
    """
    line = F.col("value")
    row = F.from_json(line, LINE, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(line)
    df = lines.select(*keep, line.alias("line"), keys.alias("keys"), row.alias("r"))
    value = F.get_json_object("line", "$.value")
    text = F.when(F.array_contains("keys", "value"), F.to_json(F.try_variant_get(F.try_parse_json("line"), "$.value", "variant")))
    df = df.withColumns({**{k: F.col("r")[k] for k in MEMBERS if k != "value"}, "value": text, "has_value": value.isNotNull()})
    extra = F.size(F.array_except("keys", F.array(*map(F.lit, MEMBERS)))) > 0
    good = grammar.valid_subject(F.col("subject")) & grammar.valid_attribute(F.col("attribute")) & grammar.valid_source(F.col("source")) & grammar.valid_time(F.col("time"))
    good = good & (F.col("run").isNull() | grammar.valid_run(F.col("run")))
    fault = (
        F.when(F.col("keys").isNull(), "no object").when(extra, "unknown member").when((F.col("value") == "null"), "null value")
        .when(F.col("has_value") & F.col("retracts").isNotNull(), "both").when(~F.col("has_value") & F.col("retracts").isNull(), "neither")
        .when(F.size("retracts") == 0, "empty retracts").when(~F.coalesce(good, F.lit(False)), "field")
    )
    written = F.when(F.col("value").isNotNull(), F.coalesce(grammar.written_value("line"), "value")).alias("value")
    return df.select(*keep, F.lower("subject").alias("subject"), "attribute", written, "time", "source", "run", "retracts", F.sha2("line", 256).alias("cid"), "line", fault.alias("fault"))


def claim_lines(claims: DataFrame) -> DataFrame:
    """The line of each claim."""
    return claims.select("*", grammar.claim_line().alias("line"))


def read_segments(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_lines(spark.read.text(list(paths)))


def chain(links: Iterable[tuple[str, str | None]], last: str) -> list[str]:
    """The segments from first to *last*; a missing link or a cycle is an error that names who named it."""
    previous, out, at, by = dict(links), [], last, "the open segment"
    while at is not None:
        if at not in previous:
            raise LookupError(f"segment {at} is missing; {by} names it")
        if at in out:
            raise ValueError(f"segment {at} comes twice")
        out.append(at)
        at, by = previous[at], at
    return out[::-1]


def header(previous: str | None) -> str:
    """The first line of a segment; that of the first segment names none before it."""
    return json.dumps({HEADER: 1} | ({"previous": previous} if previous else {}), separators=(",", ":"))


def segment_digest(previous: str | None, lines: list[str]) -> str:
    return hashlib.sha256("".join(x + "\n" for x in (header(previous), *lines)).encode()).hexdigest()


def pieces(links: Iterable[tuple[str, str | None]]) -> list[list[str]]:
    """The maximal runs of linked segments; two heirs of one segment are an error."""
    previous = dict(links)
    heir: dict[str, str] = {}
    for name, before in previous.items():
        if before in heir:
            raise ValueError(f"{before} has two heirs")
        if before is not None:
            heir[before] = name
    out = []
    for name, before in previous.items():
        if before is None or before not in previous:
            run = [name]
            while run[-1] in heir:
                run.append(heir[run[-1]])
            out.append(run)
    return out


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Several logs as one, in their order: claims with ``part``, the 0-based place of the log they are from. Nothing is deduplicated."""
    return union_all([p.withColumn("part", F.lit(n)) for n, p in enumerate(parts)])
