"""Views of the record: one row per claim, the standing set, scopes and moments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.operators.changes import standing_claims
from claimwright.plans.terms import closing

FIELDS = ("subject", "attribute", "value", "time", "source", "run", "retracts", "cid", "seq", "position")
#: The place of the open segment in record order.
HEAD = 9223372036854775807


def record(claims: DataFrame) -> DataFrame:
    """One row per claim id, that of its last place (seq, position); digests and ids in lower case."""
    rows = claims.select(
        F.lower("subject").alias("subject"), "attribute", "value", "time", "source", "run",
        F.transform("retracts", F.lower).alias("retracts"), F.lower("cid").alias("cid"), "seq", "position",
    )
    rest = [c for c in FIELDS if c not in ("cid", "seq", "position")]
    last = F.max(F.struct("seq", "position", *rest)).alias("f")
    return rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(last).select(*[F.col("cid") if c == "cid" else F.col(f"f.{c}").alias(c) for c in FIELDS])


def live(claims: DataFrame, attributes: list[str] | None = None, fields: tuple[str, ...] = ("value", "time", "source", "run")) -> DataFrame:
    """The standing claims (subject, attribute, cid, seq, *fields*), one row per claim, in one shuffle."""
    return standing_claims(claims, attributes, {f: F.col(f) for f in fields}).withColumnRenamed("claim", "cid")


def live_values(claims: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """The standing set: distinct (subject, attribute, value)."""
    return live(claims, attributes, ("value",)).select("subject", "attribute", "value").distinct()


def as_of(claims: DataFrame, cutoff: str | Column) -> DataFrame:
    """The claims recorded up to *cutoff*; times are compared as text."""
    return claims.where(F.col("time") <= cutoff)


def as_of_run(claims: DataFrame, run: str) -> DataFrame:
    """The claims as they stood at the end of *run*: earlier segments, earlier times in its last one, and its own.

    The run's last claim is a scalar subquery, so this stays one scan and a filter.
    """
    last = claims.where(F.col("run") == run).agg(F.max(F.struct("seq", "time"))).scalar()
    seq, time = last["seq"], last["time"]
    own = (F.col("run") == run) & (F.col("time") == time)
    return claims.where((F.col("seq") < seq) | ((F.col("seq") == seq) & ((F.col("time") < time) | own)))


def at(claims: DataFrame, given: str) -> DataFrame | None:
    """The claims as of a run id, a date (to its end) or a moment; None for a run that the record does not have."""
    if re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", given):
        return None if claims.where(F.col("run") == given).isEmpty() else as_of_run(claims, given)
    return as_of(claims, closing(given))


def is_digest(text: Column) -> Column:
    return text.rlike(r"^(?:[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\z")
