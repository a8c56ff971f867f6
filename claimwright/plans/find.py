"""``find``: the subjects that meet all terms and lack what is missing, in one pass.

Instead of one INTERSECT an arm, the claims are scanned once, kept if any arm or any
missing name concerns them, and grouped by subject once with a flag for each; a subject
is found if all flags of arms are set and none of what is missing. Flags combine before
the shuffle, so a subject of very many claims stays one row a task. In the scope
``present`` the climb to a place starts from what was found, never from the whole archive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.operators.lineage import placed_hits
from claimwright.plans.record import live, record
from claimwright.plans.terms import Term, field_matches, part_of, text_matches, value_matches

SCOPES = ("present", "held", "record")


def _arms(terms: list[Term]) -> list[Column]:
    """One condition per attribute term, and one for all parts of an attribute: they hold on one value."""
    fields = reduce(lambda a, b: a & b, (field_matches(t.name, t.pattern) for t in terms if t.is_field), F.lit(True))
    named = [t for t in terms if not t.is_field]
    arms = [(F.col("attribute") == t.attribute) & value_matches(F.col("value"), t.pattern) for t in named if not t.part]
    for attribute in dict.fromkeys(t.attribute for t in named if t.part):
        parts = [value_matches(part_of(F.col("value"), t.part), t.pattern) for t in named if t.part and t.attribute == attribute]
        arms.append(reduce(lambda a, b: a & b, parts, F.col("attribute") == attribute))
    return [a & fields for a in arms] or [fields] * any(t.is_field for t in terms)


def _concerns(missing: str) -> Column:
    if missing.endswith(":"):
        return F.col("attribute").startswith(missing)
    attribute, _, part = missing.partition(".")
    is_it = F.col("attribute") == attribute
    return is_it & part_of(F.col("value"), part).isNotNull() if part else is_it


def _concerned(claims: DataFrame, terms: list[Term], missing: tuple[str, ...]) -> DataFrame:
    """The claims that can bear on the answer: retractions share the subject and attribute of what they take
    back, so conditions on these two go to the scan, below the standing set."""
    named = [t.attribute for t in terms if not t.is_field]
    if named:
        names = [F.col("attribute").isin(sorted({*named, *(m.partition(".")[0] for m in missing if not m.endswith(":"))}))]
        claims = claims.where(reduce(lambda a, b: a | b, names + [F.col("attribute").startswith(m) for m in missing if m.endswith(":")]))
    for t in terms:
        if t.name == "subject":
            claims = claims.where(text_matches(F.lower("subject"), t.pattern.lower()))
    return claims


def find(claims: DataFrame, terms: list[str | Term], missing: tuple[str, ...] = (), scope: str = "held") -> DataFrame:
    """Rows (subject). No terms and nothing missing finds nothing."""
    if scope not in SCOPES:
        raise ValueError(f"no scope: {scope}")
    terms = [t if isinstance(t, Term) else Term.parse(t) for t in terms]
    if any(t.name == "retract" for t in terms) and scope != "record":
        raise ValueError("retract asks for the scope record")
    bearing = _concerned(claims, terms, missing)
    rows = record(bearing) if scope == "record" else live(bearing, None, ("value", "time", "source", "run", "retracts"))
    arms, gone = _arms(terms), [_concerns(m) for m in missing]
    if not arms and not gone:
        return rows.select("subject").limit(0)
    if arms:
        rows = rows.where(reduce(lambda a, b: a | b, arms + gone))
    # An arm is null where its value is (a retraction): no match.
    flags = rows.groupBy("subject").agg(
        *[F.bool_or(F.coalesce(a, F.lit(False))).alias(f"a{i}") for i, a in enumerate(arms)], *[F.bool_or(F.coalesce(g, F.lit(False))).alias(f"m{i}") for i, g in enumerate(gone)]
    )
    keep = [F.col(f"a{i}") for i in range(len(arms))] + [~F.col(f"m{i}") for i in range(len(gone))]
    found = flags.where(reduce(lambda a, b: a & b, keep)).select("subject")
    return placed_hits(claims, found) if scope == "present" else found
