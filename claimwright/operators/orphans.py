"""References to records that do not exist, per field and period (problem 3).

Parents and children go into one long form of tagged keys: (parent table, key, field,
period), where the field is null for a row of the parent table itself. One group per key
then shows whether the key has a parent; keys without one are orphans.

Only whether a reference exists is asked for ``found``: a group then gathers the set of its
(field, period), which combines before the one shuffle and is bounded by the periods, so a
key that a third of all rows refer to is one small row a task. Where references are
counted (``report``), they are counted per (parent table, key, field, period) before, in a
shuffle of their own. Digests travel as 32 bytes, not as 64 characters. Nothing is
broadcast and no row is joined.

Defined results: null keys and null periods refer to nothing and are left out; keys are
compared in lower case; repeated references count once in ``found`` and each in ``refs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.operators.instants import instant_of
from claimwright.plans.skew import union_all


def parent(rows: DataFrame, name: str, key: Column) -> DataFrame:
    """The keys that table *name* has."""
    missing = F.lit(None).cast("string")
    return rows.select(F.lit(name).alias("parent"), F.lower(key).alias("key"), missing.alias("field"), missing.alias("period"))


def child(rows: DataFrame, name: str, key: Column, field: str, period: Column) -> DataFrame:
    """References of *field* into table *name*."""
    long = rows.select(F.lit(name).alias("parent"), F.lower(key).alias("key"), F.lit(field).alias("field"), period.alias("period"))
    return long.where(F.col("period").isNotNull())


def _packed(key: Column) -> Column:
    """A key as bytes: a digest of 64 hexadecimal digits in half the size, other text as it is, told apart by the first byte."""
    digest = F.when(F.length(key) == 64, F.unhex(key))
    return F.coalesce(F.concat(F.lit(b"h"), digest), F.concat(F.lit(b"t"), F.encode(key, "UTF-8")))


def _unpacked(key: Column) -> Column:
    rest = F.substring(key, 2, 1 << 30)
    return F.when(F.substring(key, 1, 1) == F.lit(b"h"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def orphans(*long: DataFrame, counted: bool = False) -> DataFrame:
    """Rows (field, period, target) of the references in *long* whose key has no parent row; with *counted*, also ``refs``."""
    union = union_all(list(long)).where(F.col("key").isNotNull()).withColumn("key", _packed(F.col("key")))
    what, collect = ["field", "period"], F.collect_set
    if counted:
        union, collect = union.groupBy("parent", "key", *what).agg(F.count("*").alias("refs")), F.collect_list
        what = [*what, "refs"]
    by = collect(F.when(F.col("field").isNotNull(), F.struct(*what))).alias("by")
    keyed = union.groupBy("parent", "key").agg(F.bool_or(F.col("field").isNull()).alias("there"), by)
    rows = keyed.where(~F.col("there")).select(_unpacked(F.col("key")).alias("target"), F.explode("by").alias("by"))
    return rows.select("by.field", "by.period", "target", *[f"by.{c}" for c in what[2:]])


def held(blobs: DataFrame) -> DataFrame:
    """The digests of which a row is not removed."""
    return blobs.where(F.col("removed").isNull()).select(F.lower("digest").alias("digest"))


def record_orphans(claims: DataFrame, blobs: DataFrame, standing: DataFrame, counted: bool = False) -> DataFrame:
    """Orphans of the record: files neither store holds, and claims the record does not have."""
    month = lambda time: F.substring(instant_of(time), 1, 7)
    digest = F.when((F.col("attribute") == "prov:origin") & F.col("value").rlike(r'^\s*"'), F.regexp_extract(F.get_json_object("value", "$"), r"^([0-9a-fA-F]{64})\z", 1))
    ref = lambda table, key, field: F.named_struct(F.lit("parent"), F.lit(table), F.lit("key"), F.lower(key), F.lit("field"), F.lit(field).cast("string"))
    own = F.array(ref("claims", F.col("cid"), None), ref("blobs", F.col("subject"), "claims.subject"), ref("blobs", F.when(digest != "", digest), "claims.value"))
    named = F.transform(F.coalesce("retracts", F.array().cast("array<string>")), lambda i: ref("claims", i, "claims.retracts"))
    # One scan of the claims: each gives its own id as parent, and all that it refers to.
    cut = claims.select(month(F.col("time")).alias("month"), F.concat(own, named).alias("refs"))  # before the rows are multiplied
    cut = cut.select("month", F.explode("refs").alias("r")).select("r.parent", "r.key", "r.field", F.when(F.col("r.field").isNotNull(), F.col("month")).alias("period"))
    copied = standing.select("claim", month(F.col("asserted")).alias("month"))
    return orphans(
        parent(held(blobs), "blobs", F.col("digest")),
        cut.where(F.col("field").isNull() | F.col("period").isNotNull()),
        child(copied, "claims", F.col("claim"), "standing.claim", F.col("month")),
        counted=counted,
    )


def found(claims: DataFrame, blobs: DataFrame, standing: DataFrame) -> DataFrame:
    """Rows (field, period, target), each once."""
    return record_orphans(claims, blobs, standing)


def report(claims: DataFrame, blobs: DataFrame, standing: DataFrame) -> DataFrame:
    """Per field and period, the orphan targets and the references to them: (field, period, targets, refs)."""
    return record_orphans(claims, blobs, standing, counted=True).groupBy("field", "period").agg(F.count("*").alias("targets"), F.sum("refs").alias("refs"))
