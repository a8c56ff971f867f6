"""Offline surgery on the record: dropping, renaming and restating claims, as new versions of its rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimwright.functions.grammar import claim_id, claim_line, json_quote
from claimwright.operators.lineage import edges, only_from
from claimwright.plans.record import live, live_values, record


def unextract(claims: DataFrame, prefix: str = "extractor:") -> DataFrame:
    """The record without the claims of extractors, and without retractions that name only those."""
    rows = record(claims)
    gone = rows.where(F.col("source").startswith(prefix)).select(F.col("cid").alias("target"), F.lit(True).alias("gone"))
    named = rows.where(F.col("retracts").isNotNull()).select("cid", F.explode("retracts").alias("target")).join(gone, "target", "left")
    idle = named.groupBy("cid").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("idle")).where("idle")
    return rows.where(~F.col("source").startswith(prefix)).join(idle.select("cid"), "cid", "left_anti")


def remove(claims: DataFrame, doomed: DataFrame, kept: DataFrame) -> DataFrame:
    """The record without the files *doomed* (subject): their claims, links to them, extractor claims on files
    that came only from them and that *kept* (subject) lacks, and retractions that this leaves empty."""
    rows = record(claims)
    fallen = only_from(edges(claims), doomed, kept)
    derived = fallen.join(doomed, "subject", "left_anti").withColumn("derived", F.lit(True))
    direct = doomed.select("subject").distinct().withColumn("doomed", F.lit(True))
    linked = doomed.select(F.concat(F.lit('"'), F.col("subject"), F.lit('"')).alias("value")).distinct().withColumn("link", F.lit(True))
    marked = rows.join(direct, "subject", "left").join(derived, "subject", "left").join(linked, "value", "left")
    drop = F.coalesce("doomed", F.lit(False)) | (F.coalesce("derived", F.lit(False)) & F.col("source").startswith("extractor:")) | (F.coalesce("link", F.lit(False)) & (F.col("attribute") == "prov:origin"))
    split = marked.withColumn("drop", drop)
    lost = split.where("drop").select(F.col("cid").alias("target"), F.lit(True).alias("lost"))
    left = split.where(~F.col("drop")).drop("doomed", "derived", "link", "drop")
    named = left.where(F.col("retracts").isNotNull()).select("cid", F.explode("retracts").alias("target")).join(lost, "target", "left")
    empty = named.groupBy("cid").agg(F.bool_and(F.coalesce("lost", F.lit(False))).alias("empty")).where("empty")
    return left.join(empty.select("cid"), "cid", "left_anti")


#: Attributes whose values name files.
LINKS = ("prov:origin",)
#: Attributes that describe a file's bytes.
OF_THE_BYTES = ("file:size", "file:mime")


def rehash(claims: DataFrame, names: DataFrame, bits: int = 512) -> DataFrame:
    """The record under another digest: rows (cid, new_cid, subject, attribute, value, retracts, time, source, run).

    *names* (old, new) are the files' digests. Subjects and link values are renamed; claims
    about, or linking to, a file without a new name have a null ``new_cid``. Ids are digests of
    the new lines; retractions come after the assertions, so that they name new ids; an id that
    names no claim stays as it is.
    """
    rows = record(claims)
    name = lambda c, n: names.select(F.lower("old").alias(c), F.lower("new").alias(n))
    link = F.when(F.col("attribute").isin(*LINKS) & F.col("value").startswith('"'), F.lower(F.get_json_object("value", "$")))
    rows = rows.withColumn("_link", link).join(name("subject", "_subject"), "subject", "left").join(name("_link", "_linked"), "_link", "left")
    kept = F.col("_subject").isNotNull() & (F.col("_link").isNull() | F.col("_linked").isNotNull())
    rows = rows.withColumns({"_kept": kept, "value": F.when(F.col("_link").isNotNull(), json_quote(F.col("_linked"))).otherwise(F.col("value")), "subject": F.coalesce("_subject", "subject")})
    fields = ["subject", "attribute", "value", "retracts", "time", "source", "run"]
    made = lambda df: df.withColumn("new_cid", F.when(F.col("_kept"), F.sha2(claim_line(), bits))).select("cid", "new_cid", *fields)
    asserted = made(rows.where(F.col("retracts").isNull()))
    taken = rows.where(F.col("retracts").isNotNull())
    named = taken.select("cid", F.posexplode("retracts").alias("n", "target")).join(asserted.select(F.col("cid").alias("target"), "new_cid"), "target", "left")
    lists = named.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.coalesce("new_cid", "target").alias("t")))), lambda x: x["t"]).alias("retracts"))
    return asserted.unionByName(made(taken.drop("retracts").join(lists, "cid")))


def replace(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims to write for replacements *pairs* (old, new): what stands about a replaced file, said of its replacement.

    Left out are claims that describe its bytes or come from extractors, and values that the replacement
    already has. Times, sources and runs are those of the old claims; of several claims of one
    value the first by (time, cid) is said again.
    """
    rows = live(claims).where(~F.col("attribute").isin(*OF_THE_BYTES) & ~F.col("source").startswith("extractor:"))
    moved = rows.join(pairs.select(F.lower("old").alias("subject"), F.lower("new").alias("_new")).distinct(), "subject").drop("subject").withColumnRenamed("_new", "subject")
    first = moved.groupBy("subject", "attribute", "value").agg(F.min(F.struct("time", "cid", "source", "run")).alias("f"))
    fresh = first.join(live_values(claims), ["subject", "attribute", "value"], "left_anti")
    out = fresh.select("subject", "attribute", "value", F.lit(None).cast("array<string>").alias("retracts"), "f.time", "f.source", "f.run")
    return out.withColumn("cid", claim_id())


def by_ids(lines: DataFrame) -> DataFrame:
    """Old lines whose retractions name a value, not ids, in the current form: rows (n, line) of *lines* (n, line).

    ``n`` orders the log. ``retract: true`` with a value takes back the assertions of that value that then
    stand, without one all of its subject and attribute; one that takes nothing back is dropped.
    The log is replayed per (subject, attribute), streaming, with what stands as the only state.
    """
    fields = "subject string, attribute string, value variant, retract boolean, retracts array<string>, time string, source string, run string"
    row = F.from_json("line", fields)
    # The attribute and subject of a retraction are those of what it takes back, so each key is a log of its own.
    keyed = lines.select("n", "line", row.alias("r")).select("n", "line", "r.subject", "r.attribute").repartition("subject", "attribute").sortWithinPartitions("subject", "attribute", "n")

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, standing = None, {}
        for part in parts:
            out = []
            for n, line, subject, attribute in zip(part["n"].tolist(), part["line"].tolist(), part["subject"].tolist(), part["attribute"].tolist()):
                if key != (subject, attribute):
                    key, standing = (subject, attribute), {}
                raw = json.loads(line)
                if raw.get("retract") is not True:
                    if "retracts" in raw:
                        gone = set(raw["retracts"])
                        standing = {v: [i for i in ids if i not in gone] for v, ids in standing.items()}
                    elif "value" in raw:
                        standing.setdefault(json.dumps(raw["value"], sort_keys=True), []).append(hashlib.sha256(line.encode()).hexdigest())
                    out.append((n, line))
                    continue
                taken = standing.pop(json.dumps(raw["value"], sort_keys=True), []) if "value" in raw else [i for ids in standing.values() for i in ids]
                if "value" not in raw:
                    standing = {}
                if taken:
                    new = {"subject": subject, "attribute": attribute, "retracts": taken} | {k: raw[k] for k in ("time", "source", "run") if k in raw}
                    out.append((n, json.dumps(new, ensure_ascii=False, separators=(",", ":"))))
            yield pd.DataFrame(out, columns=["n", "line"])

    return keyed.mapInPandas(replay, "n bigint, line string")


def restate(claims: DataFrame, old: str, new: str) -> DataFrame:
    """Standing values under *old* that *new* lacks: (subject, value) to be claimed as *new*."""
    both = live_values(claims, [old, new])
    rows = lambda a: both.where(F.col("attribute") == a).select("subject", "value")
    return rows(old).join(rows(new), ["subject", "value"], "left_anti")

