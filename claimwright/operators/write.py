"""Claims to be written: sightings, annotations, retractions, receipts. Each gives rows, not effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.functions.grammar import claim_id, json_quote
from claimwright.plans.record import live

CLAIM = ("subject", "attribute", "value", "time", "source", "run", "retracts", "cid")


def _claims(rows: DataFrame, facts: dict[str, Column], time: Column, source: str, run: str) -> DataFrame:
    """One claim per row and fact whose value is not null."""
    made = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in facts.items()])
    df = rows.select("subject", time.alias("time"), F.explode(made).alias("f")).where(F.col("f.value").isNotNull())
    df = df.select("subject", "f.attribute", "f.value", "time", F.lit(source).alias("source"), F.lit(run).alias("run"), F.lit(None).cast("array<string>").alias("retracts"))
    return df.withColumn("cid", claim_id()).select(*CLAIM)


def ingest(files: DataFrame, host: str, run: str) -> DataFrame:
    """Day-one facts of listed files (subject, path, size, mime, modified, time, fresh).

    Path, name, host and modification on every sighting; size and mime for new bytes only.
    """
    new = lambda c: F.when(F.col("fresh"), c)
    facts = {
        "file:path": json_quote(F.col("path")), "file:name": json_quote(F.element_at(F.split("path", "/"), -1)), "prov:host": json_quote(F.lit(host)),
        "file:modified": json_quote(F.col("modified")), "file:size": new(F.col("size").cast("string")), "file:mime": new(json_quote(F.col("mime"))),
    }
    return _claims(files, facts, F.col("time"), "ingest", run)


def admit(files: DataFrame, held: DataFrame) -> DataFrame:
    """Listed files (subject, …) each once, with whether their bytes are new to *held* (digest)."""
    known = held.select(F.col("digest").alias("subject"), F.lit(True).alias("known")).distinct()
    return files.join(known, "subject", "left").withColumn("fresh", F.col("known").isNull()).drop("known")


def annotate(subjects: DataFrame, texts: dict[str, list[str]], time: str, run: str) -> DataFrame:
    """Comments, then tags, on each subject: *texts* by attribute."""
    made = F.array(*[F.struct(F.lit(a).alias("attribute"), json_quote(F.lit(t)).alias("value")) for a, ts in texts.items() for t in ts])
    df = subjects.select("subject", F.explode(made).alias("f")).select(
        "subject", "f.attribute", "f.value", F.lit(time).alias("time"), F.lit("user").alias("source"), F.lit(run).alias("run"), F.lit(None).cast("array<string>").alias("retracts")
    )
    return df.withColumn("cid", claim_id()).select(*CLAIM)


def retract(claims: DataFrame, attribute: str, condition: Column, time: str, run: str, source: str = "user") -> DataFrame:
    """One retraction per subject that takes back its standing claims of *attribute* that meet *condition*."""
    rows = live(claims, [attribute], ("value",)).where(condition)
    taken = rows.groupBy("subject", "attribute").agg(F.sort_array(F.collect_set("cid")).alias("retracts"))
    df = taken.select("subject", "attribute", F.lit(None).cast("string").alias("value"), F.lit(time).alias("time"), F.lit(source).alias("source"), F.lit(run).alias("run"), "retracts")
    return df.withColumn("cid", claim_id()).select(*CLAIM)


def retract_all(claims: DataFrame, asked: DataFrame, time: str, run: str, source: str = "user") -> tuple[DataFrame, DataFrame]:
    """Retractions of all that is *asked* (subject, attribute, pattern), or of nothing: (retractions, unmet).

    A pattern is a value as it is written, a string with or without quotes, or ``..`` for every value of the
    attribute; globs are refused. ``unmet`` has what stands nowhere; with a row in it there are no retractions.
    """
    named = asked.select(F.lower("subject").alias("subject"), "attribute", "pattern").distinct()
    globs = named.where(F.col("pattern").rlike(r"[*?]") & ~F.col("pattern").rlike(r'(?s)^".*"\z')).limit(1).collect()
    if globs:
        raise ValueError(f"a retraction names a value, not a glob: {globs[0].pattern}")
    rows = live(claims, None, ("value",)).join(named.select("subject", "attribute").distinct(), ["subject", "attribute"], "left_semi")
    p, v = F.col("pattern"), F.col("value")
    bare = F.regexp_replace(p, r'(?s)^"(.*)"\z', "$1")
    met = (p == "..") | (v == p) | (v == json_quote(bare))
    hits = named.join(rows, ["subject", "attribute"]).where(met)
    unmet = named.join(hits.select("subject", "attribute", "pattern").distinct(), ["subject", "attribute", "pattern"], "left_anti")
    taken = hits.groupBy("subject", "attribute").agg(F.sort_array(F.collect_set("cid")).alias("retracts"))
    taken = taken.where(unmet.agg(F.count("*") == 0).scalar())
    df = taken.select("subject", "attribute", F.lit(None).cast("string").alias("value"), F.lit(time).alias("time"), F.lit(source).alias("source"), F.lit(run).alias("run"), "retracts")
    return df.withColumn("cid", claim_id()).select(*CLAIM), unmet


def preview(files: DataFrame) -> DataFrame:
    """What an ingest of listed files (size) would take in, without reading one: (files, bytes)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def receipts(subjects: DataFrame, source: str, time: str, run: str) -> DataFrame:
    """The receipt of an examination: ``prov:examined`` with the source as value."""
    return _claims(subjects, {"prov:examined": json_quote(F.lit(source))}, F.lit(time), source, run)


def land(messages: DataFrame, run: str) -> DataFrame:
    """Facts of fetched messages (subject, place, message_id, size, time, fresh, tags): place, id, kind and each tag on every sighting, size for new bytes."""
    facts = {
        "mailbox:place": json_quote(F.col("place")), "mailbox:id": json_quote(F.col("message_id")),
        "file:mime": json_quote(F.lit("message/rfc822")), "file:size": F.when(F.col("fresh"), F.col("size").cast("string")),
    }
    told = _claims(messages, facts, F.col("time"), "mailvault", run)
    if "tags" not in messages.columns:
        return told
    tags = messages.select("subject", "time", F.explode("tags").alias("tag"))
    return told.unionByName(_claims(tags, {"mailbox:tag": json_quote(F.col("tag"))}, F.col("time"), "mailvault", run))
