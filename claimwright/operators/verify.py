"""Integrity of the record: chain, presence in the stores, seals, copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimwright.functions.blake3 import digest
from claimwright.functions.grammar import claim_id, claim_line, json_quote
from claimwright.operators.orphans import held
from claimwright.plans.ranks import ranked
from claimwright.plans.record import live, record
from claimwright.plans.skew import union_all
from claimwright.sources.log import header


def chain_check(segments: DataFrame) -> DataFrame:
    """Each segment with the finding of its link: ``first``, ``linked``, ``missing`` (names none that exists) or ``forked``."""
    s = segments.select("seq", F.lower("digest").alias("digest"), F.lower("previous").alias("previous"))
    named = s.where(F.col("previous").isNotNull()).groupBy("previous").agg(F.count("*").alias("heirs"))
    joined = s.join(s.select(F.col("digest").alias("previous"), F.lit(True).alias("there")).distinct(), "previous", "left").join(named, "previous", "left")
    found = F.when(F.col("previous").isNull(), "first").when(F.col("there").isNull(), "missing").when(F.col("heirs") > 1, "forked").otherwise("linked")
    return joined.select("seq", "digest", found.alias("link"))


def segment_counts(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments with the claims they announce and hold."""
    counts = claims.groupBy("seq").agg(F.count("*").alias("held"))
    return segments.select("seq", F.col("n_claims").alias("announced")).join(counts, "seq", "left").select("seq", "announced", F.coalesce("held", F.lit(0)).alias("held"))


def referenced(claims: DataFrame) -> DataFrame:
    return claims.select(F.lower("subject").alias("digest")).distinct()


def missing(claims: DataFrame, blobs: DataFrame) -> DataFrame:
    """Referenced digests that neither store holds."""
    return referenced(claims).join(held(blobs), "digest", "left_anti")


def unrecorded(claims: DataFrame, blobs: DataFrame) -> DataFrame:
    """Held digests that no claim is about."""
    return held(blobs).distinct().join(referenced(claims), "digest", "left_anti")


def twins(blobs: DataFrame) -> DataFrame:
    """Digests held in both stores."""
    rows = blobs.where(F.col("removed").isNull()).groupBy(F.lower("digest").alias("digest"))
    return rows.agg(F.bool_or(F.col("store") == "content").alias("c"), F.bool_or(F.col("store") == "derived").alias("d")).where("c AND d").select("digest")


def undescribed(claims: DataFrame, blobs: DataFrame) -> DataFrame:
    """Held and recorded files that lack a standing size or mime: (digest, no_size, no_mime)."""
    known = live(claims, ["file:size", "file:mime"], ()).groupBy(F.col("subject").alias("digest")).agg(
        F.bool_or(F.col("attribute") == "file:size").alias("size"), F.bool_or(F.col("attribute") == "file:mime").alias("mime")
    )
    files = held(blobs).distinct().join(referenced(claims), "digest", "left_semi").join(known, "digest", "left")
    rows = files.select("digest", (~F.coalesce("size", F.lit(False))).alias("no_size"), (~F.coalesce("mime", F.lit(False))).alias("no_mime"))
    return rows.where(F.col("no_size") | F.col("no_mime"))


def content_of(blobs: DataFrame, prefix: str = "") -> DataFrame:
    """The store that serves each held digest: content before derived."""
    rows = blobs.where(F.col("removed").isNull()).select(F.lower("digest").alias("digest"), "store").where(F.col("digest").startswith(prefix))
    return rows.groupBy("digest").agg(F.min("store").alias("store"))


def seal_cover(claims: DataFrame, seal: int) -> DataFrame:
    """Digests that the segments up to *seal* refer to."""
    return referenced(claims.where(F.col("seq") <= seal))


def since_seal(claims: DataFrame, seal: int) -> DataFrame:
    """Claims recorded after *seal*, per segment."""
    rows = record(claims).where(F.col("seq") > seal)
    return rows.groupBy("seq").agg(F.count("*").alias("claims"), F.count_distinct("subject").alias("files"))


def delta(ahead: DataFrame, behind: DataFrame) -> DataFrame:
    """Files that *ahead* refers to and *behind* does not."""
    return referenced(ahead).join(referenced(behind), "digest", "left_anti")


def sealed_order(claims: DataFrame) -> DataFrame:
    """The place of each claim in its segment if sealed, by (time, line)."""
    rows = record(claims).select("cid", "seq", "time", claim_line().alias("line"))
    return ranked(rows, ["seq"], ["time", "line", "cid"]).select("cid", "seq", (F.col("rank") - 1).alias("place"))


def sealed_digests(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """The digest of each segment as it would be sealed from its claims: rows (seq, digest).

    It is that of the segment's bytes: the header, which names the segment before it, then
    the lines by (time, line). The bytes stream through one task a segment and are never held.
    """
    head = segments.select("seq", F.lower("previous").alias("previous")).distinct()
    rows = record(claims).where(F.col("seq").isNotNull()).select("seq", "time", claim_line().alias("line")).join(head, "seq", "left")
    ordered = rows.select("seq", "previous", "time", "line").repartition("seq").sortWithinPartitions("seq", "time", "line")

    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, hashed = None, None
        for part in parts:
            done = []
            for own, previous, line in zip(part["seq"].tolist(), part["previous"].tolist(), part["line"].tolist()):
                if own != seq:
                    if hashed:
                        done.append((seq, hashed.hexdigest()))
                    seq, hashed = own, hashlib.sha256((header(previous) + "\n").encode())
                hashed.update((line + "\n").encode())
            yield pd.DataFrame(done, columns=["seq", "digest"])
        if hashed:
            yield pd.DataFrame([(seq, hashed.hexdigest())], columns=["seq", "digest"])

    return ordered.mapInPandas(digests, "seq bigint, digest string")


def set_aside(claims: DataFrame, fixities: DataFrame) -> DataFrame:
    """Damaged files of *fixities* (digest, store, fixity): rows (digest, derived, path, mail), one per standing path, or one without.

    ``mail`` says whether the record has the file in a mailbox.
    """
    bad = fixities.where(F.col("fixity") == "damaged").select(F.lower("digest").alias("digest"), (F.col("store") == "derived").alias("derived")).distinct()
    rows = live(claims, ["file:path", "mailbox:place"], ("value",)).withColumnRenamed("subject", "digest")
    paths = rows.where((F.col("attribute") == "file:path") & F.col("value").startswith('"')).select("digest", F.get_json_object("value", "$").alias("path")).distinct()
    mails = rows.where(F.col("attribute") == "mailbox:place").select("digest", F.lit(True).alias("mail")).distinct()
    return bad.join(paths, "digest", "left").join(mails, "digest", "left").select("digest", "derived", "path", F.coalesce("mail", F.lit(False)).alias("mail"))


def weed(fixities: DataFrame) -> DataFrame:
    """What becomes of each digest in both stores: rows (digest, verdict) of *fixities* (digest, store, fixity).

    ``release``: the copy in ``derived`` can go, since the original is sound and the copy could be
    read. ``repair``: the original is damaged and the copy sound. ``stand``: neither.
    """
    of = lambda store: F.max(F.when(F.col("store") == store, F.col("fixity")))
    both = fixities.groupBy(F.lower("digest").alias("digest")).agg(of("content").alias("content"), of("derived").alias("derived")).dropna()
    verdict = F.when((F.col("content") == "sound") & F.col("derived").isin("sound", "damaged"), "release").when((F.col("content") == "damaged") & (F.col("derived") == "sound"), "repair")
    return both.select("digest", F.coalesce(verdict, F.lit("stand")).alias("verdict"))


def describe(lacking: DataFrame, files: DataFrame, time: str, run: str) -> DataFrame:
    """Claims of source ``maintain`` for what ``undescribed`` files lack, from *files* (digest, size, mime) as read; files that are gone give none."""
    rows = lacking.join(files, "digest")
    facts = F.array(
        F.struct(F.lit("file:size").alias("attribute"), F.when(F.col("no_size"), F.col("size").cast("string")).alias("value")),
        F.struct(F.lit("file:mime").alias("attribute"), F.when(F.col("no_mime"), json_quote(F.col("mime"))).alias("value")),
    )
    made = rows.select(F.col("digest").alias("subject"), F.inline(facts)).where(F.col("value").isNotNull())
    made = made.withColumns({"time": F.lit(time), "source": F.lit("maintain"), "run": F.lit(run), "retracts": F.lit(None).cast("array<string>")})
    return made.withColumn("cid", claim_id())


def findings(claims: DataFrame, blobs: DataFrame, segments: DataFrame, fixities: DataFrame | None = None) -> DataFrame:
    """All that an audit finds, in one table: rows (kind, name).

    Kinds: ``missing`` and ``unrecorded`` files, ``twin``, ``undescribed``, segments ``forked``, ``missing-segment`` or
    ``miscounted``, and of *fixities* ``damaged`` and ``unreadable`` files.
    """
    of = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("name"))
    links, counts = chain_check(segments), segment_counts(claims, segments)
    parts = [
        of("missing", missing(claims, blobs)), of("unrecorded", unrecorded(claims, blobs)), of("twin", twins(blobs)), of("undescribed", undescribed(claims, blobs)),
        of("forked", links.where("link = 'forked'").select("digest")), of("missing-segment", links.where("link = 'missing'").select("digest")),
        of("miscounted", counts.where("announced <> held").select("seq")),
    ]
    if fixities is not None:
        parts += [of(kind, fixities.where(F.col("fixity") == kind).select("digest")) for kind in ("damaged", "unreadable")]
    return union_all(parts)


def stored_since(blobs: DataFrame, moment: str) -> DataFrame:
    """Entries of the stores written since *moment*; undatable ones too."""
    return blobs.where(F.coalesce(F.col("stored") >= F.lit(moment).cast("timestamp_ntz"), F.lit(True))).select(F.lower("digest").alias("digest"), "store").distinct()


def seal_check(claims: DataFrame, blobs: DataFrame, segments: DataFrame, seal: str, fixities: DataFrame | None = None) -> DataFrame:
    """The files that a seal (the digest of a segment) covers: (digest, presence), ``content``, ``derived`` or ``missing``.

    A seal covers the segments up to its own; a seal that no segment has covers nothing. With
    *fixities* (digest, store, fixity) a file of which no copy is sound is ``damaged`` or ``unreadable``.
    """
    last = segments.where(F.lower("digest") == seal.lower()).agg(F.max("seq")).scalar()
    covered = referenced(claims.where(F.col("seq") <= last))
    found = covered.join(content_of(blobs).select("digest", "store"), "digest", "left").select("digest", F.coalesce("store", F.lit("missing")).alias("presence"))
    if fixities is None:
        return found
    # One sound copy, in either store, is enough.
    state = fixities.groupBy(F.lower("digest").alias("digest")).agg(F.max((F.col("fixity") == "sound").cast("int")).alias("sound"), F.max((F.col("fixity") == "damaged").cast("int")).alias("bad"))
    lost = F.when((F.col("presence") != "missing") & (F.col("sound") == 0), F.when(F.col("bad") == 1, "damaged").otherwise("unreadable"))
    return found.join(state, "digest", "left").select("digest", F.coalesce(lost, "presence").alias("presence"))


def copy_plan(claims: DataFrame, blobs: DataFrame, segments: DataFrame, copied: DataFrame) -> DataFrame:
    """What a copy that has the segments *copied* (digest) lacks: rows (kind, digest) of segments and of held files they refer to."""
    behind = segments.join(copied.select(F.lower("digest").alias("_d")), F.lower(segments["digest"]) == F.col("_d"), "left_semi")
    ahead = segments.join(behind.select("seq"), "seq", "left_anti")
    new, old = claims.join(ahead.select("seq"), "seq", "left_semi"), claims.join(behind.select("seq"), "seq", "left_semi")
    files = delta(new, old).join(held(blobs), "digest", "left_semi")
    return ahead.select(F.lit("segment").alias("kind"), F.lower("digest").alias("digest")).unionByName(files.select(F.lit("file").alias("kind"), "digest"))


def fixity(files: DataFrame, read: bool = True, keep: tuple[str, ...] = (), algorithm: str = "sha2") -> DataFrame:
    """Stored files (digest, content) as ``sound``, ``damaged`` or ``unreadable``; all ``unchecked`` where they are listed only (*read* false).

    *algorithm* is that of the archive's mark: ``sha2``, of the size that a name has, or ``blake3``.
    """
    if not read:
        return files.select(*keep, "digest", F.lit("unchecked").alias("fixity"))
    bits = digest("content") if algorithm == "blake3" else F.when(F.length("digest") == 64, F.sha2("content", 256)).when(F.length("digest") == 96, F.sha2("content", 384)).otherwise(F.sha2("content", 512))
    return files.select(*keep, "digest", F.when(F.col("content").isNull(), "unreadable").when(bits == F.lower("digest"), "sound").otherwise("damaged").alias("fixity"))
