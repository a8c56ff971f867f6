"""Two listings held against each other: multisets, snapshots, frontiers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimwright.plans.ranks import ranked
from claimwright.plans.skew import union_all
from claimwright.plans.tables import checkpointed


def settled(listed: DataFrame, archived: DataFrame) -> DataFrame:
    """Per key, how often it is listed and archived, and whether that settles it."""
    tag = lambda df, a, b: df.where(F.col("key").isNotNull()).select("key", F.lit(a).alias("l"), F.lit(b).alias("a"))
    rows = tag(listed, 1, 0).unionByName(tag(archived, 0, 1)).groupBy("key").agg(F.sum("l").alias("listed"), F.sum("a").alias("archived"))
    return rows.where(F.col("listed") > 0).withColumn("settled", F.col("archived") >= F.col("listed"))


def claimed(listed: DataFrame, archived: DataFrame) -> DataFrame:
    """Listed rows (key, place) that find an archived copy: the k-th of a key takes the k-th copy."""
    copies = archived.groupBy("key").agg(F.count("*").alias("copies"))
    rows = ranked(listed.where(F.col("key").isNotNull()).select("key", "place"), ["key"], ["place"])
    return rows.join(copies, "key").where(F.col("rank") <= F.col("copies")).select("key", "place")


#: Bytes from which a server may have cut a key short.
CUT_FROM = 128


def claimed_copies(listed: DataFrame, archived: DataFrame) -> DataFrame:
    """Listed copies (place, key) against archived keys (key, a row a copy): rows (place, key, taken, settled).

    In listing order each copy takes one archived copy of its key. A key of more than
    ``CUT_FROM`` bytes that the archive lacks may be one that was cut: it takes a copy of the first
    archived key that begins with it and has one left. A copy is settled if it took one and no
    copy that got none reached the same key.

    Keys that cannot be cut are ranks and joins. Of the others those with the same first
    ``CUT_FROM`` bytes are claimed one after the other by a stream that holds the archived keys only.
    """
    counts = archived.where(F.col("key") != "").groupBy("key").agg(F.count("*").alias("copies"))
    # Byte for byte: cutting a key within a character must not change what begins with what.
    short = F.octet_length("key") <= CUT_FROM
    exact = ranked(listed.where((F.col("key") != "") & short).select("key", "place"), ["key"], ["place"]).join(counts, "key", "left")
    taken = F.col("rank") <= F.coalesce("copies", F.lit(0))
    exact = exact.select("place", "key", taken.alias("taken"), F.when(F.col("copies").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>")).alias("reached"))
    none = listed.where(F.coalesce(F.col("key") == "", F.lit(True))).select("place", "key", F.lit(False).alias("taken"), F.array().cast("array<string>").alias("reached"))
    head = F.substring(F.encode("key", "utf-8"), 1, CUT_FROM).alias("head")
    row = lambda df, is_listed, *cols: df.where(~short).select(head, F.lit(is_listed).alias("listed"), *cols)
    both = row(counts, False, "key", F.lit(None).cast(listed.schema["place"].dataType).alias("place"), "copies").unionByName(row(listed, True, "key", "place", F.lit(0).cast("bigint").alias("copies")))
    ordered = both.repartition("head").sortWithinPartitions("head", "listed", "place", "key")
    kind = listed.schema["place"].dataType.simpleString()

    def claim(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, keys = None, {}, []
        for part in parts:
            out = []
            for head_, is_listed, key, place, copies in zip(*(part[c].tolist() for c in ("head", "listed", "key", "place", "copies"))):
                if at != head_:
                    at, left, keys = head_, {}, []
                if not is_listed:
                    left[key.encode()] = copies
                    continue
                if len(keys) != len(left):
                    keys = sorted(left)
                own, got, reached = key.encode(), False, []
                near = [own] if own in left else keys[bisect_left(keys, own) :]
                for candidate in near:
                    if not candidate.startswith(own):
                        break
                    if left[candidate] > 0:
                        left[candidate] -= 1
                        got, reached = True, [candidate.decode()]
                        break
                    reached.append(candidate.decode())
                out.append((place, key, got, reached))
            yield pd.DataFrame(out, columns=["place", "key", "taken", "reached"])

    every = checkpointed(union_all([exact, none, ordered.mapInPandas(claim, f"place {kind}, key string, taken boolean, reached array<string>")]))
    contested = every.where(~F.col("taken")).select(F.explode("reached").alias("own")).distinct()
    sound = every.where("taken").select("place", "key", F.col("reached")[0].alias("own")).join(contested, "own", "left_anti").select("place", "key", F.lit(True).alias("settled"))
    return every.join(sound, ["place", "key"], "left").select("place", "key", "taken", F.coalesce("settled", F.lit(False)).alias("settled"))


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a new snapshot asserts or retracts: (keys, change)."""
    tag = lambda df, m: df.select(*keys, F.lit(m).alias("m")).distinct()
    both = tag(old, 1).unionByName(tag(new, 2)).groupBy(*keys).agg(F.sum("m").alias("m"))
    return both.where(F.col("m") != 3).select(*keys, F.when(F.col("m") == 2, "assert").otherwise("retract").alias("change"))


def frontier(rows: DataFrame, key: str, order: str, passed: str) -> DataFrame:
    """The resume point per *key*: the greatest *order* before the first that has not passed."""
    first_bad = rows.groupBy(key).agg(F.min(F.when(~F.col(passed), F.col(order))).alias("bad"))
    good = rows.join(first_bad, key).where(F.col("bad").isNull() | (F.col(order) < F.col("bad")))
    return good.groupBy(key).agg(F.max(order).alias("resume"))


def stopped(attempts: DataFrame, keys: list[str], order: str, ok: str, limit: int = 10) -> DataFrame:
    """Where a folder's fetch stops: per *keys* the *order* of the attempt that is the *limit*-th refusal in a row; rows (keys, stop).

    A refusal's run is named by the number of successes before it, so runs of any length are two counts.
    """
    placed = ranked(attempts.select(*keys, order, ok), keys, [order], "at")
    good = ranked(placed.where(F.col(ok)), keys, ["at"], "n")
    # Refusals keep their distance from their place to the successes before them: at - successes counts refusals.
    after = good.select(*keys, (F.col("n") - 1).alias("n"), F.col("at").alias("before"))  # the next success, by its number: no window over a folder
    ends = good.join(after, [*keys, "n"], "left").select(*keys, F.col("at").alias("after"), "before")
    first = placed.groupBy(*keys).agg(F.min(F.when(F.col(ok), F.col("at"))).alias("before"), F.max("at").alias("last")).select(*keys, F.lit(0).cast("bigint").alias("after"), F.coalesce("before", F.col("last") + 1).alias("before"))
    last = placed.groupBy(*keys).agg(F.max("at").alias("last"))
    gaps = ends.unionByName(first).join(last, keys).select(*keys, "after", F.coalesce("before", F.col("last") + 1).alias("before"))
    stop = gaps.where(F.col("before") - F.col("after") - 1 >= limit).groupBy(*keys).agg(F.min(F.col("after") + limit).alias("at"))
    return placed.join(stop, [*keys, "at"]).select(*keys, F.col(order).alias("stop"))


def pending(attempts: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Items tried without success: (keys, tries, given_up)."""
    rows = attempts.groupBy(*keys).agg(F.count("*").alias("tries"), F.bool_or("ok").alias("ok"))
    return rows.where(~F.col("ok")).select(*keys, "tries", (F.col("tries") >= limit).alias("given_up"))


def receivers(carriers: DataFrame) -> DataFrame:
    """Of the carriers (id, subject, placed, has) of an id, those that get a fact: placed ones lacking it, else all lacking it."""
    rows = carriers.groupBy("id").agg(F.bool_or("placed").alias("any"))
    joined = carriers.join(rows, "id")
    return joined.where(~F.col("has") & (F.col("placed") | ~F.col("any"))).select("id", "subject")


def label_removed(labelled: DataFrame, in_mailbox: DataFrame, in_folder: DataFrame) -> DataFrame:
    """Subjects with a label that are still in the mailbox but no longer in the label's folder."""
    return labelled.join(in_mailbox, "subject", "left_semi").join(in_folder, "subject", "left_anti")


def import_plan(logs: DataFrame, accounts: DataFrame) -> DataFrame:
    """What an import makes of each log of an older vault (log_id, mailbox, folder): rows (log_id, kind, place).

    A folder of a known account is a ``place``, an account without a folder is ``listed``, and the logs of
    unknown mailboxes become ``label`` tags: their messages keep the places they have.
    """
    known = accounts.where(F.col("mailbox").isNotNull()).select("mailbox", F.lit(True).alias("known")).distinct()
    rows = logs.select("log_id", "mailbox", "folder").distinct().join(known, "mailbox", "left")
    kind = F.when(F.col("known").isNull(), "label").when(F.col("folder").isNull(), "listed").otherwise("place")
    return rows.select("log_id", kind.alias("kind"), F.when(F.col("known") & F.col("folder").isNotNull(), F.concat("mailbox", F.lit(":"), "folder")).alias("place"))
