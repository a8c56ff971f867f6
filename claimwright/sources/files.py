"""File trees, vault logs and stores as tables."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.extract import sniff
from claimwright.functions.batched import batched
from claimwright.operators.paths import excluded


def file_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), content: bool = True, mark: str = "FORMAT") -> DataFrame:
    """Regular files below *root*: (path, relative, length, modified, subject), hashed where *content* is read.

    Excludes are held against the path below the root, and prune. Symbolic links are passed by, and so
    is everything in an archive within the tree, a folder that holds a file named *mark*.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.substr("path", F.instr("path", base) + len(base) + 1)
    rows = rows.withColumn("relative", relative)
    if excludes:
        rows = rows.where(~excluded(F.col("relative"), list(excludes)))
    # A folder is named by each file below it; those that hold a mark take theirs with them.
    parts = F.split("relative", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    marked = rows.where(F.element_at(parts, -1) == mark).select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder")).distinct()
    inside = rows.select("path", F.explode(folders).alias("folder")).join(marked, "folder", "left_semi").select("path").distinct()
    rows = rows.join(inside, "path", "left_anti")
    local = F.regexp_replace("path", "^file:/+", "/")
    rows = rows.where(~F.when(F.col("path").startswith("file:"), batched(_behind_link, "boolean")(F.concat(F.lit(base + "\n"), local))).otherwise(False))
    out = rows.select("path", "relative", "length", F.col("modificationTime").alias("modified"), "content")
    return out.withColumn("subject", F.sha2("content", 256)) if content else out.drop("content")


def _behind_link(pair: str) -> bool:
    """Whether a path (behind the root, parted by a line break) is a link or lies behind one below the root."""
    base, path = pair.split("\n", 1)
    at = base
    for part in path[len(base) :].strip("/").split("/"):
        at = os.path.join(at, part)
        if os.path.islink(at):
            return True
    return False


def mail_directory(spark: SparkSession, root: str, account: str) -> DataFrame:
    """The messages of a directory: (subject, place, content, length) of each file without a leading dot that looks like mail.

    The place is the account and, below the root, the folder in NFC: ``account:folder``.
    """
    rows = file_tree(spark, root).where(~F.col("relative").rlike(r"(?:^|/)\.")).where(batched(sniff.looks_like_mail, "boolean")("content"))
    folder = F.regexp_extract("relative", r"(?s)^(.*)/[^/]*\z", 1)
    place = F.when(folder == "", F.lit(account)).otherwise(F.concat(F.lit(account + ":"), batched(lambda t: unicodedata.normalize("NFC", t), "string")(folder)))
    return rows.select("subject", place.alias("place"), "content", "length")


def vault_lines(spark: SparkSession, root: str) -> DataFrame:
    """The message lines (store_id, place, time) of an older vault's logs: a header line with mailbox and folder, then a line a message.

    Torn lines are passed by. A log is one file of bounded size, read whole, since its header holds for all its lines.
    """
    logs = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.split(F.col("value"), "\n").alias("lines"))
    head = F.from_json(F.col("lines")[0], "mailbox string, folder string", {"mode": "PERMISSIVE"})
    rows = logs.select(head.alias("h"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    own = F.from_json("line", "store_id string, time string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.where(F.col("h.mailbox").isNotNull()).select("h", own.alias("m")).where(F.col("m._bad").isNull() & F.col("m.store_id").isNotNull())
    place = F.concat(F.col("h.mailbox"), F.when(F.col("h.folder").isNotNull(), F.concat(F.lit(":"), F.col("h.folder"))).otherwise(""))
    return rows.select("m.store_id", place.alias("place"), "m.time")


def unchanged(listing: DataFrame, memory: DataFrame) -> DataFrame:
    """Listed files that the memory does not know with this size and time."""
    return listing.join(memory, ["host", "path", "size", "modified"], "left_anti")


def vault_messages(lines: DataFrame) -> DataFrame:
    """Earliest time per message and place of vault log lines (store_id, place, time); undated lines lose."""
    return lines.where(F.col("store_id").isNotNull()).groupBy("store_id", "place").agg(F.min("time").alias("time"))
