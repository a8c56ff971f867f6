"""Ingest of a growing folder as a stream: bytes first, then the claims about them, then the memory of what was met.

A batch holds at most so many files, or bytes where these are given. Its three writes are in that order, so a claim
never names bytes that are not stored, and the memory never says that a file was met whose
claims are not in the log. A batch that fails stops the stream, and nothing behind it is written; run
again, it meets its own work: stored bytes stand, the same claims are the same bundles,
and its memory is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimwright.extract import sniff
from claimwright.functions.batched import batched
from claimwright.functions.names import modified_text
from claimwright.operators import write
from claimwright.plans.tables import checkpointed
from claimwright.sources.delivery import deliver
from claimwright.sources.segments import Log

FILES = 1000
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, folder: str, log: Log, store: str, memory: str, checkpoint: str, host: str, run: str, time: str, files: int = FILES, most: str | None = None) -> StreamingQuery:
    """Takes in the files of *folder* that no earlier run of *checkpoint* has met, each once, and ends.

    *store* is the folder of the content store, *memory* that of the remembered files (host, path, size, modified).
    """
    met = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option(*(("maxBytesPerTrigger", most) if most else ("maxFilesPerTrigger", files))).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        hashed = rows.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("subject"))
        once = hashed.groupBy("subject").agg(F.first("content").alias("content"))
        plan = hashed.select("subject", F.concat(F.substring("subject", 1, 2), F.lit("/"), "subject").alias("target")).distinct()
        stored = checkpointed(deliver(plan, once, store))
        bad = stored.where(F.col("outcome").startswith("failed")).limit(1).collect()
        if bad:
            raise OSError(f"{bad[0].target}: {bad[0].outcome}")
        modified = modified_text(F.unix_seconds("modificationTime"), F.unix_micros("modificationTime") % 1_000_000 * 1000)
        told = hashed.select("subject", F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), modified.alias("modified"), batched(sniff.kind, "string")("content").alias("mime"))
        told = checkpointed(told.join(stored.select("subject", (F.col("outcome") == "exported").alias("fresh")), "subject").withColumn("time", F.lit(time)))
        log.append(write.ingest(told, host, run))
        told.select(F.lit(host).alias("host"), "path", "size", "modified").write.mode("overwrite").parquet(f"{memory}/batch={number}")

    return met.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
