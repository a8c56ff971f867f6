"""Incremental intake: bundles of claims that arrive as files, folded once each.

The fold keeps no state of its own: standing is an anti-join at read time, so bundles may
come in any order and late retractions of any age apply. A batch is written under its
number; a batch that is run again after a failure overwrites its own files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimwright.plans.record import live


def follow(spark: SparkSession, landing: str, schema: StructType, into: str, checkpoint: str, per_batch: int = 100) -> StreamingQuery:
    """Folds the Parquet bundles in *landing* into the table *into* until none is unread."""
    bundles = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(landing)

    def fold(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/batch={number}")  # a claim met again keeps all its places: the last counts

    return bundles.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, into: str) -> DataFrame:
    """The claims folded so far; one met again has its last place."""
    rows = spark.read.parquet(into)
    names = [c for c in rows.columns if c not in ("cid", "batch", "seq", "position")]
    return rows.groupBy("cid").agg(F.max(F.struct("seq", "position", *names)).alias("r")).select("cid", "r.*")


def standing_now(spark: SparkSession, into: str) -> DataFrame:
    return live(folded(spark, into))
