"""Row numbers within keys of any size.

A window would bring all rows of a key into one task. Here rows are sorted in ranges of
(key, order), numbered within their range, and the ranges of a key are summed up: one row
a key and range. The sorted rows are checkpointed, so the numbers and the sums are of
the same ranges even if a task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimwright.plans.tables import checkpointed, shuffle_partitions


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """*df* with the 1-based number *name* of each row among those of its key, in *order*; null keys are keys."""
    both = [*keys, *order]
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), *both).sortWithinPartitions(*both)
    rows = checkpointed(ranges.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    heads = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_head"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    heads = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_head", before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(heads, same)
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_head") + 1).select(*df.columns, name)
