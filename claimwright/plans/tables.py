"""Loading the Parquet tables, and the settings and shared folders that operators take from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* of the data folder *sf_dir*."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a session on one machine (tests) makes a folder of its own; on
    a cluster, whose executors would not see it, this is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="claimwright-")
        _removed_at_end(spark, named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _removed_at_end(spark, path)
    return path


def _removed_at_end(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """*df* with its lineage cut through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """*df* as a Parquet table in a work folder: one write, then read with pushdown, in folders of *by*."""
    path = work_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
