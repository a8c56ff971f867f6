from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/New_York")  # no operator may depend on it
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


CLAIM = "subject string, attribute string, value string, time string, source string, run string, retracts array<string>, cid string, seq long, position long"


@pytest.fixture(scope="session")
def claims(spark):
    """Claims from short rows: (subject, attribute, value or ids, time, cid)."""

    def make(*rows, **extra):
        full = [
            (s, a, None if isinstance(v, list) else v, t, "ingest", "r1", v if isinstance(v, list) else None, c, i // 4, i % 4)
            for i, (s, a, v, t, c) in enumerate(rows)
        ]
        return spark.createDataFrame(full, CLAIM)

    return make


@pytest.fixture(scope="session")
def rows():
    """The rows of a frame, as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
