"""Inserts, updates and deletes applied to rebuild the current state (problem 2).

The method is that of equality-delete files with sequence numbers: a change feed is cut
into *data* rows and *delete* keys, both appended and never rewritten, each with a
sequence number; a reader anti-joins the rows against the delete keys of later numbers.
An update is a delete of the old key and an insert of the new one.

Sequence numbers say in which order changes apply, whatever the order they come in. Most
feeds number batches. In the record a retraction holds wherever and whenever it was
recorded and cannot be taken back, so retractions have the number ``OUTLASTS``, behind
every insert (``feed_of``).

Both sides of the anti-join are reduced to one row a key with a map-side combine, so a
key that a third of all rows repeat stays one row a task; the join then finds both sides
partitioned by the key and moves nothing.

``standing_claims`` gives the same rows in one aggregate straight from the claims, for
queries that read the record once and keep no files.

Defined results: rows whose key has a null column are in no state (nothing can name
them); repeated rows are one row; a delete of an unknown key does nothing; of repeated
rows of one key the row of the greatest sequence number counts (ties: greatest payload);
a null sequence number is 0. Payload columns may have any names but ``op``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from claimwright.plans.tables import work_folder

#: The sequence number of deletes that no insert outlasts.
OUTLASTS = (1 << 63) - 1


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in keys))


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k")


def _payload(payload: dict[str, Column]) -> Column:
    return F.struct(*([c.alias(n) for n, c in payload.items()] or [F.lit(0)]))


def _latest(data: DataFrame, keys: list[str], seq: str) -> tuple[DataFrame, list[str]]:
    """One row (keys, _seq, payload) per key, and the payload's names."""
    payload = [c for c in data.columns if c not in (*keys, seq)]
    own = F.coalesce(F.col(f"`{seq}`").cast("bigint"), F.lit(0)).alias("_seq")
    rows = data.where(_known(keys)).groupBy(*[F.col(f"`{k}`") for k in keys])
    if not payload:
        return rows.agg(F.max(own).alias("_seq")), payload
    best = rows.agg(F.max(F.struct(own, _payload({c: F.col(f"`{c}`") for c in payload}).alias("p"))).alias("_row"))
    return best.select(*[F.col(f"`{k}`") for k in keys], "_row._seq", *[F.col("_row.p")[c].alias(c) for c in payload]), payload


def apply_changes(data: DataFrame, deletes: DataFrame, keys: list[str], seq: str = "seq", which: str = "later") -> DataFrame:
    """The rows of *data* that no delete takes back, one per key.

    *data* has the key columns, *seq* and any payload; *deletes* the key columns and *seq*.
    *which*: ``later`` deletes take back rows of smaller sequence numbers; ``any`` their key.
    """
    if which not in ("any", "later"):
        raise ValueError(f"which is any or later, not {which!r}")
    rows, payload = _latest(data, keys, seq)
    gone, _ = _latest(deletes.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{seq}`")), keys, seq)
    gone = gone.select(*[F.col(f"`{k}`").alias(f"_d{i}") for i, k in enumerate(keys)], F.col("_seq").alias("_gone"))
    taken = reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"_d{i}") for i, k in enumerate(keys)))
    kept = rows.join(gone, taken & (F.col("_seq") < F.col("_gone")) if which == "later" else taken, "left_anti")
    return kept.select(*[F.col(f"`{k}`") for k in keys], F.col("_seq").alias(seq), *[F.col(f"`{c}`") for c in payload])


def _is_delete() -> Column:
    """A claim with ``retracts`` is a delete of each id that it names under its own subject and attribute."""
    return F.col("retracts").isNotNull()


_KEYS = ["subject", "attribute", "claim"]


def feed_of(claims: DataFrame, attributes: list[str] | None = None, payload: dict[str, Column] | None = None) -> DataFrame:
    """The record as a change feed of (subject, attribute, claim, seq, payload…, op), from one scan.

    ``op`` is ``data`` for an assertion, whose ``seq`` is its segment, and ``deletes`` for each
    id that a retraction names, whose ``seq`` is ``OUTLASTS``. The payload of deletes is null.
    """
    rows = claims if attributes is None else claims.where(F.col("attribute").isin(attributes))
    made = ~_is_delete()
    cut = rows.select(
        F.lower("subject").alias("subject"), "attribute", F.explode(F.when(made, F.array("cid")).otherwise(F.col("retracts"))).alias("claim"),
        F.when(made, F.col("seq").cast("bigint")).otherwise(F.lit(OUTLASTS)).alias("seq"),
        *[F.when(made, v).alias(k) for k, v in (payload or {}).items()], F.when(made, "data").otherwise("deletes").alias("op"),
    )
    return cut.withColumn("claim", F.lower("claim"))


def split_feed(claims: DataFrame, attributes: list[str] | None = None, payload: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``feed_of``: (data, deletes)."""
    feed = feed_of(claims, attributes, payload)
    return feed.where(F.col("op") == "data").drop("op"), feed.where(F.col("op") == "deletes").select(*_KEYS, "seq")


def standing_claims(claims: DataFrame, attributes: list[str] | None = None, payload: dict[str, Column] | None = None) -> DataFrame:
    """The standing claims as (subject, attribute, claim, seq, payload…), one row per claim.

    The same as ``apply_changes`` of ``split_feed``, as one aggregate over both sides.
    """
    feed, names = feed_of(claims, attributes, payload).where(_known(_KEYS)), list(payload or {})
    is_data = F.col("op") == "data"
    state = [F.max(F.when(~is_data, 1)).alias("gone")]
    if not names:
        rows = feed.groupBy(*_KEYS).agg(F.max(F.when(is_data, F.coalesce("seq", F.lit(0)))).alias("seq"), *state)
        return rows.where(F.col("seq").isNotNull() & F.col("gone").isNull()).select(*_KEYS, "seq")
    row = F.when(is_data, F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), _payload({n: F.col(f"`{n}`") for n in names}).alias("p")))
    rows = feed.groupBy(*_KEYS).agg(F.max(row).alias("row"), *state)
    return rows.where(F.col("row").isNotNull() & F.col("gone").isNull()).select(*_KEYS, F.col("row.seq").alias("seq"), *[F.col("row.p")[n].alias(n) for n in names])


def difference(current: DataFrame, copy: DataFrame, key: str = "claim") -> DataFrame:
    """What brings *copy* up to date with *current*: rows (key, change) with change ``add`` or ``drop``."""
    one = lambda df, mark: df.where(F.col(key).isNotNull()).select(F.lower(key).alias(key), F.lit(mark).alias("mark"))
    both = one(current, 1).unionByName(one(copy, 2)).groupBy(key).agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    return both.where(F.col("low") == F.col("high")).select(key, F.when(F.col("low") == 1, "add").otherwise("drop").alias("change"))


class ChangeTable:
    """A table kept as appended data and delete files under one shared folder.

    ``append`` writes a batch under a sequence number that the caller gives, ``append_feed``
    changes that carry their own; writing a batch again (a retried job) repeats rows that
    the reader merges anyway. ``read`` merges; ``compact`` writes the merged rows into a new
    folder as batch 0.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], which: str = "later"):
        self.spark, self.path, self.keys, self.which = spark, path.rstrip("/"), keys, which
        self.schema: StructType | None = None

    def append_feed(self, feed: DataFrame) -> None:
        """Appends changes (keys, seq, payload…, op): data and delete files, each kind in its own folder, in one pass."""
        feed.write.mode("append").partitionBy("op").parquet(self.path)
        self.schema = feed.schema

    def append(self, seq: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        if inserts is not None:
            self.append_feed(inserts.withColumns({"seq": F.lit(seq).cast("bigint"), "op": F.lit("data")}))
        if deletes is not None:
            deletes.select(*self.keys, F.lit(seq).cast("bigint").alias("seq"), F.lit("deletes").alias("op")).write.mode("append").partitionBy("op").parquet(self.path)

    def read(self) -> DataFrame:
        """The rows that stand. Without any append since the table was opened, its columns are those of its data files."""
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read.option("mergeSchema", "true")
        rows = reader.parquet(self.path)
        deletes = rows.where(F.col("op") == "deletes").select(*self.keys, "seq")
        return apply_changes(rows.where(F.col("op") == "data").drop("op"), deletes, self.keys, which=self.which)

    def compact(self, path: str) -> ChangeTable:
        table = ChangeTable(self.spark, path, self.keys, self.which)
        table.append(0, self.read().drop("seq"))
        return table


#: The attributes of the copy that readers keep (fixed by the data model).
COPIED = ("file:path", "mailbox:place", "mailbox:tag", "user:tag")


def standing_table(claims: DataFrame, attributes: list[str] | None = None) -> ChangeTable:
    """The record as a change table in a work folder."""
    made = ChangeTable(claims.sparkSession, work_folder(claims.sparkSession, "changes"), _KEYS)
    made.append_feed(feed_of(claims, attributes))
    return made


def found(claims: DataFrame, standing: DataFrame) -> DataFrame:
    """Rows (claim, change) between the standing claims of the copied attributes and the copy."""
    return difference(standing_table(claims, list(COPIED)).read(), standing)
