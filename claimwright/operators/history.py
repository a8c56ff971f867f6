"""History of changing entity attributes with periods of validity (problem 4).

Insert-only satellites. Attributes are split by the rate at which their values are
measured to change, a satellite each for those that change seldom and often (``History``).
A satellite row is a *state* of one key from one instant on, with a hash of that state.
Appending compares states with the stored hashes and inserts only what differs: a state
that is new, another state at a known instant, or, where late claims made a stored change
none, a void row. Nothing is ever updated: of rows of one key and instant the last batch
counts, and the end of a period is computed in a view from the row that follows.

The state of a key (subject, attribute, value) is the number of claims that then hold it,
reduced to holds or does not. Changes are netted per key and instant with a map-side
combine, so periods that touch leave no change at all.

Hot keys: windows run over (key, day) and then over the days of a key. Netted instants
are whole seconds, so a group has at most 86,400 rows, whatever share of the data its
key holds; the day level has one row per key and day.

Defined results: claims without a readable instant are never valid; retractions without
one take back nothing here; null subjects or values are left out; repeated claims are
one; ends not later than their start give no period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimwright.operators.instants import instant_of
from claimwright.plans.skew import union_all
from claimwright.plans.tables import work_folder, written

#: The attributes whose history is kept.
TRACKED = ("mailbox:place", "user:tag")
#: An attribute changes often if its lifetimes a key exceed so many times those of all attributes together.
OFTEN = 1.0
OPEN = "open"
_KEY = ("subject", "attribute", "value")


def lifetimes(claims: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Rows (subject, attribute, value, start, end) of the claims on *attributes*; end is null without one."""
    made = F.col("retracts").isNull()
    ids = F.when(made, F.array("cid")).otherwise(F.col("retracts"))
    rows = claims.where(F.col("attribute").isin(*attributes)).select(
        F.lower("subject").alias("subject"), "attribute", F.when(made, F.col("value")).alias("value"), made.alias("made"), instant_of(F.col("time")).alias("at"), ids.alias("ids")
    )
    rows = rows.select("*", F.explode("ids").alias("cid"))  # the instant is read before the rows are multiplied
    ends = rows.select(F.lower("cid").alias("cid"), "subject", "attribute", "value", F.when(F.col("made"), F.col("at")).alias("start"), F.when(~F.col("made"), F.col("at")).alias("end"))
    claim = ends.groupBy("cid", "subject", "attribute").agg(F.min("value").alias("value"), F.min("start").alias("start"), F.min("end").alias("end"))
    good = F.col("subject").isNotNull() & F.col("value").isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start")))
    return claim.where(good).select(*_KEY, "start", "end")


def satellite(lives: DataFrame) -> DataFrame:
    """The satellite rows of *lives*: (subject, attribute, value, loaded, holds, hash_diff), only where the state changes."""
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    steps = lives.select(*_KEY, F.explode(ends).alias("e")).where(F.col("e.at").isNotNull())
    net = steps.groupBy(*_KEY, F.col("e.at").alias("loaded")).agg(F.sum("e.d").alias("delta")).where(F.col("delta") != 0)
    net = net.withColumn("day", F.substring("loaded", 1, 10))
    days = net.groupBy(*_KEY, "day").agg(F.sum("delta").alias("in_day"))
    before = Window.partitionBy(*_KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*_KEY, "day", F.coalesce(F.sum("in_day").over(before), F.lit(0)).alias("carried"))
    within = Window.partitionBy(*_KEY, "day").orderBy("loaded").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("carried") + F.sum("delta").over(within)
    run = net.join(days, [*_KEY, "day"]).withColumn("after", after).withColumn("earlier", F.col("after") - F.col("delta"))
    code = lambda holds: F.xxhash64(*_KEY, holds)
    holds, held = F.col("after") > 0, F.col("earlier") > 0
    changed = run.where(code(holds) != code(held))
    return changed.select(*_KEY, "day", "loaded", holds.alias("holds"), code(holds).alias("hash_diff"))


def ended(rows: DataFrame) -> DataFrame:
    """The view with end dates: rows that hold, with ``valid_to`` the instant of the key's next row or null."""
    of_day = Window.partitionBy(*_KEY, "day").orderBy("loaded")
    heads = rows.groupBy(*_KEY, "day").agg(F.min("loaded").alias("head"))
    heads = heads.select(*_KEY, "day", F.lead("head").over(Window.partitionBy(*_KEY).orderBy("day")).alias("head_after"))
    dated = rows.withColumn("next", F.lead("loaded").over(of_day)).join(heads, [*_KEY, "day"])
    return dated.where("holds").select(*_KEY, F.col("loaded").alias("valid_from"), F.coalesce("next", "head_after").alias("valid_to"))


def change_rates(lives: DataFrame) -> DataFrame:
    """Rows (attribute, lives, keys): lifetimes and, estimated within 2 %, the keys that have them, over all rows."""
    keys = F.approx_count_distinct(F.xxhash64(*_KEY), 0.02)
    return lives.groupBy("attribute").agg(F.count("*").alias("lives"), F.greatest(keys, F.lit(1)).alias("keys"))


class History:
    """The satellites under one shared folder, each in its own folder, with a folder a batch."""

    def __init__(self, spark: SparkSession, path: str, often: float = OFTEN):
        self.spark, self.path, self.often = spark, path.rstrip("/"), often
        self.split: dict[str, str] = {}

    def _batches(self, name: str) -> list[int]:
        """The batches of a satellite, from the names of its folders."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch=*")
        found_ = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in found_ or [])

    def append(self, lives: DataFrame, batch: int) -> None:
        """Brings the satellites up to *lives*, the lifetimes of the record as it now is.

        Attributes met before stay in their satellite. A batch that is appended again writes its own folder anew.
        """
        rates = change_rates(lives).collect()  # one row an attribute
        mean = sum(r["lives"] for r in rates) / max(1, sum(r["keys"] for r in rates))
        for r in rates:
            self.split.setdefault(r["attribute"], "often" if r["lives"] / r["keys"] > self.often * mean else "seldom")
        for name in sorted(set(self.split.values())):
            rows = satellite(lives.where(F.col("attribute").isin([a for a, s in self.split.items() if s == name])))
            stored = [b for b in self._batches(name) if b < batch]
            if stored:
                rows = self._differing(rows, self._states(name, stored))
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _states(self, name: str, batches: list[int]) -> DataFrame:
        """The stored rows that count, void ones included: of one key and instant those of the last of *batches*."""
        rows = self.spark.read.schema(f"{', '.join(f'{k} string' for k in _KEY)}, day string, loaded string, holds boolean, hash_diff bigint, batch int").parquet(f"{self.path}/{name}")
        rows = rows.where(F.col("batch").isin(batches))
        if len(batches) == 1:
            return rows.drop("batch")
        last = F.max(F.struct("batch", "day", "holds", "hash_diff")).alias("l")
        return rows.groupBy(*_KEY, "loaded").agg(last).select(*_KEY, "l.day", "loaded", "l.holds", "l.hash_diff")

    @staticmethod
    def _differing(rows: DataFrame, stored: DataFrame) -> DataFrame:
        """What to insert: rows whose hash is not the stored one, and void rows for changes that are none any more."""
        old = stored.select(*_KEY, "loaded", F.col("day").alias("old_day"), F.col("holds").alias("held"), F.col("hash_diff").alias("old_hash"))
        both = rows.join(old, [*_KEY, "loaded"], "full")
        fresh = F.col("hash_diff").isNotNull() & ~F.col("hash_diff").eqNullSafe(F.col("old_hash"))
        void = F.col("hash_diff").isNull() & F.col("held").isNotNull()
        void_hash = F.xxhash64(*_KEY, F.lit(None).cast("boolean"))
        return both.where(fresh | void).select(*_KEY, F.coalesce("day", "old_day").alias("day"), "loaded", "holds", F.coalesce("hash_diff", void_hash).alias("hash_diff"))

    def periods(self) -> DataFrame:
        """Rows (subject, attribute, value, valid_from, valid_to) of all satellites; valid_to is null while valid."""
        views = [ended(self._states(n, self._batches(n)).where(F.col("holds").isNotNull())) for n in sorted(set(self.split.values()))]
        if not views:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in (*_KEY, "valid_from", "valid_to")))
        return union_all(views)


def found(claims: DataFrame) -> DataFrame:
    """The periods of the tracked attributes, ``open`` for those without end."""
    lives = written(lifetimes(claims, TRACKED), "lifetimes", ("attribute",))
    kept = History(claims.sparkSession, work_folder(claims.sparkSession, "history"))
    kept.append(lives, 0)
    return kept.periods().withColumn("valid_to", F.coalesce("valid_to", F.lit(OPEN)))
