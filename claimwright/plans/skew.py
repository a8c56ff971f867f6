"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that one task may join.
MOST = 100_000


def hot_keys(many: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """The keys of more than *most* rows in *many*, with the number of shares ``_of`` each is cut into.

    At most one row per *most* rows.
    """
    most = most or MOST
    hot = many.groupBy(*keys).agg(F.count("*").alias("_of")).where(F.col("_of") > most)
    return hot.select(*keys, F.ceil(F.col("_of") / most).cast("int").alias("_of"))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """The inner join of *many* and *few* on *keys*, with the hot keys of *many* dealt out.

    Keys of more than ``MOST`` rows in *many* are cut into shares by a hash of the row; the
    rows of *few* with such a key are repeated once a share. Without *hot*, the ``hot_keys`` of
    *many*, these are counted first, so *many* should be a written table.
    Columns: the keys, the rest of *many*, the rest of *few*.
    """
    hot = hot if hot is not None else hot_keys(many, keys)
    rest, other = [c for c in many.columns if c not in keys], [c for c in few.columns if c not in keys]
    share = F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_of")), F.lit(0)).cast("int")
    left = many.join(hot, keys, "left").select(*keys, *rest, share.alias("_share"))
    shares = F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1))
    right = few.join(hot, keys, "left").select(*keys, *other, shares.alias("_share"))
    return left.join(right, [*keys, "_share"]).select(*keys, *rest, *other)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
