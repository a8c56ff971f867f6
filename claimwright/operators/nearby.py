"""Points near other points, without comparing all pairs (problem 6).

Latitude is cut into ranges that hold about ``CROWD`` places each, made of the thinnest
strips that are as tall as the distance. A place is *native* to the range of its own
strip and is lent to the range above where its reach crosses the border, so ranges
overlap by the distance only. The places of a range are sorted by latitude and swept: an
active set, ordered by longitude, holds the places that are at most the distance south of
the current one; the current place looks up its reach of longitudes in it and the true
distance is verified. Only native places look up, so each pair has one owner: the range
of its later place.

A strip that alone holds more than ``CROWD`` places is a range of its own and is parted
along its longitudes, into runs of blocks as wide as the distance, again of about
``CROWD`` places; places are then lent to the parts that their reach touches. So cells
shrink down to the distance where places crowd, and no place is copied more often than
it has neighbouring cells. (Within a square of that side most places are pairs anyway.)

Ranges come from counts of all places per strip: at most ``STRIPS`` rows. Rows of one place
are brought together before the sweep and expanded after it, a place of very many
subjects dealt out to several tasks.

The sweep streams: it keeps the active set in memory, never the cell.

Defined results: null, unreadable or out-of-range coordinates are no location; a point is
never paired with itself; repeated rows count once; the antimeridian and the poles are
ordinary places.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimwright.functions.jsontext import decimal_member
from claimwright.plans.skew import spread_join
from claimwright.plans.tables import checkpointed

EARTH_M = 6_371_008.8
METRES = 150.0
#: Strips of the globe at most, for small distances.
STRIPS = 200_000
#: Places of a range, or of a part of a strip, that one sweep takes.
CROWD = 20_000


def angle(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    """The great-circle angle between two points, in radians."""
    p, q = math.radians(a_lat), math.radians(b_lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b_lon - a_lon) / 2) ** 2
    return 2 * math.asin(min(1.0, math.sqrt(h)))


def reach(lat: float, r: float) -> float:
    """Degrees of longitude within which all points at most *r* radians away lie."""
    c = math.cos(math.radians(lat))
    return 180.0 if abs(math.radians(lat)) + r >= math.pi / 2 or math.sin(r) >= c else math.degrees(math.asin(math.sin(r) / c)) * (1 + 1e-9) + 1e-9


class _Grid:
    """Strips of latitude and blocks of longitude for a distance."""

    def __init__(self, metres: float):
        self.r = metres / EARTH_M
        self.tall = math.degrees(self.r) * (1 + 1e-9) + 1e-9
        self.height = max(self.tall, 180 / STRIPS)

    def strip(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("bigint")

    def blocks(self, strip: Column) -> Column:
        """The number of blocks of a strip, as wide as the distance on its shorter edge."""
        edge = F.greatest(F.abs(strip * self.height), F.abs((strip + 1) * self.height))
        return F.greatest(F.lit(1), F.floor(2 * math.pi * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / math.radians(self.height)).cast("bigint"))

    def block(self, lon: Column, n: Column) -> Column:
        return F.floor((lon + 180) * n / 360).cast("bigint")

    def reach(self, lat: Column) -> Column:
        c = F.cos(F.radians(lat))
        wide = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(self.r) / c))) * (1 + 1e-9) + 1e-9
        return F.when((F.abs(lat) + self.tall >= 90) | (c <= math.sin(self.r)), 180.0).otherwise(wide)

    def around(self, lat: Column, lon: Column, n: Column) -> Column:
        """The blocks that the reach of a place touches in a strip of *n* blocks."""
        wide = self.reach(lat)
        near = F.array_distinct(F.transform(F.sequence(self.block(lon - wide, n), self.block(lon + wide, n)), lambda b: F.pmod(b, n)))
        return F.when(wide >= 180, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(near)


def ranges(places: DataFrame, grid: _Grid, crowd: int) -> DataFrame:
    """Per strip that has *places*: its range, whether it is crowded, and the same of the strip above it.

    A range is named by its lowest strip. At most ``STRIPS`` rows, so one task numbers them.
    """
    w = Window.orderBy("strip")
    rows = places.groupBy(grid.strip(F.col("lat")).alias("strip")).agg(F.count("*").alias("n")).withColumn("crowded", F.col("n") > crowd)
    light = F.when(F.col("crowded"), 0).otherwise(F.col("n"))
    rows = rows.withColumn("run", F.when(~F.col("crowded"), F.floor((F.sum(light).over(w) - light) / crowd)))
    first = F.min("strip").over(Window.partitionBy("run"))
    rows = rows.withColumn("range", F.when(F.col("crowded"), F.col("strip")).otherwise(first))
    adjoins = F.lead("strip").over(w) == F.col("strip") + 1
    above = lambda c: F.when(adjoins, F.lead(c).over(w)).alias(f"{c}_above")
    return rows.select("strip", "range", "crowded", above("range"), above("crowded"))


def cells(places: DataFrame, metres: float = METRES, crowd: int = CROWD) -> DataFrame:
    """*places* (lat, lon), each once, with the cells they belong to: (range, part, lat, lon, native)."""
    grid = _Grid(metres)
    of_strip = checkpointed(ranges(places, grid, crowd))
    rows = places.withColumn("strip", grid.strip(F.col("lat"))).join(of_strip, "strip")
    own = F.struct(F.col("strip").alias("at"), "range", "crowded", F.lit(True).alias("native"))
    lent = F.struct((F.col("strip") + 1).alias("at"), F.col("range_above").alias("range"), F.col("crowded_above").alias("crowded"), F.lit(False).alias("native"))
    crosses = (F.col("range_above") != F.col("range")) & (grid.strip(F.col("lat") + grid.tall) > F.col("strip"))
    rows = rows.select("lat", "lon", F.inline(F.when(crosses, F.array(own, lent)).otherwise(F.array(own))))
    plain = rows.where(~F.col("crowded")).select("range", F.lit(0).cast("bigint").alias("part"), "lat", "lon", "native")
    if of_strip.where("crowded").isEmpty():
        return plain
    n = grid.blocks(F.col("at"))
    dense = rows.where("crowded").withColumn("n", n).withColumn("own", grid.block(F.col("lon"), F.col("n")) % F.col("n"))
    counts = dense.where("native").groupBy("range", F.col("own").alias("block")).agg(F.count("*").alias("_n"))
    part = F.floor((F.sum("_n").over(Window.partitionBy("range").orderBy("block")) - F.col("_n")) / crowd).alias("part")
    parts = counts.select("range", "block", part)
    # Of the blocks around, only the own one and those of another part: most places go to one part.
    dense = dense.join(parts.select("range", F.col("block").alias("own"), F.col("part").alias("own_part")), ["range", "own"], "left")
    dense = dense.withColumn("block", F.explode(grid.around(F.col("lat"), F.col("lon"), F.col("n")))).join(parts, ["range", "block"])
    dense = dense.where((F.col("block") == F.col("own")) | ~F.col("part").eqNullSafe(F.col("own_part")))
    return plain.unionByName(dense.select("range", "part", "lat", "lon", (F.col("native") & (F.col("block") == F.col("own"))).alias("native")))


def _sweeper(metres: float):
    r = metres / EARTH_M
    tall = math.degrees(r) * (1 + 1e-9) + 1e-9

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, last, by_lat, by_lon = None, None, deque(), []
        for batch in batches:
            out = []
            for range_, part, lat, lon, native in zip(*(batch[c].tolist() for c in ("range", "part", "lat", "lon", "native"))):
                if cell != (range_, part):
                    cell, last, by_lat, by_lon = (range_, part), None, deque(), []
                if last == (lat, lon):  # lent to a part twice; the native row comes first
                    continue
                last = lat, lon
                while by_lat and by_lat[0][0] < lat - tall:
                    old = by_lat.popleft()
                    del by_lon[bisect_left(by_lon, (old[1], old[0]))]
                if native and by_lon:
                    wide = reach(lat, r)
                    spans = [(-180.0, 180.0)] if wide >= 180 else [(lon - wide, lon + wide), (lon - wide - 360, lon + wide - 360), (lon - wide + 360, lon + wide + 360)]
                    for low, high in spans:
                        if high < -180 or low > 180:
                            continue
                        for other, its_lat in by_lon[bisect_left(by_lon, (low, -91.0)) : bisect_right(by_lon, (high, 91.0))]:
                            if angle(lat, lon, its_lat, other) <= r:
                                out.append((its_lat, other, lat, lon))
                by_lat.append((lat, lon))
                insort(by_lon, (lon, lat))
            yield pd.DataFrame(out, columns=["lat_a", "lon_a", "lat_b", "lon_b"], dtype="float64")

    return sweep


def near_places(places: DataFrame, metres: float = METRES, crowd: int = CROWD) -> DataFrame:
    """Pairs (lat_a, lon_a, lat_b, lon_b) of different places of *places* (lat, lon) at most *metres* apart, each once."""
    celled = cells(checkpointed(places.select("lat", "lon").distinct()), metres, crowd)
    ordered = celled.repartitionByRange("range", "part").sortWithinPartitions("range", "part", "lat", "lon", F.desc("native"))
    return ordered.mapInPandas(_sweeper(metres), "lat_a double, lon_a double, lat_b double, lon_b double")


def near_pairs(points: DataFrame, metres: float = METRES, crowd: int = CROWD) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of different ids of *points* (id, lat, lon) with places at most *metres* apart.

    The distinct points are written to the checkpoint folder once, since places and both sides of the pairs come from them.
    """
    points = checkpointed(points.where(F.col("id").isNotNull()).select("id", "lat", "lon").distinct())
    side = lambda s: points.select(F.col("id").alias(f"id{s}"), F.col("lat").alias(f"lat{s}"), F.col("lon").alias(f"lon{s}"))
    near = spread_join(side("_a"), near_places(points, metres, crowd), ["lat_a", "lon_a"])
    near = spread_join(side("_b"), near, ["lat_b", "lon_b"])
    near = near.where(F.col("id_a") != F.col("id_b")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    here = spread_join(points.withColumnRenamed("id", "id_a"), points.withColumnRenamed("id", "id_b"), ["lat", "lon"])
    return near.unionByName(here.where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")).distinct()


def locations(claims: DataFrame) -> DataFrame:
    """Rows (id, lat, lon) of the readable ``geo:position`` assertions, each once."""
    rows = claims.where((F.col("attribute") == "geo:position") & F.col("retracts").isNull())
    rows = rows.select(F.lower("subject").alias("id"), "value").distinct()
    rows = rows.select("id", (decimal_member(F.col("value"), "latitude") + 0.0).alias("lat"), (decimal_member(F.col("value"), "longitude") + 0.0).alias("lon"))
    good = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return rows.where(good & F.col("id").isNotNull()).distinct()


def found(claims: DataFrame) -> DataFrame:
    """Rows (subject_a, subject_b)."""
    return near_pairs(locations(claims)).select(F.col("id_a").alias("subject_a"), F.col("id_b").alias("subject_b"))
