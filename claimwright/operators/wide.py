"""Entity, attribute, value rows reshaped into one typed row per entity (problem 1).

Positional stitching, in three steps:

1. *Ordinals.* Entities get global ordinals 0, 1, 2 … A hash of the entity names one of
   ``ranges`` ordinal ranges; inside a range entities are numbered in order, and the
   sizes of the ranges (one row a range, with the cells it holds) give each range its first ordinal. No global
   sort and no single-task window is needed, and a retried task numbers alike.
2. *Columns.* For each range, each attribute's cells are written into a typed column that
   is aligned to the range: the cell of ordinal *i* stands at place *i - first*.
3. *Assembly.* The columns of a range are put side by side; no cell is looked up by key.

Cells are reduced to one per (entity, attribute) before that, with a map-side combine, so
an entity or attribute of very many rows never meets in one task.

Defined results: an entity with no readable cell still has a row of defaults; a null
entity or attribute is in no row; unknown attributes are left out; of equal order keys
the greater value counts. Columns are named by the specs alone, so other columns of the
input cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimwright.functions import jsontext
from claimwright.operators.changes import standing_claims
from claimwright.operators.instants import instant_of
from claimwright.plans.tables import checkpointed, shuffle_partitions


#: Cells of an ordinal range, which one task assembles in memory.
CELLS = 400_000


@dataclass(frozen=True)
class Spec:
    """A column of the wide table: its attribute, its reader (JSON text to a cell or null), type and default."""

    name: str
    attribute: str
    read: Callable[[Column], Column]
    default: int | str

    @property
    def sql_type(self) -> str:
        return "bigint" if isinstance(self.default, int) else "string"


RASTER = [
    *[Spec(n, f"raster:{n}", jsontext.integer_of, -1) for n in ("width", "height", "depth")],
    Spec("alpha", "raster:alpha", jsontext.truth_of, ""),
    Spec("color", "raster:color", lambda v: jsontext.word_of(v, "gray", "rgb", "cmyk", "indexed"), ""),
]


def winners(cells: DataFrame, specs: list[Spec], order: list[str]) -> DataFrame:
    """One row (entity, attribute, number, text) per entity and attribute: its readable cell of greatest order."""
    number, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for s in specs:
        is_it = F.col("attribute") == s.attribute
        if s.sql_type == "bigint":
            number = F.when(is_it, s.read(F.col("value"))).otherwise(number)
        else:
            text = F.when(is_it, s.read(F.col("value"))).otherwise(text)
    rows = cells.where(F.col("entity").isNotNull() & F.col("attribute").isin([s.attribute for s in specs]))
    ranks = [F.col(f"`{o}`").alias(f"_order{i}") for i, o in enumerate(order)]
    rows = rows.select("entity", "attribute", *ranks, number.alias("number"), text.alias("text"))
    best = F.struct(*[f"_order{i}" for i in range(len(order))], "number", "text")
    best = F.when(F.col("number").isNotNull() | F.col("text").isNotNull(), best)
    return rows.groupBy("entity", "attribute").agg(F.max(best).alias("b")).select("entity", "attribute", "b.number", "b.text")


def with_ordinals(cells: DataFrame, ranges: int) -> DataFrame:
    """*cells* with ``range``, ``place`` (in the range) and ``ordinal`` (global) of their entity."""
    ranged = cells.withColumn("range", F.pmod(F.xxhash64("entity"), F.lit(ranges)).cast("int"))
    placed = ranged.withColumn("place", F.dense_rank().over(Window.partitionBy("range").orderBy("entity")) - 1)
    sizes = placed.groupBy("range").agg((F.max("place") + 1).alias("n"), F.count("number").alias("numbers"), F.count("text").alias("texts"))
    sums = {c: F.sum(c).over(Window.orderBy("range")) - F.col(c) for c in ("n", "numbers", "texts")}
    first = sizes.select("range", *[x.alias(f"_first_{c}") for c, x in sums.items()])
    return placed.join(first, "range").withColumn("ordinal", F.col("_first_n") + F.col("place"))


def stitch(cells: DataFrame, specs: list[Spec], entity: str, ranges: int) -> DataFrame:
    """Winning *cells* assembled into the wide table with its ordinals, a range at a time."""
    placed = with_ordinals(cells, ranges).select("range", "place", "ordinal", "entity", "attribute", "number", "text")
    types = {"bigint": pa.int64(), "string": pa.string()}

    def assemble(table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        starts = np.full(size, -1)
        starts[place] = np.arange(len(place))
        columns = {"ordinal": table["ordinal"].take(pa.array(starts)), entity: table["entity"].take(pa.array(starts))}
        for s in specs:
            source = table["number" if s.sql_type == "bigint" else "text"]
            at = np.full(size, -1)
            mine = np.flatnonzero(pc.equal(table["attribute"], s.attribute).to_numpy())
            at[place[mine]] = mine
            column = source.take(pa.array(at, mask=at < 0)).fill_null(s.default)
            columns[s.name] = column.cast(types[s.sql_type])
        return pa.table(columns)

    schema = f"ordinal bigint, `{entity}` string, " + ", ".join(f"`{s.name}` {s.sql_type}" for s in specs)
    return placed.groupBy("range").applyInArrow(assemble, schema)


def widen(cells: DataFrame, specs: list[Spec], order: list[str], entity: str = "entity", ranges: int | None = None) -> DataFrame:
    """The wide table of *cells* (entity, attribute, value and the *order* columns): ordinal, *entity*, the specs' columns.

    The winning cells are written to the checkpoint folder once; ordinals and columns are made from there.

    *ranges* is the number of ordinal ranges, by default as many as keep a range at about
    ``CELLS`` cells, and no fewer than shuffle partitions; so a range's size does not grow with the data.
    """
    won = checkpointed(winners(cells, specs, order))
    return stitch(won, specs, entity, ranges or max(shuffle_partitions(cells.sparkSession), -(-won.count() // CELLS)))


def raster(claims: DataFrame) -> DataFrame:
    """One row per subject with a standing ``raster:*`` claim."""
    payload = {"value": F.col("value"), "time": F.col("time")}
    cells = standing_claims(claims, [s.attribute for s in RASTER], payload).withColumn("instant", instant_of(F.col("time")))
    return widen(cells.withColumnRenamed("subject", "entity"), RASTER, ["instant", "claim"], "subject")


def found(claims: DataFrame) -> DataFrame:
    """Rows (subject, width, height, depth, alpha, color)."""
    return raster(claims).drop("ordinal")
