"""The lineage graph: edges from an origin to what was taken from it, and closures over them.

Closures run in rounds: each round joins only the newly reached nodes with the edges,
drops those known, and ends when none is new. What a round finds is written once, to the
shared folder, and never again but to merge many small fronts into one (``_Known``), so a
lost executor costs one round and all writing together is the result a few times over.
Joins deal out origins of very many files. Cycles end because known nodes do not come
again. Nothing is collected; the driver sees one flag a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimwright.plans.ranks import ranked
from claimwright.plans.record import is_digest, live
from claimwright.plans.skew import hot_keys, spread_join, union_all
from claimwright.plans.tables import checkpointed

ROOTS = ("file:path", "mailbox:place")
ORIGIN = "prov:origin"
#: Fronts that are merged into one when there are more.
FRONTS = 8


class _Known:
    """What the rounds have found so far, as written fronts."""

    def __init__(self, first: DataFrame):
        self.fronts, self.columns = [checkpointed(first)], first.columns

    @property
    def last(self) -> DataFrame:
        return self.fronts[-1]

    def all(self) -> DataFrame:
        return union_all(self.fronts)

    def add(self, found: DataFrame, by: list[str]) -> bool:
        """Writes the rows of *found* whose *by* is not known as the next front; whether there are any."""
        new = checkpointed(found.join(self.all().select(*by), by, "left_anti").select(*self.columns))
        if new.isEmpty():
            return False
        if len(self.fronts) >= FRONTS:
            self.fronts = [checkpointed(self.all())]
        self.fronts.append(new)
        return True


def edges(claims: DataFrame) -> DataFrame:
    """Distinct (origin, subject) of the standing ``prov:origin`` values that are digests."""
    return edges_of(live(claims, [ORIGIN], ("value",)))


def edges_of(rows: DataFrame) -> DataFrame:
    origin = F.regexp_extract("value", r'^"([0-9a-f]+)"\z', 1)
    return rows.select(origin.alias("origin"), "subject").where(is_digest(F.col("origin"))).distinct()


def _own_place():
    """Whether a standing claim gives its subject a place of its own: a place in an archive, led by ``@``, does not."""
    return (F.col("attribute") == "mailbox:place") | ((F.col("attribute") == "file:path") & ~F.col("value").startswith('"@'))


def roots(claims: DataFrame) -> DataFrame:
    """Subjects with a standing path of their own, or a place in a mailbox."""
    return live(claims, list(ROOTS), ("value",)).where(_own_place()).select("subject").distinct()


def closure(start: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes reachable from *start* (node) over *steps* (node, next), *start* included."""
    known, steps = _Known(start.select("node").distinct()), checkpointed(steps.select("node", "next").distinct())
    hot = checkpointed(hot_keys(steps, ["node"]))
    while known.add(spread_join(steps, known.last, ["node"], hot).select(F.col("next").alias("node")).distinct(), ["node"]):
        pass
    return known.all()


def placed(claims: DataFrame) -> DataFrame:
    """Subjects that are placed: roots, and what was taken from a placed subject, at any remove."""
    steps = edges(claims).select(F.col("origin").alias("node"), F.col("subject").alias("next"))
    return closure(roots(claims).select(F.col("subject").alias("node")), steps).select(F.col("node").alias("subject"))


def placed_hits(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Those of *hits* (subject) that are placed, climbing from the hits only.

    Each round reads the places and origins of the nodes it stands at: claims of other
    subjects are dropped before the standing set is built, so nothing is shuffled for them. A
    hit stops climbing where one of its origins has a place.
    """
    start = hits.select(F.col("subject").alias("start"), F.col("subject").alias("node")).distinct()
    known, arrived = _Known(start), []
    lineage_of = claims.where(F.col("attribute").isin(*ROOTS, ORIGIN)).withColumn("subject", F.lower("subject"))
    while True:
        nodes = known.last.select(F.col("node").alias("subject")).distinct()
        facts = live(lineage_of.join(nodes, "subject", "left_semi"), None, ("value",))
        origin = F.regexp_extract("value", r'^"([0-9a-f]+)"\z', 1)
        facts = facts.select(F.col("subject").alias("node"), _own_place().alias("placed"), F.when((F.col("attribute") == ORIGIN) & is_digest(origin), origin).alias("origin"))
        facts = facts.where(F.col("placed") | F.col("origin").isNotNull()).distinct()
        step = checkpointed(spread_join(known.last, facts, ["node"]))
        here = step.where("placed").select(F.col("start").alias("subject")).distinct()
        arrived.append(here)
        above = step.where(F.col("origin").isNotNull()).select("start", F.col("origin").alias("node")).distinct()
        if not known.add(above.join(here.withColumnRenamed("subject", "start"), "start", "left_anti"), ["start", "node"]):
            return union_all(arrived).distinct()


def trees(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Derivation trees: rows (root, node, parent, depth, path) below each of *starts* (subject), a node once a tree.

    A node that a round reaches from several parents takes the least of them; ``path`` are the nodes from the root to it.
    """
    first = starts.select(F.col("subject").alias("root"), F.col("subject").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("subject").alias("path")).distinct()
    known, depth, links = _Known(first), 0, checkpointed(links.select("origin", "subject"))
    hot = checkpointed(hot_keys(links, ["origin"]))
    while True:
        depth += 1
        below = spread_join(links, known.last.select("root", F.col("node").alias("origin"), "path"), ["origin"], hot)
        least = F.min(F.struct("origin", "path")).alias("l")
        below = below.groupBy("root", F.col("subject").alias("node")).agg(least).select("root", "node", F.col("l.origin").alias("parent"), F.lit(depth).alias("depth"), F.concat("l.path", F.array("node")).alias("path"))
        if not known.add(below, ["root", "node"]):
            return known.all()


def flat(tree: DataFrame) -> DataFrame:
    """The rows of *tree* with ``place``, the 1-based place of each node in its tree: origins before what was taken from them."""
    return ranked(tree, ["root"], ["depth", "node"], "place")


def tree_lines(tree: DataFrame) -> DataFrame:
    """Each derivation tree as nested JSON objects, as rows (root, place, text): the texts of a root in order of place are its object.

    A node's object has its subject and the list ``derived`` of the objects below it, empty or not.
    """
    rows = ranked(tree, ["root"], ["path"], "place").select("root", "place", "node", "depth")
    after = rows.select("root", (F.col("place") - 1).alias("place"), F.col("depth").alias("next"))
    both = rows.join(after, ["root", "place"], "left")
    # A first child stands right behind its parent; an object ends with all those it is the last of.
    before = rows.select("root", (F.col("place") + 1).alias("place"), F.col("depth").alias("last"))
    both = both.join(before, ["root", "place"], "left")
    comma = F.when(F.col("depth") <= F.col("last"), ",").otherwise("")
    ends = F.when(F.col("next") > F.col("depth"), "").otherwise(F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("next", F.lit(0)) + 1))
    return both.select("root", "place", F.concat(comma, F.lit('{"subject":"'), "node", F.lit('","derived":['), ends).alias("text"))


def descents(links: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (subject, path): each simple path from an origin that has none down to a hit."""
    links = checkpointed(links.select(F.col("subject").alias("top"), "origin"))
    has_origin, hot = links.select("top").distinct(), checkpointed(hot_keys(links, ["top"]))
    front, done = checkpointed(hits.select("subject", F.array("subject").alias("path"))), []
    while not front.isEmpty():
        at_top = front.withColumn("top", F.col("path")[0])
        done.append(at_top.join(has_origin, "top", "left_anti").select("subject", "path"))
        up = spread_join(links, at_top, ["top"], hot).where(~F.array_contains("path", F.col("origin")))
        front = checkpointed(up.select("subject", F.concat(F.array("origin"), F.col("path")).alias("path")))
    return union_all(done) if done else hits.select("subject", F.array("subject").alias("path")).limit(0)


def only_from(links: DataFrame, removed: DataFrame, kept: DataFrame) -> DataFrame:
    """*removed* (subject) and the files all of whose origins are in the set and that *kept* (subject) lacks."""
    links = checkpointed(links.select("origin", "subject"))
    left = checkpointed(links.groupBy("subject").agg(F.count("*").alias("origins")))  # a row a file
    hot = checkpointed(hot_keys(links, ["origin"]))
    known, gone = _Known(removed.select("subject").distinct()), []
    while True:
        # Origins that fell in this round, counted per file; a file falls when all its origins have.
        gone.append(checkpointed(spread_join(links, known.last.select(F.col("subject").alias("origin")), ["origin"], hot).groupBy("subject").agg(F.count("*").alias("n"))))
        if len(gone) > FRONTS:
            gone = [checkpointed(union_all(gone).groupBy("subject").agg(F.sum("n").alias("n")))]
        fallen = union_all(gone).groupBy("subject").agg(F.sum("n").alias("n")).join(left, "subject").where(F.col("n") >= F.col("origins"))
        if not known.add(fallen.join(kept.select("subject"), "subject", "left_anti").select("subject"), ["subject"]):
            return known.all()
