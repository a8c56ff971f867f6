"""The tree of paths, and layouts made from it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimwright.functions.grammar import json_quote
from claimwright.functions.names import account_of, epoch, folder_of
from claimwright.operators.ask import placements
from claimwright.plans.ranks import ranked
from claimwright.plans.record import live, live_values
from claimwright.plans.skew import union_all
from claimwright.plans.terms import quote


def path_text(value: Column) -> Column:
    return F.when(value.startswith('"'), F.get_json_object(value, "$"))


def all_paths(claims: DataFrame) -> DataFrame:
    """Distinct (path, subject) of the standing string values of ``file:path``."""
    return live_values(claims, ["file:path"]).select(path_text(F.col("value")).alias("path"), "subject").where(F.col("path").isNotNull()).distinct()


def under(claims: DataFrame, place: str) -> DataFrame:
    """(path, subject) at or below *place*, by components; ``/`` holds all absolute paths."""
    base = place.rstrip("/")
    return all_paths(claims).where((F.col("path") == base) | F.col("path").startswith(base + "/"))


def level(claims: DataFrame, place: str) -> DataFrame:
    """The entries one level below *place*: (name, files, folder), a name that is both counted as both."""
    base = place.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(base) + 1))
    rows = all_paths(claims).where(F.col("path").startswith(base)).select("subject", F.split(rest, "/").alias("parts"))
    entry = rows.select(F.col("parts")[0].alias("name"), (F.size("parts") > 1).alias("deep"), "subject").where(F.col("name") != "")
    return entry.groupBy("name").agg(F.sum((~F.col("deep")).cast("bigint")).alias("files"), F.sum(F.col("deep").cast("bigint")).alias("below"))


def level_lines(claims: DataFrame, place: str) -> DataFrame:
    """The level below *place* as JSON objects: (name, kind, part, line), a file with the subjects that stand there, a folder as itself.

    A file's subjects come a thousand a line, ``part`` counting the lines, so a place of very many subjects is no one row.
    """
    base = place.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(base) + 1))
    rows = all_paths(claims).where(F.col("path").startswith(base)).select("subject", F.split(rest, "/").alias("parts")).where(F.col("parts")[0] != "")
    name = F.col("parts")[0].alias("name")
    folders = rows.where(F.size("parts") > 1).select(name).distinct().select("name", F.lit("folder").alias("kind"), F.lit(0).cast("bigint").alias("part"), F.concat(F.lit('{"folder":'), json_quote(F.col("name")), F.lit("}")).alias("line"))
    files = ranked(rows.where(F.size("parts") == 1).select(name, "subject").distinct(), ["name"], ["subject"], "n").groupBy("name", F.floor((F.col("n") - 1) / 1000).alias("part"))
    files = files.agg(F.array_join(F.transform(F.sort_array(F.collect_list("subject")), json_quote), ",").alias("own"))
    line = F.concat(F.lit('{"file":'), json_quote(F.col("name")), F.lit(',"subjects":['), F.col("own"), F.lit("]}"))
    return folders.unionByName(files.select("name", F.lit("file").alias("kind"), "part", line.alias("line")))


def tree_counts(claims: DataFrame) -> DataFrame:
    """Files at and below each folder: (folder, files). Each path counts once in each folder above it."""
    parts = F.split("path", "/")
    rows = all_paths(claims).where(F.col("path").startswith("/")).select(parts.alias("p"))
    folders = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.concat(F.array_join(F.slice("p", 1, n), "/"), F.lit("/")))
    return rows.select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def newest_by_path(claims: DataFrame) -> DataFrame:
    """The winner of each standing path: newest by (time, cid)."""
    rows = live(claims, ["file:path"], ("value", "time")).select(path_text(F.col("value")).alias("path"), "subject", "time", "cid").where(F.col("path").isNotNull())
    return rows.groupBy("path").agg(F.max(F.struct("time", "cid", "subject")).alias("n")).select("path", "n.subject", "n.time", "n.cid")


def forest(claims: DataFrame) -> DataFrame:
    """The tree a reader sees: rows (id, parent, name, folder, subject, size, modified).

    Of the claims on one place the newest wins; of paths that differ in spelling only, the last.
    A file whose place is also a folder steps aside to ``stem-<8 hex>.ext``, with more of the
    digest where that name is taken. Ids are those of a walk that takes each folder's names
    in order, the root, which has no row, being 0; they come from one range sort by components.
    Size and change time are the newest standing ones, 0 and the time of the place without.
    """
    won = newest_by_path(claims).select("path", "subject", "time", components(F.col("path")).alias("c")).where(F.size("c") > 0)
    won = won.groupBy("c").agg(F.max(F.struct("path", "subject", "time")).alias("w")).select("c", "w.subject", "w.time")
    folders = won.select(F.explode(_prefixes(F.col("c"))).alias("c")).distinct()
    taken = won.select("c").unionByName(folders).distinct().select(F.col("c").alias("shown"), F.lit(True).alias("used"))
    mine = won.join(folders.withColumn("both", F.lit(True)), "c", "left")
    parent = F.slice("c", 1, F.size("c") - 1)
    named = lambda size: F.concat(parent, F.array(aside(F.element_at("c", -1), F.col("subject"), size)))
    stays = mine.where(F.col("both").isNull()).select("c", F.col("c").alias("shown"), "subject", "time")
    wants = mine.where("both").select("c", "subject", "time", F.posexplode(F.array(*[named(n) for n in range(8, 65, 8)])).alias("n", "shown"))
    steps = wants.join(taken, "shown", "left").groupBy("c", "subject", "time")
    steps = steps.agg(F.coalesce(F.min_by(F.when(F.col("used").isNull(), F.col("shown")), F.when(F.col("used").isNull(), F.col("n"))), F.max_by("shown", "n")).alias("shown"))
    newest = live(claims, ["file:size", "file:modified"], ("value", "time")).groupBy("subject").agg(
        *[F.max(F.when(F.col("attribute") == a, F.struct("time", "cid", "value")))["value"].alias(n) for a, n in (("file:size", "size"), ("file:modified", "modified"))]
    )
    files = stays.unionByName(steps).join(newest, "subject", "left").select(
        "shown", F.lit(False).alias("folder"), "subject", F.coalesce(F.col("size").try_cast("bigint"), F.lit(0)).alias("size"),
        F.coalesce(epoch(F.get_json_object("modified", "$")), epoch(F.col("time")), F.lit(0)).cast("bigint").alias("modified"),
    )
    none = F.lit(None)
    nodes = files.unionByName(folders.select(F.col("c").alias("shown"), F.lit(True).alias("folder"), none.cast("string").alias("subject"), none.cast("bigint").alias("size"), none.cast("bigint").alias("modified")))
    ids = ranked(nodes.withColumn("one", F.lit(1)), ["one"], ["shown"], "id").drop("one")
    above = ids.where("folder").select(F.col("shown").alias("up"), F.col("id").alias("parent"))
    rows = ids.withColumn("up", F.slice("shown", 1, F.size("shown") - 1)).join(above, "up", "left")
    return rows.select("id", F.coalesce("parent", F.lit(0).cast("bigint")).alias("parent"), F.element_at("shown", -1).alias("name"), "folder", "subject", "size", "modified")


def _prefixes(parts: Column) -> Column:
    """The folders above a place, as components."""
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.slice(parts, 1, n))).otherwise(F.array().cast("array<array<string>>"))


def aside(name: Column, subject: Column, size: int = 8) -> Column:
    """The name of a file that steps aside, with *size* characters of its digest."""
    mark = F.concat(F.lit("-"), F.substring(subject, 1, size))
    stem, ext = F.regexp_extract(name, _STEM, 1), F.regexp_extract(name, _STEM, 2)
    return F.when(stem != "", F.concat(stem, mark, ext)).otherwise(F.concat(name, mark))


#: A path in what stands before the last dot of its name, and the rest.
_STEM = r"(?s)^(.*[^/])(\.[^./]*)\z"


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".", ".."))


def _common(low: Column, high: Column) -> Column:
    """How many first elements two lists share; of the least and greatest of many lists, those that all share."""
    most = F.least(F.size(low), F.size(high))
    same = F.filter(F.sequence(F.lit(1), most), lambda n: F.slice(low, 1, n) == F.slice(high, 1, n))
    return F.when(most == 0, 0).otherwise(F.size(same))


def lay_out(pairs: DataFrame) -> DataFrame:
    """Export targets of placements: rows (subject, target) of *pairs* (subject, attribute, place).

    Paths lose the folders that all of them share. Where they share none, they are parted by
    their first component, and each group keeps the last folder of what it shares. A place in an
    archive is its path there, without the ``@``. Names land flat, messages under account and folder.
    A pair said twice is one file, a subject at two places two. Only named components count.
    The shared folders of a group are those of its least and greatest path, so two
    combined values a group suffice.
    """
    pairs = pairs.select("subject", "attribute", "place").distinct()
    of = lambda a: pairs.where(F.col("attribute") == a)
    rows = of("file:path").select("subject", components(F.regexp_replace("place", "^@", "")).alias("c")).where(F.size("c") > 0)
    rows = rows.withColumns({"root": F.when(F.size("c") > 1, F.col("c")[0]), "dirs": F.slice("c", 1, F.size("c") - 1)})
    groups = rows.groupBy("root").agg(F.min("dirs").alias("low"), F.max("dirs").alias("high"), F.count("*").alias("n"))
    ends = groups.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    whole = ends.select(F.struct(_common(F.col("low"), F.col("high")).alias("shared"), "n", "groups")).scalar()
    shared_by_all = whole["shared"]
    one_group = (whole["n"] == 1) | (shared_by_all > 0) | (whole["groups"] == 1)
    kept = groups.select(F.col("root").alias("_root"), F.when(one_group, shared_by_all).otherwise(_common(F.col("low"), F.col("high"))).alias("shared"), one_group.alias("single"))
    joined = rows.join(kept, F.col("root").eqNullSafe(F.col("_root")))
    # The last shared folder stays where groups must be kept apart.
    start = F.col("shared") + F.when(F.col("single") | (F.col("shared") == 0), 1).otherwise(0)
    pathed = joined.select("subject", F.slice("c", start.cast("int"), F.size("c")).alias("t"))
    flat = of("file:name").select("subject", components(F.col("place")).alias("c")).where(F.size("c") > 0).select("subject", F.slice("c", -1, 1).alias("t"))
    mail = of("mailbox:place").select("subject", F.concat(components(account_of(F.col("place"))), components(F.coalesce(folder_of(F.col("place")), F.lit(""))), F.array(F.concat("subject", F.lit(".eml")))).alias("t"))
    return union_all([pathed, flat, mail]).select("subject", F.array_join("t", "/").alias("target"))


def layout(claims: DataFrame) -> DataFrame:
    """``lay_out`` of where each subject stands now."""
    return lay_out(placements(claims).select("subject", "attribute", F.get_json_object("value", "$").alias("place")))


def bumped(target: Column, n: Column) -> Column:
    stem, ext = F.regexp_extract(target, _STEM, 1), F.regexp_extract(target, _STEM, 2)
    return F.when(stem != "", F.concat(stem, F.lit("-"), n, ext)).otherwise(F.concat(target, F.lit("-"), n))


def disambiguate(targets: DataFrame, fold_case: bool = False) -> DataFrame:
    """Rows (subject, target, name): of subjects that want one target the first has it, the others get ``-n`` before the extension.

    Numbers count from 2 and skip names that others want as they stand, so no two names
    are alike; with *fold_case*, not even in other case. Everything is ranks and joins,
    so a target of very many subjects is no group of one task.
    """
    fold = F.lower if fold_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    rows = ranked(targets.select("subject", "target").distinct().withColumn("key", fold("target")), ["key"], ["target", "subject"], "n")
    wanted = rows.select("key").distinct()
    numbered = r"(?s)^(.*[^/])-([2-9]|[1-9][0-9]{1,17})(\.[^./]*)?\z"
    part = lambda i: F.regexp_extract("key", numbered, i)
    # A target spelt like the k-th copy of another keeps that number from it.
    used = wanted.where(part(2) != "").select(F.concat(part(1), part(3)).alias("key"), part(2).cast("bigint").alias("k"))
    used = ranked(used, ["key"], ["k"], "i").select("key", (F.col("k") - F.col("i") + 1).alias("at"), F.lit(0).alias("copy"), F.lit("").alias("subject"), F.lit("").alias("target"))
    copies = rows.where("n > 1").select("key", F.col("n").cast("bigint").alias("at"), F.lit(1).alias("copy"), "subject", "target")
    placed = ranked(used.join(copies.select("key").distinct(), "key", "left_semi").unionByName(copies), ["key"], ["at", "copy", "target", "subject"], "rank")
    later = placed.where("copy = 1").select("subject", "target", bumped(F.col("target"), F.col("rank") + 1).alias("name"))
    return rows.where("n = 1").select("subject", "target", F.col("target").alias("name")).unionByName(later)


def _glob(pattern: str) -> str:
    """An exclude glob as a regular expression: ``*`` and ``?`` within a level, ``**`` across levels, classes and alternatives."""
    out, i, open_ = "", 0, 0
    while i < len(pattern):
        c, start = pattern[i], i == 0 or pattern[i - 1] == "/"
        if pattern.startswith("**", i) and start and pattern[i + 2 : i + 3] in ("", "/"):
            if i + 2 == len(pattern):
                out, i = out + ".*", i + 2
            else:
                out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))) > 0:
            inside = pattern[i + 1 : end]
            negated = inside[:1] in ("!", "^")
            out, i = out + ("[^" if negated else "[") + re.sub(r"([\\\[\]&^~])", r"\\\1", inside[negated:]) + "]", end + 1
        elif c in "{}":
            open_, out, i = open_ + (1 if c == "{" else -1), out + ("(?:" if c == "{" else ")"), i + 1
        elif c == "," and open_:
            out, i = out + "|", i + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + ("[^/]" if c == "?" else re.escape(c) if ord(c) < 128 else c), i + 1
    return out


def excluded(relative: Column, patterns: list[str]) -> Column:
    """Whether an exclude glob holds a path below the walked root, or a folder above it there.

    A pattern without ``/`` is held against bare names at any level, another against the whole relative path.
    """
    def one(glob: str) -> Column:
        if "/" not in glob:
            return relative.rlike(rf"(?s)(?:^|/)(?:{_glob(glob)})(?:/|\z)")
        return relative.rlike(rf"(?s)^(?:{_glob(glob.lstrip('/'))})(?:/|\z)")

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def gone_places(claims: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Standing paths under *root* that *listing* (path) lacks; none if the listing is empty."""
    here = under(claims, root)
    seen = listing.where(F.col("path").startswith(root.rstrip("/") + "/"))
    known = seen.select(F.lit(root).alias("root")).distinct()
    lost = here.join(seen.select("path").distinct(), "path", "left_anti").withColumn("root", F.lit(root))
    return lost.join(known, "root", "left_semi").select("path", "subject")


def disappeared(claims: DataFrame, met: DataFrame, roots: list[str], host: str, unreadable: list[str] = (), excludes: list[str] = (), emptied: list[str] = ()) -> DataFrame:
    """Standing places under the walked *roots* that were not *met* (path): (path, subject).

    Spared are places in *unreadable* folders, those that *excludes* hold below their root, those of files that *host*
    never saw, and all of a root where nothing was met, unless it is named in *emptied*.
    """
    spark = claims.sparkSession
    named = lambda places: spark.createDataFrame([(p.rstrip("/"),) for p in places], "place string").distinct()
    rooted = lambda df: held_by(df, named(roots)).withColumnRenamed("place", "root")
    relative = F.regexp_replace(F.substr("path", F.length("root") + 1), "^/+", "")
    seen_here = live_values(claims, ["prov:host"]).where(F.col("value") == quote(host)).select("subject")
    here = rooted(all_paths(claims)).where(~excluded(relative, list(excludes))).join(seen_here, "subject", "left_semi")
    here = here.join(held_by(here.select("path").distinct(), named(unreadable)).select("path"), "path", "left_anti")
    walked = rooted(met.select("path"))
    lost = here.join(walked.select("path").distinct(), "path", "left_anti")
    judged = walked.select("root").distinct().unionByName(named(emptied).withColumnRenamed("place", "root")).distinct()
    return lost.join(judged, "root", "left_semi").select("path", "subject")


def held_by(rows: DataFrame, places: DataFrame) -> DataFrame:
    """*rows* (path, …) at or below one of *places* (place, without a last ``/``), with the longest such ``place``.

    An equality join on the folders of each path, not a comparison of all with all.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = rows.select("path").distinct().select("path", F.explode(above).alias("place")).join(places, "place")
    longest = hits.groupBy("path").agg(F.max_by("place", F.length("place")).alias("place"))
    return rows.join(longest, "path")


def shown_tree(names: list[str]) -> str:
    """Paths as an indented tree, for one screen of a reader."""
    out, open_folders = [], []
    for name in sorted(names):
        *folders, last = [p for p in name.split("/") if p]
        same = 0
        while same < min(len(folders), len(open_folders)) and folders[same] == open_folders[same]:
            same += 1
        out += ["  " * k + folders[k] + "/" for k in range(same, len(folders))]
        out.append("  " * len(folders) + last)
        open_folders = folders
    return "\n".join(out)
