"""Questions about subjects, attributes and runs, each one plan over the record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from claimwright.functions.grammar import json_quote
from claimwright.operators.lineage import descents, edges
from claimwright.plans.ranks import ranked
from claimwright.plans.record import live, live_values, record
from claimwright.plans.terms import CLAIM_FIELDS, part_of, quote

PATHS = ("file:path", "mailbox:place", "file:name")


def values(claims: DataFrame, attribute: str) -> DataFrame:
    """Distinct standing values of one attribute, per subject."""
    return live_values(claims, [attribute]).select("subject", "value")


def values_in(claims: DataFrame, namespace: str) -> DataFrame:
    """Distinct standing (subject, attribute, value) under a namespace."""
    return live_values(claims.where(F.col("attribute").startswith(namespace + ":")))


def field_values(claims: DataFrame, field: str) -> DataFrame:
    """Distinct values that a claim field takes over each subject's standing claims."""
    return live(claims, None, (field,)).where(F.col(field).isNotNull()).select("subject", F.col(field).alias("value")).distinct()


def parts(claims: DataFrame, attribute: str, part: str) -> DataFrame:
    """The distinct part of each standing value that has it, per subject."""
    rows = live_values(claims, [attribute]).select("subject", part_of(F.col("value"), part).alias("part"))
    return rows.where(F.col("part").isNotNull()).distinct()


def about(claims: DataFrame, subject: str) -> DataFrame:
    """Every claim on a subject, retractions included, in record order."""
    return record(claims.where(F.lower("subject") == subject.lower())).orderBy("seq", "position")


def gather(claims: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """Per hit, the projected *names* in question order: rows (subject, asked, name, place, value).

    A name is an attribute, ``ns:`` for a namespace, a part of an attribute (``ns:name.step``) or a
    claim field. ``asked`` is the name's place in the question, ``place`` the 1-based place of a
    value among the distinct ones of its name, in order. Names without values are left out,
    and an attribute that is asked for itself is not repeated by its namespace. One row a value,
    so no list grows with the data.
    """
    plain = [n for n in names if not n.endswith(":") and "." not in n and n not in CLAIM_FIELDS]
    spaces = [n for n in names if n.endswith(":")]
    fields, parted = [n for n in names if n in CLAIM_FIELDS], [n for n in names if "." in n]
    wanted = [F.col("attribute").isin(sorted({*plain, *(n.split(".", 1)[0] for n in parted)})), *[F.col("attribute").startswith(n) for n in spaces]]
    # Fields are those of all standing claims of a hit; otherwise only the named attributes are read.
    bearing = claims if fields else claims.where(reduce(lambda a, b: a | b, wanted))
    rows = live(bearing, None, ("value", *[f for f in fields if f not in ("subject", "attribute", "retract")])).join(hits.select("subject").distinct(), "subject", "left_semi")
    shown = []
    for at, n in enumerate(names):
        if n in fields:
            shown.append((F.lit(at), F.lit(n), json_quote(F.col(n)) if n != "retract" else F.lit(None).cast("string")))
        elif n in spaces:
            own = F.col("attribute").startswith(n) & ~F.col("attribute").isin(plain)
            shown.append((F.lit(at), F.when(own, F.col("attribute")), F.col("value")))
        elif n in parted:
            attribute, part = n.split(".", 1)
            shown.append((F.lit(at), F.when(F.col("attribute") == attribute, F.lit(n)), part_of(F.col("value"), part)))
        else:
            shown.append((F.lit(at), F.when(F.col("attribute") == n, F.lit(n)), F.col("value")))
    made = F.array(*[F.struct(a.alias("asked"), n.alias("name"), v.alias("value")) for a, n, v in shown])
    rows = rows.select("subject", F.inline(made)).where(F.col("name").isNotNull() & F.col("value").isNotNull()).distinct()
    return ranked(rows, ["subject", "asked", "name"], ["value"], "place").select("subject", "asked", "name", "place", "value")


def subjects(claims: DataFrame, scope: str = "held") -> DataFrame:
    return (claims.select(F.lower("subject").alias("subject")) if scope == "record" else live(claims, None, ()).select("subject")).distinct()


def attributes(claims: DataFrame) -> DataFrame:
    """Every attribute ever used."""
    return claims.select("attribute").distinct()


def attribute_counts(claims: DataFrame) -> DataFrame:
    """Files with a standing value, per attribute, 0 included."""
    counts = live(claims, None, ()).select("attribute", "subject").distinct().groupBy("attribute").agg(F.count("*").alias("files"))
    return attributes(claims).join(counts, "attribute", "left").select("attribute", F.coalesce("files", F.lit(0)).alias("files"))


def standing_ids(claims: DataFrame, attribute: str, value: str | None = None) -> DataFrame:
    """Rows (subject, cid) of the standing claims of *attribute*, or of those that give this *value* (JSON text)."""
    rows = live(claims, [attribute], () if value is None else ("value",))
    return (rows if value is None else rows.where(F.col("value") == value)).select("subject", "cid")


def history(claims: DataFrame) -> DataFrame:
    """Runs with their span, counts and sources: (run, first, last, files, claims, retractions, sources)."""
    rows = record(claims).where(F.col("run").isNotNull())
    return rows.groupBy("run").agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.count_distinct("subject").alias("files"), F.count("*").alias("claims"),
        F.count("retracts").alias("retractions"), F.array_join(F.sort_array(F.collect_set("source")), " ").alias("sources"),
    )


def run_order(claims: DataFrame) -> DataFrame:
    """The first claim of each run by (seq, time, position), which orders the runs."""
    first = F.min(F.struct("seq", "time", "position", "cid")).alias("f")
    return record(claims).where(F.col("run").isNotNull()).groupBy("run").agg(first).select("run", "f.seq", "f.time", "f.position", "f.cid")


def run_closing(claims: DataFrame) -> DataFrame:
    """The closing moment of each run, and the place of its last claim."""
    rows = claims.where(F.col("run").isNotNull())
    return rows.groupBy("run").agg(F.max("time").alias("closes"), F.max(F.struct("seq", "time")).alias("l")).select("run", "closes", F.col("l.seq").alias("last_seq"), F.col("l.time").alias("last_time"))


def kinds(claims: DataFrame, mimes: list[str]) -> DataFrame:
    """Subjects whose standing ``file:mime`` is one of *mimes*."""
    return live_values(claims, ["file:mime"]).where(F.col("value").isin([quote(m) for m in mimes])).select("subject").distinct()


def examined(claims: DataFrame, source: str) -> DataFrame:
    """Subjects with a standing receipt of *source*."""
    return live_values(claims, ["prov:examined"]).where(F.col("value") == quote(source)).select("subject").distinct()


def worklist(claims: DataFrame, mimes: list[str], source: str) -> DataFrame:
    """Subjects of a kind that *source* has not examined."""
    return kinds(claims, mimes).join(examined(claims, source), "subject", "left_anti")


def run_sightings(claims: DataFrame) -> DataFrame:
    """Where each run saw each subject: its first kind of place (path, mailbox, name), strings only."""
    rows = record(claims).where(F.col("retracts").isNull() & F.col("run").isNotNull() & F.col("attribute").isin(*PATHS) & F.col("value").startswith('"'))
    return _first_kind(rows.select("run", "subject", "attribute", "value").distinct(), ["run", "subject"])


def placements(claims: DataFrame) -> DataFrame:
    """Where each subject stands now: its first kind of place."""
    rows = live_values(claims, list(PATHS)).where(F.col("value").startswith('"'))
    return _first_kind(rows, ["subject"])


def _first_kind(rows: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.when(F.col("attribute") == PATHS[0], 0).when(F.col("attribute") == PATHS[1], 1).otherwise(2)
    ranked = rows.withColumn("rank", rank)
    best = ranked.groupBy(*keys).agg(F.min("rank").alias("rank"))
    return ranked.join(best, [*keys, "rank"], "left_semi").select(*keys, "attribute", "value")


def resolve(claims: DataFrame, prefix: str) -> DataFrame:
    """The subjects that a digest prefix may mean."""
    return claims.select(F.lower("subject").alias("subject")).where(F.col("subject").startswith(prefix.lower())).distinct()


def shortest_prefix(claims: DataFrame, least: int = 8) -> DataFrame:
    """The shortest unique prefix, of *least* characters or more, of each subject.

    Subjects are grouped by their first characters, so the windows stay small: only
    subjects that agree on *least* characters can need more.
    """
    rows = claims.select(F.lower("subject").alias("subject")).distinct().withColumn("head", F.substring("subject", 1, least))
    w = Window.partitionBy("head").orderBy("subject")
    near = rows.withColumns({"before": F.lag("subject").over(w), "after": F.lead("subject").over(w)})
    shared = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)), i).otherwise(n)
    )
    size = F.greatest(F.lit(least), *[1 + F.when(F.col(c).isNotNull(), shared(F.col("subject"), F.col(c))).otherwise(0) for c in ("before", "after")])
    return near.select("subject", F.substr("subject", F.lit(1), size).alias("short"))


def newest(claims: DataFrame, attribute: str) -> DataFrame:
    """The newest standing value of *attribute* per subject, by (time, cid)."""
    rows = live(claims, [attribute], ("value", "time"))
    return rows.groupBy("subject").agg(F.max(F.struct("time", "cid", "value")).alias("n")).select("subject", "n.value", "n.time", "n.cid")


def first_sightings(claims: DataFrame) -> DataFrame:
    """The earliest time per subject and mailbox place, over all assertions."""
    rows = claims.where((F.col("attribute") == "mailbox:place") & F.col("retracts").isNull())
    return rows.groupBy(F.lower("subject").alias("subject"), F.col("value").alias("place")).agg(F.min("time").alias("first"))


def tally(claims: DataFrame) -> DataFrame:
    """Claims per source: assertions, retractions, subjects."""
    return record(claims).groupBy("source").agg(
        F.count("value").alias("assertions"), F.count("retracts").alias("retractions"), F.count_distinct("subject").alias("files")
    )


def counters(claims: DataFrame) -> DataFrame:
    """Counters of the log, one row. Files are counted after one row a file is left, not by expanding every claim."""
    has = lambda a: F.max((F.col("attribute") == a).cast("bigint"))
    files = record(claims).groupBy("subject").agg(F.count("*").alias("n"), has("file:size").alias("sized"), has("file:mime").alias("typed"), F.max("time").alias("last"))
    segments, referenced = claims.select("seq").distinct().agg(F.count("seq")).scalar(), references(claims).agg(F.count("*")).scalar()
    return files.agg(
        segments.alias("segments"), referenced.alias("referenced"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.count("subject").alias("files"), F.coalesce(F.sum("sized"), F.lit(0)).alias("sized"), F.coalesce(F.sum("typed"), F.lit(0)).alias("typed"), F.max("last").alias("last")
    )


def pairs(claims: DataFrame, attributes: list[str]) -> DataFrame:
    """Standing pairs spelt as the term language reads them: strings bare where that is unambiguous, else in quotes; all else as JSON."""
    rows = live_values(claims, attributes)
    text = F.get_json_object("value", "$")
    plain = (text != "") & ~text.contains("..") & ~text.rlike(r'(?U)[\s*?"]')
    shown = F.when(~F.col("value").startswith('"'), F.col("value")).when(plain, text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return rows.select("subject", F.concat("attribute", F.lit("="), shown).alias("pair"))


def objects(claims: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """The JSON object of each hit, name to sorted list of values, as rows (subject, place, text).

    The texts of a subject, in order of place, are the object: its head, then a text a
    value. So an object of very many values never stands in one row.
    """
    rows = gather(claims, hits, names)
    head = hits.select("subject").distinct().select("subject", F.lit(-1).alias("asked"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("at"), F.concat(F.lit('{"subject":"'), "subject", F.lit('"')).alias("text"))
    value = F.concat(F.when(F.col("place") == 1, F.concat(F.lit(',"'), "name", F.lit('":['))).otherwise(","), "value")
    parts = head.unionByName(rows.select("subject", "asked", "name", F.col("place").cast("bigint").alias("at"), value.alias("text")))
    ends = parts.groupBy("subject", "asked", "name").agg(F.max("at").alias("last"))
    last = ends.groupBy("subject").agg(F.max(F.struct("asked", "name")).alias("end"))
    placed = ranked(parts, ["subject"], ["asked", "name", "at"], "place").join(ends, ["subject", "asked", "name"]).join(last, "subject")
    is_last = F.col("at") == F.col("last")
    list_ends = F.when(is_last & (F.col("asked") >= 0), "]").otherwise("")
    all_ends = F.when(is_last & (F.struct("asked", "name") == F.col("end")), "}").otherwise("")
    return placed.select("subject", "place", F.concat("text", list_ends, all_ends).alias("text"))


def in_run_order(claims: DataFrame) -> DataFrame:
    """``history`` with ``place``, the 1-based place of each run by its first claim."""
    first = run_order(claims).select("run", "seq", "time", "position", F.lit(1).alias("one"))
    return history(claims).join(ranked(first, ["one"], ["seq", "time", "position", "run"], "place").select("run", "place"), "run")


def resolved(claims: DataFrame, given: str) -> DataFrame:
    """The answer to a digest or a prefix of one: a row (answer, subject), ``found``, ``ambiguous`` or ``unknown``.

    A whole digest is taken as it is. An ambiguous prefix names its least subject.
    """
    hits = resolve(claims, given).agg(F.min("subject").alias("low"), F.max("subject").alias("high"))
    whole = len(given) in (64, 96, 128)
    answer = F.when(F.col("low").isNull(), "unknown").when(F.col("low") == F.col("high"), "found").otherwise("ambiguous")
    return hits.select(F.lit("found").alias("answer"), F.lit(given.lower()).alias("subject")) if whole else hits.select(answer.alias("answer"), F.col("low").alias("subject"))


def register_views(claims: DataFrame) -> None:
    """The temporary views ``v_claims``, ``v_standing``, ``v_places`` and ``v_runs`` of the record, for SQL."""
    record(claims).createOrReplaceTempView("v_claims")
    live(claims).createOrReplaceTempView("v_standing")
    values_ = live_values(claims, list(PATHS)).where(F.col("value").startswith('"'))
    values_.select("subject", "attribute", F.get_json_object("value", "$").alias("place")).createOrReplaceTempView("v_places")
    history(claims).createOrReplaceTempView("v_runs")


def run_exists(claims: DataFrame, run: str) -> DataFrame:
    """One row (there): whether the record has a claim of *run*; one claim is read."""
    return claims.where(F.col("run") == run).select("run").limit(1).agg((F.count("*") > 0).alias("there"))


def first(names: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first *n* names of a report that lists only some."""
    return names.orderBy(column).limit(n)


def remembered(worklist_: DataFrame, memo: DataFrame) -> DataFrame:
    """Of a worklist (subject) the files that a memo of examinations (subject) knows: their answers need not be found again."""
    return worklist_.join(memo.select("subject"), "subject", "left_semi")


def run_lines(claims: DataFrame) -> DataFrame:
    """One JSON object a run: (run, line)."""
    sources = F.concat(F.lit("["), F.array_join(F.transform(F.filter(F.split("sources", " "), lambda x: x != ""), json_quote), ","), F.lit("]"))
    parts = [F.lit('{"run":'), json_quote(F.col("run")), F.lit(',"first":'), json_quote(F.col("first")), F.lit(',"last":'), json_quote(F.col("last"))]
    parts += [x for n in ("files", "claims", "retractions") for x in (F.lit(f',"{n}":'), F.col(n).cast("string"))]
    return history(claims).select("run", F.concat(*parts, F.lit(',"sources":'), sources, F.lit("}")).alias("line"))


def attribute_lines(claims: DataFrame) -> DataFrame:
    """One JSON object an attribute with the number of its files: (line)."""
    return attribute_counts(claims).select(F.concat(F.lit('{"attribute":'), json_quote(F.col("attribute")), F.lit(',"files":'), F.col("files").cast("string"), F.lit("}")).alias("line"))


def grep(documents: DataFrame, claims: DataFrame, pattern: str) -> DataFrame:
    """Where texts that match *pattern* come from, all the way up: (subject, path), ``path`` from the first origin down to the text."""
    hits = documents.where(F.col("text").rlike(pattern) & F.col("subject").isNotNull()).select(F.lower("subject").alias("subject")).distinct()
    return descents(edges(claims), hits)


def references(claims: DataFrame) -> DataFrame:
    """The digests that the record refers to: subjects, and files that links name."""
    links = edges(claims).select(F.col("origin").alias("digest"))
    return claims.where(F.col("subject").isNotNull()).select(F.lower("subject").alias("digest")).unionByName(links).distinct()


def ingest_tally(files: DataFrame) -> DataFrame:
    """What became of listed files (status, size): (status, files, bytes) for stored, known, unchanged, excluded, gone and failed ones, 0 included."""
    kinds = files.sparkSession.createDataFrame([(k,) for k in ("stored", "known", "unchanged", "excluded", "gone", "failed")], "status string")
    sums = files.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return kinds.join(sums, "status", "left").select("status", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def extraction_tally(answers: DataFrame) -> DataFrame:
    """What contracts found (answers of ``contracts.examine``): (source, examined, found, derived, skipped)."""
    return answers.groupBy("source").agg(
        F.count_distinct(F.when(F.col("error").isNull(), F.col("subject"))).alias("examined"), F.count(F.when(F.col("derived").isNull(), F.col("attribute"))).alias("found"),
        F.count_distinct("derived").alias("derived"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("subject"))).alias("skipped"),
    )
