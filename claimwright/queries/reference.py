"""The queries of the claim engine over the given record, each with SQL that states the same.

Every query reads its whole tables. Single subjects and runs that a query is about are
taken from the record by a rule (the least one), on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.functions import grammar, mail, names
from claimwright.operators import ask, lineage, paths, reconcile, rewrite, verify, write
from claimwright.operators.changes import ChangeTable, feed_of, split_feed
from claimwright.operators.instants import spelled
from claimwright.operators.orphans import held
from claimwright.plans import find as finder
from claimwright.plans import record as r
from claimwright.plans.tables import table, work_folder
from claimwright.plans.terms import value_matches
from claimwright.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGEST = "^([0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$"
#: Views that the SQL of the queries shares: one row per claim, the standing claims, the lineage.
PRELUDE = f"""WITH RECURSIVE rec AS (
  SELECT lower(subject) AS subject, attribute, value, time, source, run, list_transform(retracts, lambda x: lower(x)) AS retracts, lower(cid) AS cid, seq, position
  FROM claims QUALIFY row_number() OVER (PARTITION BY lower(cid) ORDER BY seq DESC, position DESC) = 1),
targets AS (SELECT DISTINCT unnest(retracts) AS target, subject, attribute FROM rec WHERE retracts IS NOT NULL),
live AS (SELECT * FROM rec c WHERE retracts IS NULL AND NOT EXISTS (
  SELECT 1 FROM targets t WHERE t.target = c.cid AND t.subject = c.subject AND t.attribute = c.attribute)),
vals AS (SELECT DISTINCT subject, attribute, value FROM live),
links AS (SELECT DISTINCT regexp_extract(value, '^"([0-9a-f]+)"$', 1) AS origin, subject FROM live
  WHERE attribute = 'prov:origin' AND regexp_matches(regexp_extract(value, '^"([0-9a-f]+)"$', 1), '{DIGEST}')),
roots AS (SELECT DISTINCT subject FROM live WHERE attribute = 'mailbox:place' OR (attribute = 'file:path' AND value NOT LIKE '"@%')),
placed(subject) AS (SELECT subject FROM roots UNION SELECT l.subject FROM placed p JOIN links l ON l.origin = p.subject),
held AS (SELECT DISTINCT lower(digest) AS digest FROM blobs WHERE removed IS NULL),
refs AS (SELECT DISTINCT lower(subject) AS digest FROM claims),
paths AS (SELECT DISTINCT json_extract_string(value, '$') AS path, subject FROM live WHERE attribute = 'file:path' AND value LIKE '"%')
"""


def _add(name: str, sql: str | None, *tables: str):
    """Registers the function below as query *name* over *tables*, with its SQL after the prelude."""

    def put(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables or ("claims",)))
        if sql is not None:
            SQL[name] = PRELUDE + sql
        return f

    return put


def _find(name: str, terms: list[str], sql: str, missing: tuple[str, ...] = (), scope: str = "held"):
    _add(name, sql)(lambda claims: finder.find(claims, terms, missing, scope))


# -- the record and its views

_add("record_claims", "SELECT cid, subject, attribute, value, time, source, run, seq, position FROM rec")(lambda c: r.record(c).drop("retracts"))
_add("record_targets", "SELECT target, subject, attribute FROM targets")(
    lambda c: split_feed(c)[1].select(F.col("claim").alias("target"), "subject", "attribute").distinct()
)
_add("standing_claims", "SELECT subject, attribute, cid, value, time, source, run FROM live")(lambda c: r.live(c).drop("seq"))
_add("standing_values", "SELECT subject, attribute, value FROM vals")(r.live_values)
_add("subjects_scope", "SELECT DISTINCT subject FROM live")(ask.subjects)
_add("subjects_record", "SELECT DISTINCT subject FROM rec")(lambda c: ask.subjects(c, "record"))
_add("attributes", "SELECT DISTINCT attribute FROM rec")(ask.attributes)
_add(
    "attribute_counts",
    "SELECT a.attribute, count(DISTINCT l.subject) AS files FROM (SELECT DISTINCT attribute FROM rec) a LEFT JOIN live l ON l.attribute = a.attribute GROUP BY 1",
)(ask.attribute_counts)
_add(
    "v_places",
    "SELECT subject, attribute, json_extract_string(value, '$') AS place FROM vals WHERE attribute IN ('file:path', 'mailbox:place', 'file:name') AND value LIKE '\"%'",
)(lambda c: r.live_values(c, list(ask.PATHS)).where(F.col("value").startswith('"')).select("subject", "attribute", paths.path_text(F.col("value")).alias("place")))



def _views(claims: DataFrame) -> DataFrame:
    """A question in SQL over the views of the record."""
    ask.register_views(claims)
    return claims.sparkSession.sql(
        "SELECT p.attribute, count(DISTINCT p.subject) AS files, count(DISTINCT s.run) AS runs, (SELECT max(last) FROM v_runs) AS last, (SELECT count(*) FROM v_claims"
    " WHERE retracts IS NOT NULL) AS retractions"
        " FROM v_places p JOIN v_standing s ON s.subject = p.subject AND s.attribute = p.attribute GROUP BY p.attribute"
    )


_add(
    "views_sql",
    """, p AS (SELECT subject, attribute FROM vals WHERE attribute IN ('file:path', 'mailbox:place', 'file:name') AND value LIKE '"%')
    SELECT p.attribute, count(DISTINCT p.subject) AS files, count(DISTINCT l.run) AS runs, (SELECT max(time) FROM rec WHERE run IS NOT NULL) AS last, (SELECT count(*)
      FROM rec WHERE retracts IS NOT NULL) AS retractions
    FROM p JOIN live l ON l.subject = p.subject AND l.attribute = p.attribute GROUP BY p.attribute""",
)(_views)

# -- find: patterns

_find("find_exact", ["file:mime=text/plain"], "SELECT DISTINCT subject FROM live WHERE attribute = 'file:mime' AND value = '\"text/plain\"'")
_find("find_literal", ['user:tag="keep"'], "SELECT DISTINCT subject FROM live WHERE attribute = 'user:tag' AND value = '\"keep\"'")
_find("find_glob", ["file:path=/photos/*.JPG"], "SELECT DISTINCT subject FROM live WHERE attribute = 'file:path' AND regexp_matches(value, '(?s)^\"/photos/.*\\.JPG\"$')")
_find("find_glob_question", ["file:name=pack-?9?.zip"], "SELECT DISTINCT subject FROM live WHERE attribute = 'file:name' AND regexp_matches(value, '(?s)^\"pack-.9.\\.zip\"$')")
_find("find_glob_class", ["file:name=*[^0-4].[pz]*"], "SELECT DISTINCT subject FROM live WHERE attribute = 'file:name' AND regexp_matches(value, '(?s)^\".*[^0-4]\\.[pz].*\"$')")
_find("find_number_exact", ["raster:depth=8"], "SELECT DISTINCT subject FROM live WHERE attribute = 'raster:depth' AND value IN ('8', '\"8\"')")
_NUMBER = r"regexp_matches(value, '^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$') AND try_cast(value AS DOUBLE)"
_find("find_number_range", ["file:size=1000..50000"], f"SELECT DISTINCT subject FROM live WHERE attribute = 'file:size' AND {_NUMBER} BETWEEN 1000 AND 50000")
_find("find_number_open", ["raster:width=3000.."], f"SELECT DISTINCT subject FROM live WHERE attribute = 'raster:width' AND {_NUMBER} >= 3000")
_find(
    "find_text_range", ["exif:date-time-original=2024..2025-06"],
    "SELECT DISTINCT subject FROM live WHERE attribute = 'exif:date-time-original' AND value LIKE '\"%' AND value >= '\"2024\"' AND value <= '\"2025-06\"'",
)
_find("find_presence", ["geo:position=.."], "SELECT DISTINCT subject FROM live WHERE attribute = 'geo:position' AND value IS NOT NULL")
_LAT, _LON = ("try_cast(json_extract_string(value, '$.latitude') AS DOUBLE)", "try_cast(json_extract_string(value, '$.longitude') AS DOUBLE)")
_IS = "json_type(value, '$.{}') IN ('DOUBLE', 'BIGINT', 'UBIGINT')"
_find(
    "find_part", ["geo:position.latitude=30..60"],
    f"SELECT DISTINCT subject FROM live WHERE attribute = 'geo:position' AND json_valid(value) AND {_IS.format('latitude')} AND {_LAT} BETWEEN 30 AND 60",
)
_find(
    "find_parts_one_value", ["geo:position.latitude=30..60", "geo:position.longitude=0..150"],
    f"SELECT DISTINCT subject FROM live WHERE attribute = 'geo:position' AND json_valid(value) AND {_IS.format('latitude')} AND {_LAT} BETWEEN 30 AND 60"
    f" AND {_IS.format('longitude')} AND {_LON} BETWEEN 0 AND 150",
)
_find(
    "find_missing_part", ["geo:position=.."],
    "SELECT DISTINCT subject FROM live WHERE attribute = 'geo:position' AND subject NOT IN"
    " (SELECT subject FROM live WHERE attribute = 'geo:position' AND json_valid(value) AND json_type(value, '$.altitude') IS NOT NULL)",
    ("geo:position.altitude",),
)

# -- find: fields, several terms, missing names, scopes

_find("find_field_source", ["source=extractor:*", "raster:depth=.."], "SELECT DISTINCT subject FROM live WHERE attribute = 'raster:depth' AND source LIKE 'extractor:%'")
_find("find_field_time_day", ["time=2024-06-05"], "SELECT DISTINCT subject FROM live WHERE time >= '2024-06-05T00:00:00Z' AND time <= '2024-06-05T23:59:59Z'")
_find(
    "find_field_time_range", ["time=2024-05-02..2024-07-01T12:00:00", "file:mime=.."],
    "SELECT DISTINCT subject FROM live WHERE attribute = 'file:mime' AND time >= '2024-05-02T00:00:00Z' AND time <= '2024-07-01T12:00:00Z'",
)
_find("find_field_subject_prefix", ["subject=a8*"], "SELECT DISTINCT subject FROM live WHERE subject LIKE 'a8%'")
_find("find_field_retract", ["retract=true"], "SELECT DISTINCT subject FROM rec WHERE retracts IS NOT NULL", scope="record")
_find(
    "find_two_terms", ["file:mime=image/jpeg", "exif:make=.."],
    "SELECT subject FROM live WHERE attribute = 'file:mime' AND value = '\"image/jpeg\"' INTERSECT SELECT subject FROM live WHERE attribute = 'exif:make'",
)
_find(
    "find_two_ranges_one_attr", ["user:tag=a..m", "user:tag=n..z"],
    "SELECT subject FROM live WHERE attribute = 'user:tag' AND value LIKE '\"%' AND value >= '\"a\"' AND value <= '\"m\"'"
    " INTERSECT SELECT subject FROM live WHERE attribute = 'user:tag' AND value LIKE '\"%' AND value >= '\"n\"' AND value <= '\"z\"'",
)
_find("find_missing_attr", ["file:mime=image/jpeg"], "SELECT subject FROM live WHERE attribute = 'file:mime' AND value = '\"image/jpeg\"' EXCEPT SELECT subject FROM live"
    " WHERE attribute = 'user:tag'", ("user:tag",))
_find("find_missing_namespace", [], "SELECT subject FROM live EXCEPT SELECT subject FROM live WHERE attribute LIKE 'exif:%'", ("exif:",))
_find("find_held", ["file:mime=message/rfc822"], "SELECT DISTINCT subject FROM live WHERE attribute = 'file:mime' AND value = '\"message/rfc822\"'")
_find("find_present", ["file:mime=message/rfc822"], "SELECT DISTINCT subject FROM live"
    " WHERE attribute = 'file:mime' AND value = '\"message/rfc822\"' AND subject IN (SELECT subject FROM placed)", scope="present")
_find("find_record", ["file:mime=message/rfc822"], "SELECT DISTINCT subject FROM rec WHERE attribute = 'file:mime' AND value = '\"message/rfc822\"'", scope="record")
_find(
    "find_full_question", ["file:mime=message/rfc822", "mailbox:place=work:*", "source=mailvault"],
    "SELECT subject FROM live WHERE attribute = 'file:mime' AND value = '\"message/rfc822\"' AND source = 'mailvault' INTERSECT"
    " SELECT subject FROM live WHERE attribute = 'mailbox:place' AND regexp_matches(value, '(?s)^\"work:.*\"$') AND source = 'mailvault'"
    " INTERSECT SELECT subject FROM placed EXCEPT SELECT subject FROM live WHERE attribute = 'user:tag'",
    ("user:tag",), "present",
)

_RUN = "(SELECT run FROM claims WHERE run IS NOT NULL GROUP BY run ORDER BY count(*) DESC, run LIMIT 1)"


def _largest_run(claims: DataFrame) -> str:
    """The run of most claims, the least of several."""
    return claims.where(F.col("run").isNotNull()).groupBy("run").count().agg(F.min_by("run", F.struct(-F.col("count"), "run"))).first()[0]


_add("find_field_run", f"SELECT DISTINCT subject FROM live WHERE run = {_RUN}")(lambda c: finder.find(c, [finder.Term("run", _largest_run(c))]))

# -- projections

_add("values_of_attribute", "SELECT subject, value FROM vals WHERE attribute = 'user:tag'")(lambda c: ask.values(c, "user:tag"))
_add("values_in_namespace", "SELECT * FROM vals WHERE attribute LIKE 'raster:%'")(lambda c: ask.values_in(c, "raster"))
_add("field_values", "SELECT DISTINCT subject, source AS value FROM live")(lambda c: ask.field_values(c, "source"))
_add("standing_of_subject", "SELECT attribute, value FROM vals WHERE subject = (SELECT min(subject) FROM rec)")(
    lambda c: r.live_values(c.where(F.lower("subject") == c.agg(F.min(F.lower("subject"))).scalar())).select("attribute", "value")
)
_add("about_subject", "SELECT cid, attribute, value, time, seq, position FROM rec WHERE subject = (SELECT min(subject) FROM rec)")(
    lambda c: ask.about(c, c.agg(F.min(F.lower("subject"))).first()[0]).select("cid", "attribute", "value", "time", "seq", "position")
)
_add(
    "gather_projection",
    """, hit AS (SELECT DISTINCT subject FROM vals WHERE attribute = 'file:mime' AND value = '"image/jpeg"'), g AS (
      SELECT DISTINCT subject, 0 AS asked, 'file:path' AS name, value FROM vals WHERE attribute = 'file:path' AND subject IN (FROM hit)
      UNION SELECT subject, 1, attribute, value FROM vals WHERE attribute LIKE 'raster:%' AND attribute <> 'raster:width' AND subject IN (FROM hit)
      UNION SELECT subject, 2, 'raster:width', value FROM vals WHERE attribute = 'raster:width' AND subject IN (FROM hit)
      UNION SELECT subject, 3, 'source', '"' || source || '"' FROM live WHERE subject IN (FROM hit))
    SELECT *, row_number() OVER (PARTITION BY subject, asked, name ORDER BY value) AS place FROM g""",
)(lambda c: ask.gather(c, finder.find(c, ["file:mime=image/jpeg"]), ["file:path", "raster:", "raster:width", "source"]))
_add("gather_parts", None)(lambda c: ask.gather(c, finder.find(c, ["geo:position=.."]), ["geo:position.latitude", "geo:position.altitude"]))
_add("standing_bare", "SELECT subject, json_extract_string(value, '$') AS value FROM vals WHERE attribute = 'file:name' AND value LIKE '\"%'")(
    lambda c: ask.values(c, "file:name").where(F.col("value").startswith('"')).select("subject", paths.path_text(F.col("value")).alias("value"))
)
_add("parts_projection", "SELECT DISTINCT subject, regexp_replace(regexp_replace(json_extract(value, '$.altitude')::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS part"
    " FROM live WHERE attribute = 'geo:position' AND json_valid(value) AND json_extract(value, '$.altitude') IS NOT NULL")(lambda c: ask.parts(c, "geo:position", "altitude"))
_add("standing_ids", "SELECT subject, cid FROM live WHERE attribute = 'user:tag'")(lambda c: ask.standing_ids(c, "user:tag"))
_add("standing_ids_of_value", "SELECT subject, cid FROM live WHERE attribute = 'user:tag' AND value = '\"keep\"'")(lambda c: ask.standing_ids(c, "user:tag", '"keep"'))
_add("resolve_answers", "SELECT CASE count(DISTINCT subject) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS answer, min(subject) AS subject FROM rec"
    " WHERE subject LIKE 'a8%'")(lambda c: ask.resolved(c, "A8"))
_add("runs_in_order", "SELECT run, row_number() OVER (ORDER BY seq, time, position, run) AS place FROM (SELECT * FROM rec WHERE run IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq, time, position) = 1)")(
    lambda c: ask.in_run_order(c).select("run", "place")
)
_TEXT = "json_extract_string(value, '$')"
_add(
    "pair_spelling",
    f"""SELECT subject, attribute || '=' || CASE WHEN value NOT LIKE '"%' THEN value
      WHEN {_TEXT} <> '' AND NOT contains({_TEXT}, '..') AND NOT regexp_matches({_TEXT}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}*?"]')
    THEN {_TEXT} ELSE '"' || {_TEXT} || '"' END AS pair FROM vals WHERE attribute IN ('file:name', 'user:tag', 'file:size')""".replace("\\\\", "\\"),
)(lambda c: ask.pairs(c, ["file:name", "user:tag", "file:size"]))
_add(
    "json_match_objects",
    """, lists AS (SELECT subject, attribute, value, row_number() OVER (PARTITION BY subject, attribute ORDER BY value) AS n, count(*) OVER (PARTITION BY subject, attribute) AS last,
      row_number() OVER (PARTITION BY subject ORDER BY CASE attribute WHEN 'user:tag' THEN 0 ELSE 1 END, value) AS place, count(*) OVER (PARTITION BY subject) AS whole
      FROM vals WHERE attribute IN ('user:tag', 'file:mime'))
    SELECT DISTINCT subject, 1 AS place, '{"subject":"' || subject || '"' AS text FROM vals WHERE attribute = 'file:mime'
    UNION ALL SELECT subject, place + 1, CASE WHEN n = 1 THEN ',"' || attribute || '":[' ELSE ',' END || value || CASE WHEN n = last THEN ']' ELSE '' END || CASE
      WHEN place = whole THEN '}' ELSE '' END
      FROM lists WHERE subject IN (SELECT subject FROM vals WHERE attribute = 'file:mime')""",
)(lambda c: ask.objects(c, finder.find(c, ["file:mime=.."]), ["user:tag", "file:mime"]))

# -- runs and moments

_add(
    "history_runs",
    "SELECT run, min(time) AS first, max(time) AS last, count(DISTINCT subject) AS files, count(*) AS claims, count(retracts) AS retractions,"
    " string_agg(DISTINCT source, ' ' ORDER BY source) AS sources FROM rec WHERE run IS NOT NULL GROUP BY run",
)(ask.history)
_add("run_first_claim", "SELECT run, seq, time, position, cid FROM rec WHERE run IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq, time, position) = 1")(ask.run_order)
_add(
    "run_closing",
    "SELECT run, max(time) AS closes, max(seq) AS last_seq, arg_max(time, (seq, time)) AS last_time FROM claims WHERE run IS NOT NULL GROUP BY run",
)(ask.run_closing)
_add("run_exists", f"SELECT count(*) > 0 AS there FROM rec WHERE run = {_RUN}")(lambda c: ask.run_exists(c, _largest_run(c)))
_CUT = "2025-01-01T00:00:00Z"
_AS_OF = f"""SELECT DISTINCT c.subject, c.attribute, c.value FROM rec c WHERE c.retracts IS NULL AND c.time <= '{_CUT}' AND NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(retracts) AS target, subject, attribute FROM rec WHERE retracts IS NOT NULL AND time <= '{_CUT}') t
  WHERE t.target = c.cid AND t.subject = c.subject AND t.attribute = c.attribute)"""
_add("as_of_time", _AS_OF)(lambda c: r.live_values(r.as_of(c, _CUT)))
_add("standing_as_of_attribute", f"SELECT * FROM ({_AS_OF}) WHERE attribute = 'user:tag'")(lambda c: r.live_values(r.as_of(c, _CUT), ["user:tag"]))
_add(
    "as_of_diff",
    f"""SELECT subject, value, 'assert' AS change FROM (SELECT subject, value FROM vals WHERE attribute = 'file:path' EXCEPT SELECT subject, value
      FROM ({_AS_OF}) WHERE attribute = 'file:path')
    UNION ALL SELECT subject, value, 'retract' FROM (SELECT subject, value
      FROM ({_AS_OF}) WHERE attribute = 'file:path' EXCEPT SELECT subject, value FROM vals WHERE attribute = 'file:path')""",
)(lambda c: reconcile.snapshot_changes(r.live_values(r.as_of(c, _CUT), ["file:path"]), r.live_values(c, ["file:path"]), ["subject", "value"]))
_BY_RUN = f"""SELECT * FROM claims, (SELECT max((seq, time)) AS l FROM claims
      WHERE run = {_RUN}) WHERE seq < l[1] OR (seq = l[1] AND (time < l[2] OR (time = l[2] AND run = {_RUN})))"""
_add("as_of_run", f"SELECT lower(cid) AS cid, count(*) AS n FROM ({_BY_RUN}) GROUP BY 1")(
    lambda c: r.as_of_run(c, _largest_run(c)).groupBy(F.lower("cid").alias("cid")).agg(F.count("*").alias("n"))
)
_add("run_tally", "SELECT source, count(value) AS assertions, count(retracts) AS retractions, count(DISTINCT subject) AS files FROM rec GROUP BY 1")(ask.tally)
_add(
    "log_counters",
    "SELECT count(DISTINCT seq) AS segments, (SELECT count(*) FROM (SELECT digest FROM refs UNION SELECT origin"
    " FROM links)) AS referenced, count(*) AS claims, count(DISTINCT subject) AS files, count(DISTINCT subject) FILTER (WHERE attribute = 'file:size') AS sized,"
    " count(DISTINCT subject) FILTER (WHERE attribute = 'file:mime') AS typed, max(time) AS last FROM rec",
)(ask.counters)
_add("first_sighting", "SELECT subject, value AS place, min(time) AS first FROM rec WHERE attribute = 'mailbox:place' AND retracts IS NULL GROUP BY 1, 2")(ask.first_sightings)

_add(
    "run_lines",
    """, h AS (SELECT run, min(time) AS first, max(time) AS last, count(DISTINCT subject) AS files, count(*) AS claims, count(retracts) AS retractions, list_sort(list(DISTINCT source)) AS sources
      FROM rec WHERE run IS NOT NULL GROUP BY run)
    SELECT run, '{"run":"' || run || '","first":"' || first || '","last":"' || last || '","files":' || files || ',"claims":' || claims || ',"retractions":' || retractions || ',"sources":["' || array_to_string(sources, '","') || '"]}' AS line FROM h""",
)(ask.run_lines)
_add(
    "attribute_lines",
    """SELECT '{"attribute":"' || a.attribute || '","files":' || count(DISTINCT l.subject) || '}' AS line FROM (SELECT DISTINCT attribute FROM rec) a LEFT
      JOIN live l ON l.attribute = a.attribute GROUP BY a.attribute""",
)(ask.attribute_lines)
_add(
    "ingest_tally",
    """SELECT k AS status, count(d.doc_id) AS files, coalesce(sum(octet_length(encode(d.text))), 0)::BIGINT AS bytes
      FROM (SELECT unnest(['stored', 'known', 'unchanged', 'excluded', 'gone', 'failed']) AS k)
    LEFT JOIN (SELECT doc_id, text, CASE WHEN text IS NULL THEN 'failed' WHEN lower(subject) IN (SELECT digest FROM held) THEN 'known' ELSE 'stored' END AS status
      FROM documents WHERE subject IS NOT NULL) d ON d.status = k GROUP BY k""",
    "documents", "blobs",
)(
    lambda d, b: ask.ingest_tally(
        write.admit(d.where("subject IS NOT NULL").select(F.lower("subject").alias("subject"), "text"), held(b))
        .select(F.when(F.col("text").isNull(), "failed").when(F.col("fresh"), "stored").otherwise("known").alias("status"), F.octet_length("text").alias("size"))
    )
)

# -- kinds, worklists, places

_add("of_kind", "SELECT DISTINCT subject FROM live"
    " WHERE attribute = 'file:mime' AND value IN ('\"image/jpeg\"', '\"application/pdf\"')")(lambda c: ask.kinds(c, ["image/jpeg", "application/pdf"]))
_SOURCE = "extractor:image-exif/1"
_add(
    "worklist",
    f"SELECT subject FROM live WHERE attribute = 'file:mime' AND value = '\"image/jpeg\"' EXCEPT SELECT subject FROM live"
    f" WHERE attribute = 'prov:examined' AND value = '\"{_SOURCE}\"'",
)(lambda c: ask.worklist(c, ["image/jpeg"], _SOURCE))
_add("examined", f"SELECT DISTINCT subject FROM live WHERE attribute = 'prov:examined' AND value = '\"{_SOURCE}\"'")(lambda c: ask.examined(c, _SOURCE))
_KIND = "CASE attribute WHEN 'file:path' THEN 0 WHEN 'mailbox:place' THEN 1 ELSE 2 END"
_KINDS = "attribute IN ('file:path', 'mailbox:place', 'file:name') AND value LIKE '\"%'"
_add(
    "run_sightings",
    f"SELECT DISTINCT run, subject, attribute, value FROM rec WHERE retracts IS NULL AND run IS NOT NULL AND {_KINDS}"
    f" QUALIFY {_KIND} = min({_KIND}) OVER (PARTITION BY run, subject)",
)(ask.run_sightings)
_add("placements", f"SELECT subject, attribute, value FROM vals WHERE {_KINDS} QUALIFY {_KIND} = min({_KIND}) OVER (PARTITION BY subject)")(ask.placements)
_add("resolve_prefix", "SELECT DISTINCT subject FROM rec WHERE subject LIKE 'a8e%'")(lambda c: ask.resolve(c, "A8E"))
_add(
    "shortest_prefix",
    """, n AS (SELECT subject, lag(subject) OVER (ORDER BY subject) AS a, lead(subject) OVER (ORDER BY subject) AS b FROM (SELECT DISTINCT subject FROM rec))
    SELECT subject, subject[1:greatest(8, 1 + coalesce(len(list_filter(range(1, 129), lambda i: i <= length(subject) AND subject[1:i] = a[1:i])), 0), 1 + coalesce(len(list_filter(range(1, 129), lambda i: i <= length(subject) AND subject[1:i] = b[1:i])), 0))] AS short FROM n""",
)(ask.shortest_prefix)
_add("newest_value", "SELECT subject, value, time, cid FROM live WHERE attribute = 'file:size'"
    " QUALIFY row_number() OVER (PARTITION BY subject ORDER BY time DESC, cid DESC) = 1")(lambda c: ask.newest(c, "file:size"))

# -- lineage

_add("placed_closure", "SELECT DISTINCT subject FROM placed")(lineage.placed)
_add("placed_hits", "SELECT subject FROM live WHERE attribute = 'file:mime' AND value = '\"text/plain\"' INTERSECT SELECT subject FROM placed")(
    lambda c: lineage.placed_hits(c, finder.find(c, ["file:mime=text/plain"]))
)
_add("derived_step", "SELECT origin, subject FROM links")(lineage.edges)
_add("origins_step", "SELECT subject, count(*) AS origins FROM links GROUP BY 1")(lambda c: lineage.edges(c).groupBy("subject").agg(F.count("*").alias("origins")))
_add(
    "derivation_tree",
    ", tree(root, node, depth) AS (SELECT subject, subject, 0 FROM roots UNION SELECT t.root, l.subject, t.depth + 1 FROM tree t JOIN links l ON l.origin = t.node"
    " WHERE t.depth < 20)"
    " SELECT root, node, min(depth) AS depth FROM tree GROUP BY 1, 2",
)(lambda c: lineage.trees(lineage.edges(c), lineage.roots(c)).select("root", "node", "depth"))
_add(
    "descents",
    ", hits AS (SELECT DISTINCT subject FROM links), climb(subject, path, top) AS (SELECT subject, subject, subject FROM hits UNION ALL"
    " SELECT c.subject, l.origin || ' ' || c.path, l.origin FROM climb c JOIN links l ON l.subject = c.top WHERE NOT contains(c.path, l.origin))"
    " SELECT subject, path FROM climb WHERE top NOT IN (SELECT subject FROM links)",
)(lambda c: lineage.descents(lineage.edges(c), lineage.edges(c).select("subject").distinct()).select("subject", F.array_join("path", " ").alias("path")))
def _only_from_sql(rounds: int = 8) -> str:
    """Files that came only from missing ones, in so many rounds; the data are less deep."""
    out = ", kept AS (SELECT DISTINCT lower(digest) AS subject FROM blobs WHERE store = 'content'), o0 AS (SELECT digest AS subject FROM refs WHERE digest NOT IN (SELECT digest FROM held))"
    for n in range(1, rounds + 1):
        out += f", o{n} AS (SELECT subject FROM o{n - 1} UNION SELECT subject FROM links GROUP BY subject HAVING bool_and(origin IN (SELECT subject FROM o{n - 1})) AND subject NOT IN (SELECT subject FROM kept))"
    return out


_add("only_from", _only_from_sql() + " SELECT subject FROM o8", "claims", "blobs")(
    lambda c, b: lineage.only_from(lineage.edges(c), verify.missing(c, b).select(F.col("digest").alias("subject")), b.where(F.col("store") == "content").select(F.lower("digest").alias("subject")))
)
_add(
    "grep_then_origin",
    "SELECT DISTINCT d.subject, l.origin FROM documents d JOIN links l ON l.subject = lower(d.subject) WHERE contains(d.text, 'attachment')",
    "documents", "claims",
)(
    lambda d, c: d.where(F.col("text").contains("attachment")).select(F.lower("subject").alias("subject")).join(lineage.edges(c), "subject").select("subject", "origin").distinct()
)

_DOWN = (
    ", tree(root, node, path, depth) AS (SELECT subject, subject, [subject], 0 FROM roots UNION ALL SELECT t.root, l.subject, list_append(t.path, l.subject), t.depth + 1"
    " FROM tree t JOIN links l ON l.origin = t.node WHERE t.depth < 20 AND NOT list_contains(t.path, l.subject)),"
    " best AS (SELECT root, node, depth, path FROM tree QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY depth, path[depth], path) = 1)"
)
_add("flat_lineage", _DOWN + " SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS place FROM best")(
    lambda c: lineage.flat(lineage.trees(lineage.edges(c), lineage.roots(c))).select("root", "node", "place")
)
_add(
    "lineage_lines",
    _DOWN + """, o AS (SELECT *, row_number() OVER w AS place, lag(depth) OVER w AS last, lead(depth) OVER w AS next FROM best WINDOW w AS (PARTITION BY root ORDER BY path))
    SELECT root, place, CASE WHEN depth <= last THEN ',' ELSE '' END || '{"subject":"' || node || '","derived":[' || CASE WHEN next > depth THEN ''
      ELSE repeat(']}', depth - coalesce(next, 0) + 1) END AS text FROM o""",
)(lambda c: lineage.tree_lines(lineage.trees(lineage.edges(c), lineage.roots(c))))
_add(
    "grep_lineage",
    ", hits AS (SELECT DISTINCT lower(subject) AS subject FROM documents"
    " WHERE regexp_matches(text, '(?i)attach(ment|ed)') AND subject IS NOT NULL), climb(subject, path, top) AS (SELECT subject, [subject], subject FROM hits UNION ALL"
    " SELECT c.subject, list_prepend(l.origin, c.path), l.origin FROM climb c JOIN links l ON l.subject = c.top WHERE NOT list_contains(c.path, l.origin))"
    " SELECT subject, array_to_string(path, ' ') AS path FROM climb WHERE top NOT IN (SELECT subject FROM links)",
    "documents", "claims",
)(lambda d, c: ask.grep(d, c, "(?i)attach(ment|ed)").select("subject", F.array_join("path", " ").alias("path")))

# -- paths and layout

_add("under_place", "SELECT path, subject FROM paths WHERE path = '/photos' OR starts_with(path, '/photos/')")(lambda c: paths.under(c, "/photos"))
_add(
    "ls_level",
    ", e AS (SELECT split_part(path[9:], '/', 1) AS name, contains(path[9:], '/') AS deep FROM paths WHERE starts_with(path, '/photos/'))"
    " SELECT name, count(*) FILTER (WHERE NOT deep) AS files, count(*) FILTER (WHERE deep) AS below FROM e WHERE name <> '' GROUP BY 1",
)(lambda c: paths.level(c, "/photos"))
_add(
    "level_lines",
    """, e AS (SELECT subject, split_part(path[9:], '/', 1) AS name, contains(path[9:], '/') AS deep FROM paths
      WHERE starts_with(path, '/photos/')), n AS (SELECT DISTINCT subject, name FROM e WHERE NOT deep AND name <> ''),
    p AS (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY subject) - 1) // 1000 AS part FROM n)
    SELECT DISTINCT name, 'folder' AS kind, 0 AS part, '{"folder":' || to_json(name) || '}' AS line FROM e WHERE deep AND name <> ''
    UNION ALL SELECT name, 'file', part, '{"file":' || to_json(name) || ',"subjects":["' || string_agg(subject, '","' ORDER BY subject) || '"]}' FROM p GROUP BY name, part""",
)(lambda c: paths.level_lines(c, "/photos"))
_add(
    "tree_counts",
    ", e AS (SELECT string_split(path, '/') AS p FROM paths WHERE path LIKE '/%'), f AS (SELECT array_to_string(p[1:n], '/') || '/' AS folder"
    " FROM (SELECT p, unnest(range(1, len(p))) AS n FROM e))"
    " SELECT folder, count(*) AS files FROM f GROUP BY 1",
)(paths.tree_counts)
_add(
    "newest_path_winner",
    ", w AS (SELECT json_extract_string(value, '$') AS path, subject, time, cid FROM live WHERE attribute = 'file:path' AND value LIKE '\"%')"
    " SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY path ORDER BY time DESC, cid DESC) = 1",
)(paths.newest_by_path)
_PARTS = "list_filter(string_split({}, '/'), lambda x: x NOT IN ('', '.', '..'))"
_ASIDE = "regexp_replace({0}, '(?s)^(.*[^/])(\\.[^./]*)$', '\\1-' || {1} || '\\2')"
_EPOCH = "(epoch(make_date(y::BIGINT, m::BIGINT, 1)) + (d - 1) * 86400 + h * 3600 + mi * 60 + s)::BIGINT"
_add(
    "forest",
    f""", won AS (SELECT {_PARTS.format('path')} AS c, path, subject, time FROM (SELECT json_extract_string(value, '$') AS path, subject, time, cid FROM live
      WHERE attribute = 'file:path' AND value LIKE '"%')
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY time DESC, cid DESC) = 1),
    file AS (SELECT * FROM won WHERE len(c) > 0 QUALIFY row_number() OVER (PARTITION BY c ORDER BY path DESC) = 1),
    folder AS (SELECT DISTINCT c[1:n] AS c FROM (SELECT c, unnest(range(1, len(c))) AS n FROM file)),
    shown AS (SELECT CASE WHEN c IN (SELECT c FROM folder) THEN list_append(c[1:len(c) - 1], CASE
      WHEN regexp_matches(c[len(c)], '^(.*[^/])(\\.[^./]*)$') THEN {_ASIDE.format('c[len(c)]', 'subject[1:8]')} ELSE c[len(c)] || '-' || subject[1:8] END)
      ELSE c END AS c, subject, time FROM file),
    size AS (SELECT subject, try_cast(value AS BIGINT) AS size FROM live WHERE attribute = 'file:size'
      QUALIFY row_number() OVER (PARTITION BY subject ORDER BY time DESC, cid DESC) = 1),
    changed AS (SELECT subject, json_extract_string(value, '$') AS moment FROM live WHERE attribute = 'file:modified'
      QUALIFY row_number() OVER (PARTITION BY subject ORDER BY time DESC, cid DESC) = 1),
    t AS (SELECT DISTINCT x, regexp_extract(x, '^([0-9]+)-([0-9]+)-([0-9]+)T([0-9]+):([0-9]+):([0-9]+)([.].*)?Z?$', ['y', 'm', 'd', 'h', 'mi', 's', 'f']) AS g
      FROM (SELECT moment AS x FROM changed UNION SELECT time FROM won)),
    u AS (SELECT x, {_EPOCH} AS e FROM (SELECT x, try_cast(g.y AS BIGINT) AS y, try_cast(g.m AS BIGINT) AS m, try_cast(g.d AS BIGINT) AS d, try_cast(g.h AS BIGINT) AS h, try_cast(g.mi AS BIGINT) AS mi, try_cast(g.s AS BIGINT) AS s FROM t)
      WHERE m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND h <= 23 AND mi <= 59 AND y <= 9999),
    e AS (SELECT x, e FROM u WHERE e BETWEEN 0 AND 4294967295),
    node AS (SELECT c, false AS folder, shown.subject, coalesce(size, 0) AS size, coalesce(a.e, b.e, 0) AS modified FROM shown LEFT JOIN size USING (subject) LEFT
      JOIN changed ON changed.subject = shown.subject
      LEFT JOIN e a ON a.x = changed.moment LEFT JOIN e b ON b.x = shown.time UNION ALL SELECT c, true, NULL, NULL, NULL FROM folder),
    numbered AS (SELECT *, row_number() OVER (ORDER BY c) AS id FROM node)
    SELECT n.id, coalesce(p.id, 0) AS parent, n.c[len(n.c)] AS name, n.folder, n.subject, n.size, n.modified FROM numbered n LEFT
      JOIN numbered p ON p.folder AND p.c = n.c[1:len(n.c) - 1]""",
)(paths.forest)
_LAID = f""", pl AS (SELECT DISTINCT subject, attribute, json_extract_string(value, '$') AS place FROM (SELECT subject, attribute, value, CASE attribute
      WHEN 'file:path' THEN 0 WHEN 'mailbox:place' THEN 1 ELSE 2 END AS k FROM vals
      WHERE attribute IN ('file:path', 'mailbox:place', 'file:name') AND value LIKE '"%' QUALIFY k = min(k) OVER (PARTITION BY subject))),
    pathed AS (SELECT subject, c, c[1:len(c) - 1] AS dirs, CASE WHEN len(c) > 1 THEN c[1] END AS root
      FROM (SELECT subject, {_PARTS.format("regexp_replace(place, '^@', '')")} AS c FROM pl WHERE attribute = 'file:path') WHERE len(c) > 0),
    grp AS (SELECT root, min(dirs) AS low, max(dirs) AS high, count(*) AS n FROM pathed GROUP BY root),
    sh AS (SELECT root, len(list_filter(range(1, least(len(low), len(high)) + 1), lambda i: low[1:i] = high[1:i])) AS shared FROM grp),
    whole AS (SELECT len(list_filter(range(1, least(len(low), len(high)) + 1), lambda i: low[1:i] = high[1:i])) AS shared, n, groups
      FROM (SELECT min(low) AS low, max(high) AS high, sum(n) AS n, count(*) AS groups FROM grp)),
    laid AS (SELECT subject, c[CASE WHEN w.n = 1 OR w.shared > 0 OR w.groups = 1 THEN w.shared + 1 WHEN s.shared = 0 THEN 1 ELSE s.shared END:] AS t FROM pathed p
      JOIN sh s ON s.root IS NOT DISTINCT FROM p.root, whole w
      UNION ALL SELECT subject, c[len(c):] FROM (SELECT subject, {_PARTS.format('place')} AS c FROM pl WHERE attribute = 'file:name') WHERE len(c) > 0
      UNION ALL SELECT subject, list_append({_PARTS.format("split_part(place, ':', 1)")} || CASE
      WHEN contains(place, ':') THEN {_PARTS.format("place[instr(place, ':') + 1:]")} ELSE [] END, subject || '.eml') FROM pl WHERE attribute = 'mailbox:place'),
    target AS (SELECT subject, array_to_string(t, '/') AS target FROM laid)"""
_add("layout_export", _LAID + " SELECT * FROM target")(paths.layout)
_add(
    "layout_disambiguate",
    _LAID + """, n AS (SELECT subject, target, row_number() OVER (PARTITION BY target ORDER BY subject) AS n FROM (SELECT DISTINCT * FROM target)),
    free AS (SELECT target, k, row_number() OVER (PARTITION BY target ORDER BY k) AS n FROM (SELECT DISTINCT d.target, k, CASE
      WHEN regexp_matches(d.target, '(?s)^(.*[^/])(\\.[^./]*)$') THEN regexp_replace(d.target, '(?s)^(.*[^/])(\\.[^./]*)$', '\\1-' || k || '\\2')
      ELSE d.target || '-' || k END AS name FROM (SELECT target, unnest(range(2, (2 * max(n) + 1)::BIGINT)) AS k FROM n GROUP BY target HAVING max(n) > 1) d)
      WHERE name NOT IN (SELECT target FROM target))
    SELECT n.subject, n.target, CASE WHEN n.n = 1 THEN n.target
      WHEN regexp_matches(n.target, '(?s)^(.*[^/])(\\.[^./]*)$') THEN regexp_replace(n.target, '(?s)^(.*[^/])(\\.[^./]*)$', '\\1-' || f.k || '\\2')
      ELSE n.target || '-' || f.k END AS name
    FROM n LEFT JOIN free f ON f.target = n.target AND f.n = n.n - 1""",
)(lambda c: paths.disambiguate(paths.layout(c)))
_add("layout_names", _LAID.replace("target AS (SELECT subject, array_to_string(t, '/') AS target"
    " FROM laid)", "target AS (SELECT subject, t[len(t)] AS target"
    " FROM laid)") + """, n AS (SELECT subject, target, row_number() OVER (PARTITION BY lower(target) ORDER BY target, subject) AS n FROM (SELECT DISTINCT * FROM target))
    SELECT lower(target) AS wanted, count(*) AS copies FROM n GROUP BY 1""")(
    lambda c: paths.disambiguate(paths.layout(c).select("subject", F.element_at(F.split("target", "/"), -1).alias("target")), fold_case=True)
    .groupBy(F.lower("target").alias("wanted")).agg(F.count_distinct(F.lower("name")).alias("copies"))
)
_add("excluded_paths", "SELECT path, subject FROM paths WHERE regexp_matches(path, '(?s)(^|/)[^/]*\\.zip(/|$)') OR regexp_matches(path, '(?s)^/*home/(.*/)?scan[^/]*(/|$)')")(
    lambda c: paths.all_paths(c).where(paths.excluded(F.regexp_replace("path", "^/+", ""), ["*.zip", "/home/**/scan*"]))
)
_LIST = f"SELECT DISTINCT json_extract_string(value, '$') AS path FROM rec WHERE attribute = 'file:path' AND value LIKE '\"%' AND time > '{_CUT}'"
_add("gone_places", f"SELECT path, subject FROM paths WHERE starts_with(path, '/home/') AND path NOT IN ({_LIST})")(
    lambda c: paths.gone_places(c, c.where((F.col("attribute") == "file:path") & (F.col("time") > _CUT)).select(paths.path_text(F.col("value")).alias("path")), "/home")
)

# -- integrity

_add(
    "chain_check",
    """SELECT s.seq, lower(s.digest) AS digest, CASE WHEN s.previous IS NULL THEN 'first' WHEN lower(s.previous) NOT IN (SELECT lower(digest) FROM segments) THEN 'missing'
    WHEN (SELECT count(*) FROM segments o WHERE lower(o.previous) = lower(s.previous)) > 1 THEN 'forked' ELSE 'linked' END AS link FROM segments s""",
    "segments",
)(verify.chain_check)
_add(
    "segment_counts",
    "SELECT s.seq, s.n_claims AS announced, count(c.cid) AS held FROM segments s LEFT JOIN claims c ON c.seq = s.seq GROUP BY 1, 2",
    "claims", "segments",
)(verify.segment_counts)
_add("audit_missing", "SELECT digest FROM refs EXCEPT SELECT digest FROM held", "claims", "blobs")(verify.missing)
_add("audit_unrecorded", "SELECT digest FROM held EXCEPT SELECT digest FROM refs", "claims", "blobs")(verify.unrecorded)
_add("audit_twins", "SELECT lower(digest) AS digest FROM blobs WHERE removed IS NULL AND store = 'content' INTERSECT SELECT lower(digest) FROM blobs"
    " WHERE removed IS NULL AND store = 'derived'", "blobs")(verify.twins)
_add(
    "audit_undescribed",
    ", f AS (SELECT digest, digest NOT IN (SELECT subject FROM live WHERE attribute = 'file:size') AS no_size, digest NOT IN (SELECT subject FROM live"
    " WHERE attribute = 'file:mime') AS no_mime"
    " FROM (SELECT digest FROM held INTERSECT SELECT digest FROM refs)) SELECT * FROM f WHERE no_size OR no_mime",
    "claims", "blobs",
)(verify.undescribed)
_add("held_by_digest", "SELECT digest FROM held INTERSECT SELECT lower(subject) FROM documents", "blobs", "documents")(
    lambda b, d: held(b).distinct().join(d.select(F.lower("subject").alias("digest")), "digest", "left_semi")
)
_add("content_by_prefix", "SELECT lower(digest) AS digest, min(store) AS store FROM blobs WHERE removed IS NULL AND lower(digest) LIKE 'a%'"
    " GROUP BY 1", "blobs")(lambda b: verify.content_of(b, "a"))
_add("seal_cover", "SELECT DISTINCT subject AS digest FROM (SELECT lower(subject) AS subject FROM claims WHERE seq <= 1)")(lambda c: verify.seal_cover(c, 1))
_add("since_seal", "SELECT seq, count(*) AS claims, count(DISTINCT subject) AS files FROM rec WHERE seq > 1 GROUP BY 1")(lambda c: verify.since_seal(c, 1))
_add("delta_files", "SELECT DISTINCT lower(subject) AS digest FROM claims EXCEPT SELECT lower(subject) FROM claims"
    " WHERE seq <= 1")(lambda c: verify.delta(c, c.where(F.col("seq") <= 1)))
#: The line of a claim in SQL, whose texts but the value hold nothing to escape.
_LINE = """'{"subject":"' || subject || '","attribute":"' || attribute || '",' || CASE WHEN retracts IS NULL THEN '"value":' || value
      ELSE '"retracts":["' || array_to_string(retracts, '","') || '"]' END || ',"time":"' || time || '","source":"' || source || '"' || coalesce(',"run":"' || run || '"', '') || '}'"""
_add("sealed_order", f"SELECT cid, seq, row_number() OVER (PARTITION BY seq ORDER BY time, {_LINE}, cid) - 1 AS place FROM rec")(verify.sealed_order)
_add(
    "seal_segments",
    f"""SELECT r.seq, sha256('{{"segment":1' || coalesce(',"previous":"' || lower(any_value(s.previous)) || '"', '') || '}}' || chr(10) || string_agg({_LINE} || chr(10), '' ORDER BY time, {_LINE})) AS digest
    FROM rec r LEFT JOIN segments s ON s.seq = r.seq WHERE r.seq IS NOT NULL GROUP BY r.seq""",
    "claims", "segments",
)(verify.sealed_digests)


def _fixities(blobs: DataFrame, documents: DataFrame) -> DataFrame:
    """The state of each held copy: the tables hold bytes of texts only, so a copy is that of its document, and of another length than it damaged."""
    texts = documents.where(F.col("text").isNotNull() & F.col("subject").isNotNull()).groupBy(F.lower("subject").alias("digest")).agg(F.min("text").alias("text"))
    copies = blobs.where(F.col("removed").isNull()).select(F.lower("digest").alias("digest"), "store", "length").join(texts, "digest")
    cut = F.when(F.col("length") == F.octet_length("text"), F.encode("text", "utf-8")).when(F.col("length").isNotNull(), F.encode(F.concat("text", F.lit("?")), "utf-8"))
    return verify.fixity(copies.select("store", "digest", cut.alias("content")), keep=("store",)).distinct()


_FIXITIES = """, x AS (SELECT lower(subject) AS digest, min(text) AS text FROM documents WHERE text IS NOT NULL AND subject IS NOT NULL GROUP BY 1),
    fix AS (SELECT DISTINCT lower(b.digest) AS digest, store, CASE WHEN length IS NULL THEN 'unreadable' WHEN sha256(CASE WHEN length = octet_length(encode(text)) THEN text
      ELSE text || '?' END) = x.digest THEN 'sound' ELSE 'damaged' END AS fixity
      FROM blobs b JOIN x ON x.digest = lower(b.digest) WHERE removed IS NULL)"""
_add("blob_fixity", _FIXITIES + " SELECT digest, store, fixity FROM fix", "blobs", "documents")(_fixities)
_add(
    "set_aside_sources",
    _FIXITIES + """ SELECT DISTINCT f.digest, f.store = 'derived' AS derived, p.path, f.digest IN (SELECT subject FROM vals WHERE attribute = 'mailbox:place') AS mail
    FROM fix f LEFT JOIN paths p ON p.subject = f.digest WHERE f.fixity = 'damaged'""",
    "claims", "blobs", "documents",
)(lambda c, b, d: verify.set_aside(c, _fixities(b, d)))
_add(
    "weed_twins",
    _FIXITIES + """, t AS (SELECT digest, max(fixity) FILTER (WHERE store = 'content') AS c, max(fixity) FILTER (WHERE store = 'derived') AS d FROM fix GROUP BY 1)
    SELECT digest, CASE WHEN c = 'sound' AND d IN ('sound', 'damaged') THEN 'release' WHEN c = 'damaged' AND d = 'sound' THEN 'repair' ELSE 'stand' END AS verdict FROM t
      WHERE c IS NOT NULL AND d IS NOT NULL""",
    "blobs", "documents",
)(lambda b, d: verify.weed(_fixities(b, d)))
_add(
    "describe_files",
    """, f AS (SELECT digest, digest NOT IN (SELECT subject FROM live WHERE attribute = 'file:size') AS no_size, digest NOT IN (SELECT subject FROM live
      WHERE attribute = 'file:mime') AS no_mime
      FROM (SELECT digest FROM held INTERSECT SELECT digest FROM refs)), l AS (SELECT lower(digest) AS digest, max(length) AS size FROM blobs WHERE removed IS NULL GROUP BY 1)
    SELECT digest AS subject, 'file:size' AS attribute, size::VARCHAR AS value FROM f JOIN l USING (digest) WHERE no_size AND size IS NOT NULL
    UNION ALL SELECT digest, 'file:mime', '"application/octet-stream"' FROM f JOIN l USING (digest) WHERE no_mime""",
    "claims", "blobs",
)(
    lambda c, b: verify.describe(
        verify.undescribed(c, b), b.where(F.col("removed").isNull()).groupBy(F.lower("digest").alias("digest")).agg(F.max("length").alias("size")).withColumn("mime", F.lit("application/octet-stream")), "2026-12-01T00:00:00Z", "r"
    ).select("subject", "attribute", "value")
)
_add(
    "audit_findings",
    """, l AS (SELECT s.seq, lower(s.digest) AS digest, CASE WHEN s.previous IS NULL THEN 'first' WHEN lower(s.previous) NOT IN (SELECT lower(digest)
      FROM segments) THEN 'missing' WHEN (SELECT count(*) FROM segments o WHERE lower(o.previous) = lower(s.previous)) > 1 THEN 'forked' ELSE 'linked' END AS link FROM segments s)
    SELECT 'missing' AS kind, digest AS name FROM (SELECT digest FROM refs EXCEPT SELECT digest FROM held) UNION ALL SELECT 'unrecorded', digest FROM (SELECT digest FROM held
      EXCEPT SELECT digest FROM refs)
    UNION ALL SELECT 'twin', digest FROM (SELECT lower(digest) AS digest FROM blobs WHERE removed IS NULL AND store = 'content' INTERSECT SELECT lower(digest) FROM blobs
      WHERE removed IS NULL AND store = 'derived')
    UNION ALL SELECT 'undescribed', digest FROM (SELECT digest FROM held INTERSECT SELECT digest FROM refs) WHERE digest NOT IN (SELECT subject FROM live
      WHERE attribute = 'file:size') OR digest NOT IN (SELECT subject FROM live WHERE attribute = 'file:mime')
    UNION ALL SELECT CASE link WHEN 'forked' THEN 'forked' ELSE 'missing-segment' END, digest FROM l WHERE link IN ('forked', 'missing')
    UNION ALL SELECT 'miscounted', seq::VARCHAR FROM (SELECT s.seq, s.n_claims, count(c.cid) AS n FROM segments s LEFT JOIN claims c ON c.seq = s.seq GROUP BY 1, 2)
      WHERE n <> n_claims""",
    "claims", "blobs", "segments",
)(verify.findings)
_add(
    "seal_soundness",
    _FIXITIES + """, s AS (SELECT digest, bool_or(fixity = 'sound') AS sound, bool_or(fixity = 'damaged') AS bad FROM fix GROUP BY 1)
    SELECT r.digest, CASE WHEN b.store IS NULL THEN 'missing' WHEN s.sound = false THEN CASE WHEN s.bad THEN 'damaged' ELSE 'unreadable' END ELSE b.store END AS presence
    FROM (SELECT DISTINCT lower(subject) AS digest FROM claims WHERE seq <= (SELECT seq FROM segments ORDER BY digest LIMIT 1)) r LEFT
      JOIN (SELECT lower(digest) AS digest, min(store) AS store FROM blobs WHERE removed IS NULL GROUP BY 1) b USING (digest) LEFT JOIN s USING (digest)""",
    "claims", "blobs", "segments", "documents",
)(lambda c, b, s, d: verify.seal_check(c, b, s, s.agg(F.min("digest")).first()[0] or "", _fixities(b, d)))
_add("audit_since", "SELECT DISTINCT lower(digest) AS digest, store FROM blobs"
    " WHERE coalesce(stored >= TIMESTAMP '2025-01-01', true)", "blobs")(lambda b: verify.stored_since(b, "2025-01-01 00:00:00"))

# -- writing and surgery

_add(
    "retract_value",
    """, t AS (SELECT subject, string_agg(DISTINCT cid, ' ' ORDER BY cid) AS taken FROM live WHERE attribute = 'user:tag' AND value = '"review"' GROUP BY 1)
    SELECT subject, taken, sha256('{"subject":"' || subject || '","attribute":"user:tag","retracts":["' || replace(taken, ' ', '","') || '"],"time":"2026-12-01T00:00:00Z","source":"user","run":"r"}') AS cid FROM t""",
)(
    lambda c: write.retract(c, "user:tag", value_matches(F.col("value"), '"review"'), "2026-12-01T00:00:00Z", "r").select("subject", F.array_join("retracts", " ").alias("taken"), "cid")
)
_add(
    "retract_asked",
    """, a AS (SELECT DISTINCT subject FROM live WHERE attribute = 'user:tag' AND value = '"keep"'),
    t AS (SELECT l.subject, l.attribute, list_sort(list(DISTINCT cid)) AS taken FROM live l JOIN a USING (subject)
      WHERE (attribute = 'user:tag' AND value = '"keep"') OR attribute = 'user:tag' GROUP BY 1, 2) SELECT subject, attribute, array_to_string(taken, ' ') AS taken FROM t""",
)(
    lambda c: write.retract_all(
        c, finder.find(c, ["user:tag=keep"]).select("subject", F.lit("user:tag").alias("attribute"), F.explode(F.array(F.lit("keep"), F.lit(".."))).alias("pattern")), "2026-12-01T00:00:00Z", "r"
    )[0].select("subject", "attribute", F.array_join("retracts", " ").alias("taken"))
)
_add(
    "annotate",
    """, h AS (SELECT DISTINCT subject FROM live
      WHERE attribute = 'file:mime' AND value = '"application/pdf"'), f(attribute, value) AS (VALUES ('user:comment', '"seen"'), ('user:tag', '"a"'), ('user:tag', '"b"'))
    SELECT subject, attribute, value, sha256('{"subject":"' || subject || '","attribute":"' || attribute || '","value":' || value || ',"time":"2026-12-01T00:00:00Z","source":"user","run":"r"}') AS cid FROM h, f""",
)(
    lambda c: write.annotate(ask.kinds(c, ["application/pdf"]), {"user:comment": ["seen"], "user:tag": ["a", "b"]}, "2026-12-01T00:00:00Z", "r").select("subject", "attribute", "value", "cid")
)


def _listed(documents: DataFrame) -> DataFrame:
    rows = documents.where(F.col("subject").isNotNull() & F.col("source").isNotNull()).select(
        F.lower("subject").alias("subject"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), F.lit("text/plain").alias("mime"), F.lit("2026-01-01T00:00:00Z").alias("modified"), F.lit("2026-12-01T00:00:00Z").alias("time"),
    )
    return rows


_add(
    "ingest_day_one",
    """, f AS (SELECT lower(subject) AS subject, '/' || source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size,
      lower(subject) NOT IN (SELECT digest FROM held) AS fresh FROM documents WHERE subject IS NOT NULL AND source IS NOT NULL)
    SELECT subject, 'file:path' AS attribute, '"' || path || '"' AS value FROM f UNION ALL SELECT subject, 'file:name', '"' || name || '"' FROM f
    UNION ALL SELECT subject, 'prov:host', '"here"' FROM f UNION ALL SELECT subject, 'file:modified', '"2026-01-01T00:00:00Z"' FROM f
    UNION ALL SELECT subject, 'file:size', size::VARCHAR FROM f WHERE fresh UNION ALL SELECT subject, 'file:mime', '"text/plain"' FROM f WHERE fresh""",
    "documents", "blobs",
)(lambda d, b: write.ingest(write.admit(_listed(d), held(b)), "here", "r").select("subject", "attribute", "value"))
_add("admit_dedupe", "SELECT DISTINCT lower(subject) AS subject, lower(subject) NOT IN (SELECT digest FROM held) AS fresh FROM documents"
    " WHERE subject IS NOT NULL AND source IS NOT NULL", "documents", "blobs")(
    lambda d, b: write.admit(_listed(d).select("subject").distinct(), held(b))
)
_add("ingest_preview", "SELECT count(*) AS files, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents"
    " WHERE subject IS NOT NULL AND source IS NOT NULL", "documents")(
    lambda d: write.preview(_listed(d))
)
_add(
    "receipts",
    "SELECT DISTINCT subject, 'prov:examined' AS attribute, '\"extractor:new/1\"' AS value FROM live WHERE attribute = 'file:mime' AND value = '\"application/pdf\"'",
)(lambda c: write.receipts(ask.kinds(c, ["application/pdf"]), "extractor:new/1", "2026-12-01T00:00:00Z", "r").select("subject", "attribute", "value"))
_add(
    "unextract",
    """, gone AS (SELECT cid FROM rec WHERE source LIKE 'extractor:%') SELECT cid FROM rec WHERE source NOT LIKE 'extractor:%' AND NOT (retracts IS NOT NULL AND
    cid NOT IN (SELECT cid FROM (SELECT cid, unnest(retracts) AS t FROM rec WHERE retracts IS NOT NULL) WHERE t NOT IN (SELECT cid FROM gone)))""",
)(lambda c: rewrite.unextract(c).select("cid"))
_add(
    "remove_files",
    _only_from_sql() + """, doom AS (SELECT subject FROM o0), gone AS (SELECT cid FROM rec WHERE subject IN (SELECT subject FROM doom) OR (subject IN (SELECT subject
      FROM o8) AND source LIKE 'extractor:%')
      OR (attribute = 'prov:origin' AND value IN (SELECT '"' || subject || '"' FROM doom)))
    SELECT cid FROM rec WHERE cid NOT IN (SELECT cid FROM gone) AND NOT (retracts IS NOT NULL AND cid NOT IN (SELECT cid FROM (SELECT cid, unnest(retracts) AS t FROM rec
      WHERE retracts IS NOT NULL) WHERE t NOT IN (SELECT cid FROM gone)))""",
    "claims", "blobs",
)(
    lambda c, b: rewrite.remove(c, verify.missing(c, b).select(F.col("digest").alias("subject")), b.where(F.col("store") == "content").select(F.lower("digest").alias("subject"))).select("cid")
)
_RENAMED = f"""CASE WHEN attribute = 'prov:origin' AND value LIKE '"%' THEN '"' || (SELECT any_value(new) FROM names
      WHERE old = lower(json_extract_string(value, '$'))) || '"' ELSE value END"""
_add(
    "rehash_map",
    f""", names AS (SELECT digest AS old, md5(digest) || md5(digest || '1') || md5(digest || '2') || md5(digest || '3') AS new FROM (SELECT DISTINCT digest FROM held)),
    made AS (SELECT cid AS old_cid, n.new AS subject, attribute, {_RENAMED} AS value, NULL::VARCHAR[] AS retracts, time, source, run, r.subject AS was FROM rec r LEFT
      JOIN names n ON n.old = r.subject WHERE retracts IS NULL),
    ided AS (SELECT old_cid AS cid, sha256({_LINE}) AS new_cid FROM made),
    aim AS (SELECT cid, unnest(retracts) AS target, generate_subscripts(retracts, 1) AS k FROM rec WHERE retracts IS NOT NULL),
    aimed AS (SELECT a.cid, list(coalesce(i.new_cid, a.target) ORDER BY k) AS retracts FROM aim a LEFT JOIN ided i ON i.cid = a.target GROUP BY 1),
    taken AS (SELECT r.cid AS old_cid, n.new AS subject, r.attribute, NULL AS value, a.retracts, r.time, r.source, r.run FROM rec r JOIN aimed a ON a.cid = r.cid LEFT
      JOIN names n ON n.old = r.subject)
    SELECT cid, new_cid FROM ided UNION ALL SELECT old_cid, sha256({_LINE}) FROM taken""",
    "claims", "blobs",
)(
    lambda c, b: rewrite.rehash(c, held(b).distinct().select(F.col("digest").alias("old"), F.concat(*[F.md5(F.concat("digest", F.lit(k))) for k in ("", "1", "2", "3")]).alias("new")), 256).select("cid", "new_cid")
)
_add(
    "replace_files",
    """, p AS (SELECT digest AS old, reverse(digest) AS new FROM (SELECT digest FROM refs EXCEPT SELECT digest FROM held))
    SELECT p.new AS subject, attribute, value, min(time) AS time FROM live l JOIN p ON p.old = l.subject
      WHERE attribute NOT IN ('file:size', 'file:mime') AND source NOT LIKE 'extractor:%' GROUP BY 1, 2, 3""",
    "claims", "blobs",
)(lambda c, b: rewrite.replace(c, verify.missing(c, b).select(F.col("digest").alias("old"), F.reverse("digest").alias("new"))).select("subject", "attribute", "value", "time"))
_add("restate_attribute", "SELECT subject, value FROM vals WHERE attribute = 'mailbox:tag' EXCEPT SELECT subject, value FROM vals"
    " WHERE attribute = 'user:tag'")(lambda c: rewrite.restate(c, "mailbox:tag", "user:tag"))

# -- listings held against each other

_add(
    "multiset_match",
    ", l AS (SELECT value AS key, count(*) AS listed FROM rec WHERE attribute = 'mail:message-id' AND value IS NOT NULL"
    " GROUP BY 1), a AS (SELECT value AS key, count(*) AS archived FROM live WHERE attribute = 'mail:message-id' GROUP BY 1)"
    " SELECT l.key, l.listed, coalesce(a.archived, 0) AS archived, coalesce(a.archived, 0) >= l.listed AS settled FROM l LEFT JOIN a ON a.key = l.key",
)(
    lambda c: reconcile.settled(
        r.record(c).where((F.col("attribute") == "mail:message-id") & F.col("value").isNotNull()).select(F.col("value").alias("key")), r.live(c, ["mail:message-id"]).select(F.col("value").alias("key"))
    )
)
_add(
    "ledger_claim",
    """, l AS (SELECT value AS key, cid AS place, row_number() OVER (PARTITION BY value ORDER BY cid) AS n, count(*) OVER (PARTITION BY value) AS listed FROM rec
      WHERE attribute = 'user:tag' AND value IS NOT NULL),
    a AS (SELECT value AS key, count(*) AS copies FROM live WHERE attribute = 'user:tag' GROUP BY 1)
    SELECT key, place, n <= coalesce(copies, 0) AS taken, coalesce(copies, 0) >= listed AS settled FROM l LEFT JOIN a USING (key)""",
)(
    lambda c: reconcile.claimed_copies(
        r.record(c).where((F.col("attribute") == "user:tag") & F.col("value").isNotNull()).select(F.col("value").alias("key"), F.col("cid").alias("place")), r.live(c, ["user:tag"]).select(F.col("value").alias("key"))
    )
)
_add("ledger_claim_cut", None, "claims")(
    # The same listing as a server gives it that cuts keys at 128 bytes, of keys made longer than that.
    lambda c: reconcile.claimed_copies(
        r.record(c).where((F.col("attribute") == "user:tag") & F.col("value").isNotNull()).select(F.substring(F.concat(F.repeat(F.lit("k"), F.lit(120)), "value"), 1, 129).alias("key"), F.col("cid").alias("place")),
        r.live(c, ["user:tag"]).select(F.concat(F.repeat(F.lit("k"), F.lit(120)), "value").alias("key")),
    ).groupBy("taken", "settled").agg(F.count("*").alias("n"))
)
_COPY = "SELECT DISTINCT lower(subject) AS subject, value FROM standing WHERE attribute = 'mailbox:tag'"
_add(
    "tag_snapshot_diff",
    f"""SELECT subject, value, 'assert' AS change FROM (SELECT subject, value FROM vals WHERE attribute = 'user:tag' EXCEPT {_COPY.replace('mailbox:tag', 'user:tag')})
    UNION ALL SELECT subject, value, 'retract' FROM ({_COPY.replace('mailbox:tag', 'user:tag')} EXCEPT SELECT subject, value FROM vals WHERE attribute = 'user:tag')""",
    "claims", "standing",
)(
    lambda c, s: reconcile.snapshot_changes(s.where(F.col("attribute") == "user:tag").select(F.lower("subject").alias("subject"), "value"), r.live_values(c, ["user:tag"]), ["subject", "value"])
)
_add(
    "label_removed",
    "SELECT subject FROM vals WHERE attribute = 'mailbox:tag' INTERSECT SELECT subject FROM vals WHERE attribute = 'mailbox:place' EXCEPT SELECT subject FROM vals"
    " WHERE attribute = 'mailbox:place' AND value LIKE '\"%Inbox\"'",
)(
    lambda c: reconcile.label_removed(
        ask.values(c, "mailbox:tag").select("subject").distinct(), ask.values(c, "mailbox:place").select("subject"), ask.values(c, "mailbox:place").where(F.col("value").endswith('Inbox"')).select("subject")
    )
)
_add(
    "receivers",
    """, c AS (SELECT m.value AS id, m.subject, m.subject IN (SELECT subject FROM roots) AS placed, m.subject IN (SELECT subject FROM vals
      WHERE attribute = 'user:tag') AS has FROM vals m WHERE attribute = 'mail:message-id'),
    n AS (SELECT id, bool_or(placed) AS any FROM c GROUP BY 1) SELECT id, subject FROM c JOIN n USING (id) WHERE NOT has AND (placed OR NOT n.any)""",
)(
    lambda c: reconcile.receivers(
        ask.values(c, "mail:message-id").withColumnRenamed("value", "id").join(lineage.roots(c).withColumn("placed", F.lit(True)), "subject", "left")
        .join(ask.values(c, "user:tag").select("subject").distinct().withColumn("has", F.lit(True)), "subject", "left")
        .select("id", "subject", F.coalesce("placed", F.lit(False)).alias("placed"), F.coalesce("has", F.lit(False)).alias("has"))
    )
)
_add(
    "resume_frontier",
    ", b AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)"
    " SELECT e.user_id, max(e.event_id) AS resume FROM events e JOIN b USING (user_id) WHERE b.bad IS NULL OR e.event_id < b.bad GROUP BY 1",
    "events",
)(lambda e: reconcile.frontier(e.withColumn("ok", F.col("event_type") != "error"), "user_id", "event_id", "ok"))
_add(
    "pending_attempts",
    "SELECT user_id, event_type, count(*) AS tries, count(*) >= 3 AS given_up FROM events GROUP BY 1, 2 HAVING NOT bool_or(value > 60)",
    "events",
)(lambda e: reconcile.pending(e.withColumn("ok", F.col("value") > 60), ["user_id", "event_type"]))
_add(
    "fetch_stops",
    """SELECT user_id, min(event_id) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY user_id, good ORDER BY event_id) AS n
      FROM (SELECT *, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS good FROM events)
      WHERE event_type <> 'click') WHERE n = 10 GROUP BY 1""",
    "events",
)(lambda e: reconcile.stopped(e.withColumn("ok", F.col("event_type") == "click"), ["user_id"], "event_id", "ok"))

# -- grammar and scalar functions

_HEX = "regexp_matches(lower(subject), '^([0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$')"
_add("grammar_subject", f"SELECT {_HEX} AS good, count(*) AS n FROM claims"
    f" GROUP BY 1")(lambda c: c.groupBy(grammar.valid_subject(F.col("subject")).alias("good")).agg(F.count("*").alias("n")))
_add("grammar_attribute", "SELECT attribute, regexp_matches(attribute, '^[a-z0-9-]+:[a-z0-9-]+$') AS good, split_part(attribute, ':', 1) AS namespace, count(*) AS n"
    " FROM claims GROUP BY 1, 2, 3")(
    lambda c: c.groupBy("attribute", grammar.valid_attribute(F.col("attribute")).alias("good"), grammar.namespace(F.col("attribute")).alias("namespace")).agg(F.count("*").alias("n"))
)
_add(
    "grammar_source_run",
    "SELECT source, regexp_matches(source, '^[^\\s[:cntrl:]]+$') AS good, count(*) FILTER (WHERE regexp_matches(run, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')) AS runs"
    " FROM claims GROUP BY 1, 2",
)(lambda c: c.groupBy("source", grammar.valid_source(F.col("source")).alias("good")).agg(F.count(F.when(grammar.valid_run(F.col("run")), 1)).alias("runs")))
_add(
    "grammar_timestamp",
    "SELECT lower(cid) AS cid, max(time) AS time FROM claims"
    " WHERE NOT (regexp_matches(time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)Z$') AND try_cast(time[1:10] AS DATE) IS NOT NULL) GROUP BY 1",
)(lambda c: c.where(~grammar.valid_time(F.col("time"))).groupBy(F.lower("cid").alias("cid")).agg(F.max("time").alias("time")))
_add(
    "json_functions",
    "SELECT attribute, CASE left(ltrim(value), 1) WHEN '\"' THEN 'string' WHEN '{' THEN 'object' WHEN '[' THEN 'array' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean'"
    " WHEN 'n' THEN 'null' ELSE 'number' END AS kind,"
    " count(*) AS n FROM claims WHERE value IS NOT NULL GROUP BY 1, 2",
)(lambda c: c.where(F.col("value").isNotNull()).groupBy("attribute", grammar.json_type(F.col("value")).alias("kind")).agg(F.count("*").alias("n")))
_add("canonical_values", None)(lambda c: r.live_values(c, ["geo:position"]).select("subject", grammar.canonical("value").alias("value")).distinct())
_add(
    "claims_ids",
    """SELECT cid, sha256('{"subject":"' || subject || '","attribute":"' || attribute || '","value":' || value || ',"time":"' || time || '","source":"' || source || '"' || coalesce(',"run":"' || run || '"', '') || '}') AS id FROM live""",
)(lambda c: r.live(c).withColumn("retracts", F.lit(None).cast("array<string>")).select("cid", grammar.claim_id().alias("id")))
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_add("blank_text", f"SELECT doc_id, regexp_matches(text, '^{_WHITE}*$') AS blank FROM documents WHERE text IS NOT NULL", "documents")(
    lambda d: d.where(F.col("text").isNotNull()).select("doc_id", names.blank(F.col("text")).alias("blank"))
)
_add("line_breaks", "SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL", "documents")(
    lambda d: d.where(F.col("text").isNotNull()).select("doc_id", F.md5(names.line_breaks(F.col("text"))).alias("digest"))
)
_JUNK = r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}\x{fffd}\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}" + "".join(rf"\x{{{p:x}fffe}}\x{{{p:x}ffff}}" for p in range(1, 17)) + "]"
_add(
    "junk_ratio",
    f"SELECT doc_id, CASE WHEN length(ink) > 0 THEN ((length(ink) - length(regexp_replace(ink, '{_JUNK}', '', 'g'))) * 100 + length(ink) // 2) // length(ink) END::INTEGER AS percent"
    f" FROM (SELECT doc_id, regexp_replace(text, '{_WHITE}', '', 'g') AS ink FROM documents)",
    "documents",
)(lambda d: d.select("doc_id", names.junk_percent(F.col("text")).alias("percent")))
_SIZED = " ".join(f"WHEN length < 10 * pow(1024, {p}) THEN printf('%.1f {u}', length / pow(1024, {p}))" + (f""
    f" WHEN length < pow(1024, {p + 1}) THEN printf('%.0f {u}', length / pow(1024, {p}))" if u != "PiB" else f""
    f" ELSE printf('%.0f {u}', length / pow(1024, {p}))") for p, u in enumerate(names.UNITS, 1))
_WHOLE = " ".join(f"WHEN length > 0 AND length % {1024**p} = 0 THEN (length // {1024**p}) || ' {u}'" for p, u in reversed(list(enumerate(names.UNITS[:4], 1))))
_add(
    "byte_counts",
    f"SELECT DISTINCT length AS size, CASE WHEN length < 1024 THEN length || ' B' {_SIZED} END AS shown, CASE {_WHOLE} ELSE length || ' bytes' END AS bound"
    f" FROM (SELECT length FROM blobs UNION ALL SELECT length * 1048576 FROM blobs UNION ALL SELECT length * 1000000007 FROM blobs) WHERE length IS NOT NULL",
    "blobs",
)(
    lambda b: b.where(F.col("length").isNotNull()).select(F.explode(F.transform(F.array(F.lit(1), F.lit(1048576), F.lit(1000000007)), lambda x: F.col("length").cast("bigint") * x)).alias("size")).distinct()
    .select("size", names.byte_count(F.col("size")).alias("shown"), names.whole_byte_count(F.col("size")).alias("bound"))
)
_add("path_components", "SELECT path, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.', '..')), '|') AS components"
    " FROM (SELECT DISTINCT path FROM paths)")(
    lambda c: paths.all_paths(c).select("path").distinct().select("path", F.array_join(paths.components(F.col("path")), "|").alias("components"))
)
_PLACES = "SELECT DISTINCT json_extract_string(value, '$') AS place FROM live WHERE attribute = 'mailbox:place' AND value LIKE '\"%'"
_add("place_parts", f"SELECT place, split_part(place, ':', 1) AS account, CASE WHEN contains(place, ':') THEN place[instr(place, ':') + 1:] END AS folder FROM ({_PLACES})")(
    lambda c: ask.values(c, "mailbox:place").where(F.col("value").startswith('"')).select(paths.path_text(F.col("value")).alias("place")).distinct()
    .select("place", names.account_of(F.col("place")).alias("account"), names.folder_of(F.col("place")).alias("folder"))
)
_add(
    "kebab_names",
    "SELECT DISTINCT source, lower(regexp_replace(regexp_replace(source, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g')) AS name FROM claims",
)(lambda c: c.select("source").distinct().select("source", names.kebab(F.col("source")).alias("name")))
_add(
    "compare_keys",
    "SELECT DISTINCT json_extract_string(value, '$') AS id, lower(regexp_replace(regexp_replace(json_extract_string(value, '$'), '^\\s*<|>\\s*$', '', 'g'), '\\s', '', 'g')) AS key"
    " FROM live WHERE attribute = 'mail:message-id' AND value LIKE '\"%'",
)(lambda c: ask.values(c, "mail:message-id").where(F.col("value").startswith('"')).select(paths.path_text(F.col("value")).alias("id")).distinct().select("id", names.compare_key(F.col("id")).alias("key")))
_add(
    "unix_round_trip",
    "SELECT DISTINCT time, epoch(time::TIMESTAMP)::BIGINT AS seconds, time AS back FROM claims"
    " WHERE regexp_matches(time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-5][0-9]Z$') AND try_cast(time AS TIMESTAMP) IS NOT NULL",
)(
    lambda c: c.where(grammar.valid_time(F.col("time")) & ~F.col("time").endswith(":60Z")).select("time").distinct().withColumn("seconds", names.epoch(F.col("time"))).withColumn("back", spelled(F.col("seconds")))
)
_add("mail_addresses", f"SELECT DISTINCT subject, '<' || lower({_TEXT}) || '>' AS address FROM vals"
    f" WHERE attribute = 'mail:from' AND value LIKE '\"%' AND regexp_matches({_TEXT}, '^[^\\s@<>()\",;:]+@[^\\s@<>()\",;:]+$')")(lambda c: mail.standing_addresses(ask.values(c, "mail:from")))


@_add("stream_fold_equals_batch", "SELECT subject, attribute, value FROM vals")
def _folded(claims: DataFrame) -> DataFrame:
    """The standing set out of a stream of bundles, the segments in two, the later first, with a query run for each."""
    spark, folder = claims.sparkSession, work_folder(claims.sparkSession, "stream")
    half = claims.agg(F.floor(F.avg("seq"))).first()[0] or 0
    for part in (claims.where(F.col("seq") > half), claims.where(F.coalesce(F.col("seq") <= half, F.lit(True)))):
        part.write.mode("append").parquet(f"{folder}/landing")
        intake.follow(spark, f"{folder}/landing", claims.schema, f"{folder}/into", f"{folder}/state").awaitTermination()
    return intake.standing_now(spark, f"{folder}/into").select("subject", "attribute", "value").distinct()


@_add("change_table_in_any_order", "SELECT subject, attribute, value FROM vals")
def _merged(claims: DataFrame) -> DataFrame:
    """The standing set out of a change table that segments were appended to one after the other, last first."""
    fold = ChangeTable(claims.sparkSession, work_folder(claims.sparkSession, "fold"), ["subject", "attribute", "claim"])
    half = claims.agg(F.floor(F.avg("seq"))).first()[0] or 0
    for part in (claims.where(F.col("seq") > half), claims.where(F.coalesce(F.col("seq") <= half, F.lit(True)))):
        fold.append_feed(feed_of(part, None, {"value": F.col("value")}))
    return fold.read().select("subject", "attribute", "value").distinct()
