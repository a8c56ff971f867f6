"""The general training-data queries, p1 to p6, and SQL for those that SQL can state."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimwright.operators import changes, history, instants, nearby, orphans, wide
from claimwright.plans.tables import table


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, n) for n in names))


QUERIES = {
    "p1_found": _over(wide.found, "claims"),
    "p2_found": _over(changes.found, "claims", "standing"),
    "p3_found": _over(orphans.found, "claims", "blobs", "standing"),
    "p3_report": _over(orphans.report, "claims", "blobs", "standing"),
    "p4_found": _over(history.found, "claims"),
    "p5_found": _over(instants.found, "vault_logs", "accounts", "claims"),
    "p6_found": _over(nearby.found, "claims"),
}

#: The instant of a claim's time, as far as claims spell it: (cid, instant) and the claims with it.
_INSTANTS = r"""WITH parsed AS (SELECT *, regexp_extract(time, '^([0-9]{4})-?([0-9]{2})-?([0-9]{2})[Tt ]([0-9]{2}):?([0-9]{2}):?([0-5][0-9])(?:\.[0-9]+)?(Z|z|[+-][0-9]{2}:?[0-9]{2})$',
    ['y', 'mo', 'd', 'h', 'mi', 's', 'z']) AS g, ROW_NUMBER() OVER () AS rid FROM {table}),
{name} AS (SELECT * EXCLUDE (g, rid), strftime(
    try_cast(g.y || '-' || g.mo || '-' || g.d || ' ' || g.h || ':' || g.mi || ':' || g.s AS TIMESTAMP)
    - CASE WHEN lower(g.z) = 'z' THEN INTERVAL 0 MINUTE ELSE to_minutes(CAST((CASE WHEN g.z[1] = '-' THEN -1 ELSE 1 END)
      * (try_cast(g.z[2:3] AS INTEGER) * 60 + try_cast(right(g.z, 2) AS INTEGER)) AS BIGINT)) END, '%Y-%m-%dT%H:%M:%SZ') AS instant FROM parsed)"""
_CLAIMS = _INSTANTS.replace("{table}", "claims").replace("{name}", "c")
_STANDING = """, made AS (SELECT DISTINCT lower(subject) AS subject, attribute, value, instant, lower(cid) AS cid FROM c WHERE retracts IS NULL),
taken AS (SELECT lower(subject) AS subject, attribute, lower(unnest(retracts)) AS cid, instant FROM c WHERE retracts IS NOT NULL),
live AS (SELECT * FROM made m WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.cid = m.cid AND t.subject = m.subject AND t.attribute = m.attribute))"""


def _cell(attribute: str, readable: str, shown: str, default: str) -> str:
    name = attribute.partition(":")[2]
    return f"coalesce(arg_max({shown}, (coalesce(instant, ''), cid)) FILTER (WHERE attribute = '{attribute}' AND {readable}), {default}) AS {name}"


_WHOLE = r"""CASE WHEN regexp_matches(value, '^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$') AND try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE)) THEN try_cast(try_cast(value AS DOUBLE) AS BIGINT)
    ELSE try_cast(nullif(regexp_extract(value, '^\s*" *([0-9]+) *"\s*$', 1), '') AS BIGINT) END"""
_TRUTH = r"""lower(nullif(regexp_extract(value, '^\s*(true|false|"(?i:true|false)")\s*$', 1), ''))"""
_COLOR = r"""lower(nullif(regexp_extract(value, '^\s*" *((?i:gray|rgb|cmyk|indexed)) *"\s*$', 1), ''))"""

SQL = {
    "p1_found": _CLAIMS + _STANDING + " SELECT subject, " + ", ".join(
        [_cell(f"raster:{n}", f"{_WHOLE} IS NOT NULL", _WHOLE, "-1") for n in ("width", "height", "depth")]
        + [_cell("raster:alpha", f"{_TRUTH} IS NOT NULL", f"replace({_TRUTH}, '\"', '')", "''"), _cell("raster:color", f"{_COLOR} IS NOT NULL", _COLOR, "''")]
    ) + " FROM live WHERE attribute IN ('raster:width', 'raster:height', 'raster:depth', 'raster:alpha', 'raster:color') GROUP BY subject",
    "p2_found": _CLAIMS + _STANDING + """, want AS (SELECT DISTINCT cid FROM live WHERE attribute IN ('file:path', 'mailbox:place', 'mailbox:tag', 'user:tag')),
have AS (SELECT DISTINCT lower(claim) AS cid FROM standing WHERE claim IS NOT NULL)
SELECT cid AS claim, 'add' AS change FROM (SELECT cid FROM want EXCEPT SELECT cid FROM have) UNION ALL SELECT cid, 'drop' FROM (SELECT cid FROM have EXCEPT SELECT cid FROM want)""",
    "p3_found": _CLAIMS + """, sparsed AS (SELECT lower(claim) AS claim, asserted[1:7] AS period FROM standing WHERE regexp_matches(asserted, '^....-..-..T..:..:..Z$') AND try_cast(asserted[1:10] AS DATE) IS NOT NULL),
held AS (SELECT lower(digest) AS k FROM blobs WHERE removed IS NULL), ids AS (SELECT lower(cid) AS k FROM claims),
refs AS (SELECT 'claims.subject' AS field, instant[1:7] AS period, lower(subject) AS target FROM c
  UNION ALL SELECT 'claims.value', instant[1:7], lower(json_extract_string(value, '$')) FROM c WHERE attribute = 'prov:origin' AND regexp_matches(value, '^\\s*"[0-9a-fA-F]{64}"\\s*$')
  UNION ALL SELECT 'claims.retracts', instant[1:7], lower(unnest(retracts)) FROM c WHERE retracts IS NOT NULL UNION ALL SELECT 'standing.claim', period, claim FROM sparsed)
SELECT DISTINCT field, period, target FROM refs WHERE period IS NOT NULL AND target IS NOT NULL
  AND ((field IN ('claims.subject', 'claims.value') AND target NOT IN (SELECT k FROM held)) OR (field IN ('claims.retracts', 'standing.claim') AND target NOT IN (SELECT k FROM ids)))""".replace("\\\\", "\\"),
    "p4_found": _CLAIMS + _STANDING + """, life AS (SELECT m.subject, m.attribute, m.value, m.instant AS a, coalesce(min(t.instant), '~') AS b FROM made m
  LEFT JOIN taken t ON t.cid = m.cid AND t.subject = m.subject AND t.attribute = m.attribute
  WHERE m.attribute IN ('mailbox:place', 'user:tag') AND m.instant IS NOT NULL AND m.value IS NOT NULL GROUP BY m.subject, m.attribute, m.value, m.cid, m.instant HAVING coalesce(min(t.instant), '~') > m.instant),
edge AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY subject, attribute, value ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM life),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, attribute, value ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM edge)
SELECT subject, attribute, value, min(a) AS valid_from, replace(max(b), '~', 'open') AS valid_to FROM isle GROUP BY subject, attribute, value, n""",
    "p6_found": """WITH p AS (SELECT DISTINCT lower(subject) AS s, json_extract_string(value, '$.latitude') AS la, json_extract_string(value, '$.longitude') AS lo,
  json_type(value, '$.latitude') AS ta, json_type(value, '$.longitude') AS tb FROM claims WHERE attribute = 'geo:position' AND retracts IS NULL AND json_valid(value)),
q AS (SELECT DISTINCT s, try_cast(la AS DOUBLE) AS lat, try_cast(lo AS DOUBLE) AS lon FROM p
  WHERE (ta IN ('DOUBLE', 'BIGINT', 'UBIGINT') OR (ta = 'VARCHAR' AND regexp_matches(la, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$')))
    AND (tb IN ('DOUBLE', 'BIGINT', 'UBIGINT') OR (tb = 'VARCHAR' AND regexp_matches(lo, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$')))),
g AS (SELECT *, CAST(floor(lat / 0.01) AS BIGINT) AS cell FROM q WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
n AS (SELECT s, lat, lon, cell + unnest([-1, 0, 1]) AS cell FROM g)
SELECT DISTINCT a.s AS subject_a, b.s AS subject_b FROM g a JOIN n b ON a.cell = b.cell AND a.s < b.s WHERE
  2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 150""",
}
SQL["p3_report"] = SQL["p3_found"].replace("SELECT DISTINCT field, period, target FROM refs", "SELECT field, period, count(DISTINCT target) AS targets, count(*) AS refs FROM refs") + " GROUP BY 1, 2"

#: The spellings of dates in DuckDB's regular expressions, one a form, over lower-case text without comments.
_CLOCK = r"(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,][0-9]+)?)?(?:\s*(?P<half>[ap]m))?"
_ZONE, _DAY = r"(?:\s*(?P<z>[+-][0-9]{2}(?::?[0-9]{2})?|[a-z]+))?", r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_MONTH = r"(?P<mo>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_FORMS = {
    "a": rf"(?P<y>[0-9]{{4}})-(?P<mo>[0-9]{{2}})-(?P<d>[0-9]{{2}})(?:t|\s+){_CLOCK}{_ZONE}",
    "b": rf"(?P<y>[0-9]{{4}})(?P<mo>[0-9]{{2}})(?P<d>[0-9]{{2}})t(?P<h>[0-9]{{2}})(?P<mi>[0-9]{{2}})(?:(?P<s>[0-9]{{2}})(?:[.,][0-9]+)?)?(?P<half>x?x?)?{_ZONE}",
    "c": rf"{_DAY}(?P<d>[0-9]{{1,2}})(?:\s+|-){_MONTH}\.?(?:,?\s+|-)(?P<y>[0-9]{{4}}|[0-9]{{2}}),?\s+{_CLOCK}{_ZONE}",
    "d": rf"{_DAY}{_MONTH}\.?\s+(?P<d>[0-9]{{1,2}})\s+{_CLOCK}(?:\s+(?P<z>[+-][0-9]{{2}}(?::?[0-9]{{2}})?|[a-z]+))?\s+(?P<y>[0-9]{{4}})",
    "e": rf"{_DAY}{_MONTH}\.?\s+(?P<d>[0-9]{{1,2}}),?\s+(?P<y>[0-9]{{4}}),?\s+{_CLOCK}{_ZONE}",
    "f": rf"(?P<d>[0-9]{{1,2}})[./-](?P<mo>[0-9]{{1,2}})[./-](?P<y>[0-9]{{4}}|[0-9]{{2}}),?\s+{_CLOCK}{_ZONE}",
}


def _form(tag: str, pattern: str) -> str:
    """SQL: the fields of the texts of one form, groups taken in the order they stand."""
    names = re.findall(r"\(\?P<([a-z]+)>", pattern)
    plain = re.sub(r"\(\?P<[a-z]+>", "(", pattern)
    field = lambda n: f"g.{n}" if n in names else "''"
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    month, day = (f"CASE ord WHEN 'dmy' THEN {field(a)} WHEN 'mdy' THEN {field(b)} END" if tag == "f" else field(a) for a, b in (("mo", "d"), ("d", "mo")))
    return f"SELECT rid, {field('y')} AS y, {month} AS mo, {day} AS d, {field('h')} AS h, {field('mi')} AS mi, {field('s')} AS s, {field('half')} AS half, {field('z')} AS z FROM (SELECT rid, ord, regexp_extract(x, '^(?:{plain})$', {listed}) AS g FROM t WHERE regexp_matches(x, '^(?:{plain})$'))"


_BARE = "date"
for _ in range(6):
    _BARE = f"regexp_replace({_BARE}, '\\([^()]*\\)', ' ', 'g')"
SQL["p5_found"] = rf"""WITH zones AS (SELECT mailbox, min(zone) AS zone, CASE WHEN min(date_order) = max(date_order) THEN min(date_order) END AS ord FROM accounts WHERE mailbox IS NOT NULL AND zone IN (SELECT name FROM pg_timezone_names()) GROUP BY mailbox HAVING min(zone) = max(zone)),
src AS (SELECT DISTINCT 'vault_logs' AS place, log_id::VARCHAR AS row_key, date, zone, ord FROM vault_logs LEFT JOIN zones USING (mailbox) WHERE log_id IS NOT NULL AND date IS NOT NULL
  UNION SELECT 'claims', lower(cid), time, NULL, NULL FROM claims WHERE cid IS NOT NULL AND NOT regexp_matches(time, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$')),
t AS (SELECT *, row_number() OVER () AS rid, lower(regexp_replace({_BARE}, '^\s+|\s+$', '', 'g')) AS x FROM src),
f AS ({" UNION ALL ".join(_form(k, p) for k, p in _FORMS.items())}),
n AS (SELECT rid, CASE WHEN length(y) = 2 THEN 2000 + y::INT ELSE y::INT END AS y, CASE WHEN regexp_matches(mo, '^[0-9]') THEN try_cast(mo AS INT) ELSE (instr('jan feb mar apr may jun jul aug sep oct nov dec', mo[1:3]) + 3) // 4 END AS mo, try_cast(d AS INT) AS d,
  CASE WHEN half = '' THEN CASE WHEN h::INT <= 23 THEN h::INT END WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END AS h, mi::INT AS mi, CASE WHEN s = '' THEN 0 ELSE s::INT END AS s, z,
  CASE WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN z[2:3]::INT <= 23 AND coalesce(try_cast(nullif(right(replace(z[4:], ':', ''), 2), '') AS INT), 0) <= 59 THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (z[2:3]::INT * 60 + coalesce(try_cast(nullif(right(replace(z[4:], ':', ''), 2), '') AS INT), 0)) END
    ELSE CASE z WHEN 'z' THEN 0 WHEN 'gmt' THEN 0 WHEN 'ut' THEN 0 WHEN 'utc' THEN 0 WHEN 'est' THEN -300 WHEN 'edt' THEN -240 WHEN 'cst' THEN -360 WHEN 'cdt' THEN -300 WHEN 'mst' THEN -420 WHEN 'mdt' THEN -360 WHEN 'pst' THEN -480 WHEN 'pdt' THEN -420 WHEN 'cet' THEN 60 WHEN 'cest' THEN 120 END END AS off FROM f),
w AS (SELECT rid, z, off, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) AS TIMESTAMP) AS wall FROM n WHERE y >= 1 AND mo BETWEEN 1 AND 12 AND d >= 1 AND h IS NOT NULL AND mi <= 59 AND s <= 59),
u AS (SELECT w.rid, CASE WHEN z <> '' THEN wall - to_minutes(off) WHEN zone IS NOT NULL AND ((wall AT TIME ZONE zone) AT TIME ZONE zone) = wall
    AND len(list_filter(range(-12, 13), lambda k: k <> 0 AND (((wall AT TIME ZONE zone) + to_minutes(15 * k)) AT TIME ZONE zone) = wall)) = 0 THEN (wall AT TIME ZONE zone) AT TIME ZONE 'UTC' END AS utc FROM w JOIN t USING (rid)
  UNION ALL SELECT rid, make_timestamp((CASE length(x) WHEN 10 THEN try_cast(x AS BIGINT) ELSE try_cast(x AS BIGINT) // 1000 END * 1000000)::BIGINT) FROM t WHERE regexp_matches(x, '^([0-9]{{10}}|[0-9]{{13}})$'))
SELECT DISTINCT place, row_key, strftime(utc, '%Y-%m-%dT%H:%M:%SZ') AS instant FROM u JOIN t USING (rid) WHERE utc IS NOT NULL"""
