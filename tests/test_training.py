"""The general training-data operators on small inputs with every dirt that they define a result for."""

from __future__ import annotations

import datetime as dt
import math
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from claimwright.operators import changes, history, instants, nearby, orphans, wide
from claimwright.plans import skew

T = "2024-03-0{}T00:00:00Z".format


# -- p1


def test_wide_takes_the_readable_standing_value_of_the_greatest_instant(claims, rows):
    df = claims(
        ("A", "raster:width", "640", T(1), "c1"),
        ("a", "raster:width", '" 800 "', "2024-03-02T02:00:00+02:00", "C2"),
        ("a", "raster:width", '"900 px"', T(3), "c3"),
        ("a", "raster:height", "0.48e3", T(1), "c4"),
        ("a", "raster:height", "480.5", T(2), "c5"),
        ("a", "raster:depth", "[8]", T(1), "c6"),
        ("a", "raster:alpha", '"TRUE"', T(1), "c7"),
        ("a", "raster:color", '" Gray"', T(1), "c8"),
        ("b", "raster:color", '"YCbCr"', T(1), "c9"),
        ("c", "raster:color", '"rgb"', T(1), "c10"),
        ("c", "raster:color", ["C10"], T(2), "r1"),
        ("d", "file:size", "1", T(1), "c11"),
        (None, "raster:width", "1", T(1), "c12"),
        ("e", "raster:width", None, None, "c13"),
    )
    assert rows(wide.found(df)) == [("a", 800, 480, -1, "true", "gray"), ("b", -1, -1, -1, "", ""), ("e", -1, -1, -1, "", "")]


def test_wide_breaks_ties_by_id_and_ignores_repeats(claims, rows):
    df = claims(("a", "raster:depth", "8", T(1), "c1"), ("a", "raster:depth", "16", T(1), "c2"), ("a", "raster:depth", "8", T(1), "c1"))
    assert rows(wide.found(df)) == [("a", -1, -1, 16, "", "")]


def test_wide_ordinals_are_global_and_dense(spark, rows):
    cells = spark.range(500).select(F.concat(F.lit("e"), F.col("id") % 97).alias("entity"), F.lit("raster:width").alias("attribute"), F.col("id").cast("string").alias("value"), F.col("id").alias("text"))
    out = wide.widen(cells, wide.RASTER, ["text"], ranges=7).collect()
    assert sorted(r.ordinal for r in out) == list(range(97))
    assert {r.entity: r.width for r in out} == {f"e{i % 97}": i for i in range(500)}


def test_wide_of_nothing(claims):
    df = claims(("a", "file:size", "1", T(1), "c"))
    assert wide.found(df).count() == 0 and wide.found(df.limit(0)).columns == ["subject", "width", "height", "depth", "alpha", "color"]


# -- p2


def test_standing_is_independent_of_order_and_needs_subject_and_attribute(claims, rows):
    df = claims(
        ("a", "user:tag", ["X1", "x2"], T(1), "r1"),
        ("a", "user:tag", '"late"', T(9), "x1"),
        ("b", "user:tag", '"other subject"', T(1), "x2"),
        ("a", "file:path", '"/p"', T(1), "x3"),
        ("a", "user:tag", ["x3", "r1", "none"], T(2), "r2"),
        ("a", "user:tag", '"late"', T(9), "X1"),
        ("a", "user:tag", '"keep"', T(1), "x4"),
    )
    assert sorted(r.claim for r in changes.standing_claims(df).collect()) == ["x2", "x3", "x4"]


def test_changes_between_copy_and_record(spark, claims, rows):
    df = claims(("a", "user:tag", "1", T(1), "c1"), ("a", "file:size", "1", T(1), "c2"), ("a", "user:tag", "2", T(1), "c3"))
    copy = spark.createDataFrame([("C1",), ("c1",), ("c2",), ("zz",), (None,)], "claim string")
    assert rows(changes.found(df, copy)) == [("c2", "drop"), ("c3", "add"), ("zz", "drop")]
    assert rows(changes.found(df.limit(0), copy.limit(0))) == []


def test_later_deletes_only_take_back_earlier_rows(spark, rows):
    data = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2), (None, "n", 1), (3, "x", 5), (3, "y", 5)], "id int, row string, seq long")
    deletes = spark.createDataFrame([(1, 2), (2, 2), (2, 3), (9, 9), (None, 9)], "id int, seq long")
    assert rows(changes.apply_changes(data, deletes, ["id"], which="later").select("id", "row")) == [(1, "b"), (3, "y")]
    assert rows(changes.apply_changes(data, deletes, ["id"], which="any").select("id", "row")) == [(3, "y")]


def test_change_table_round_trip(spark, tmp_path, rows):
    t = changes.ChangeTable(spark, str(tmp_path / "t"), ["id"])
    batch = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    t.append(1, batch((1, "a"), (2, "b")))
    assert rows(t.read().select("id", "v")) == [(1, "a"), (2, "b")]
    t.append(2, batch((1, "new")), batch((1, ""), (2, "")))
    t.append(2, batch((1, "new")))
    assert rows(t.read().select("id", "v")) == [(1, "new")]
    assert rows(t.compact(str(tmp_path / "u")).read().select("id", "v", "seq")) == [(1, "new", 0)]


def test_changes_against_a_replay(spark, rows):
    r = random.Random(5)
    feed = [(r.choice("ab"), r.choice("xy"), f"c{r.randrange(30)}", r.random() < 0.4) for _ in range(400)]
    data = spark.createDataFrame([(s, a, c, i) for i, (s, a, c, d) in enumerate(feed) if not d], "s string, a string, c string, seq long")
    gone = spark.createDataFrame([(s, a, c, i) for i, (s, a, c, d) in enumerate(feed) if d], "s string, a string, c string, seq long")
    want = {x[:3] for x in feed if not x[3]} - {x[:3] for x in feed if x[3]}
    assert {tuple(x) for x in changes.apply_changes(data, gone, ["s", "a", "c"], which="any").select("s", "a", "c").collect()} == want
    state = {}
    for s, a, c, d in feed:
        state.pop((s, a, c), None) if d else state.__setitem__((s, a, c), 1)
    assert {tuple(x) for x in changes.apply_changes(data, gone, ["s", "a", "c"], which="later").select("s", "a", "c").collect()} == set(state)


def test_hot_claim_meets_its_delete_in_one_row_a_task(claims, rows):
    df = claims(*[("a", "user:tag", '"x"', T(1), "hot")] * 400, ("a", "user:tag", ["HOT"] * 300, T(1), "r"), ("a", "user:tag", '"y"', T(1), "c"))
    table = changes.standing_table(df)
    assert rows(table.read().select("claim", "seq")) == [("c", 100)]
    kinds = df.sparkSession.read.parquet(table.path).groupBy("op").count()
    assert rows(kinds) == [("data", 401), ("deletes", 300)]
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "_seq" in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2


# -- p3


def test_orphans(spark, claims, rows):
    h, g = "a" * 64, "b" * 64
    df = claims(
        (h, "file:size", "1", T(1), "c1"),
        (g.upper(), "file:size", "1", "2024-05-31T23:00:00-02:00", "c2"),
        (g, "file:size", "1", "2024-06-02T00:00:00Z", "c3"),
        (h, "prov:origin", f'"{g.upper()}"', T(1), "c4"),
        (h, "prov:origin", '"unknown"', T(1), "c5"),
        (h, "prov:origin", g, T(1), "c6"),
        (h, "user:tag", ["C1", "Q", None], T(1), "r1"),
        (g, "user:tag", "1", "no time", "c7"),
        (None, "user:tag", "1", T(1), "c8"),
    )
    moment = dt.datetime(2024, 1, 1)
    blobs = spark.createDataFrame([(h.upper(), None), (g, moment), (None, None)], "digest string, removed timestamp_ntz")
    copy = spark.createDataFrame([("C1", T(1)), ("gone", T(2)), ("gone", T(2)), (None, T(1)), ("x", None)], "claim string, asserted string")
    assert rows(orphans.found(df, blobs, copy)) == [
        ("claims.retracts", "2024-03", "q"), ("claims.subject", "2024-06", g), ("claims.value", "2024-03", g), ("standing.claim", "2024-03", "gone"),
    ]
    assert rows(orphans.report(df, blobs, copy)) == [("claims.retracts", "2024-03", 1, 1), ("claims.subject", "2024-06", 1, 2), ("claims.value", "2024-03", 1, 1), ("standing.claim", "2024-03", 1, 2)]
    assert orphans.found(df.limit(0), blobs.limit(0), copy.limit(0)).count() == 0


# -- p4


def test_periods(claims, rows):
    df = claims(
        ("a", "user:tag", '"x"', T(1), "c1"),
        ("a", "user:tag", ["c1"], T(3), "r1"),
        ("a", "user:tag", ["C1"], T(5), "r2"),
        ("a", "user:tag", '"x"', T(3), "c2"),  # touches
        ("a", "user:tag", ["c2"], "2024-03-04T02:00:00+02:00", "r3"),
        ("a", "user:tag", '"x"', T(6), "c3"),
        ("a", "user:tag", '"x"', T(7), "c4"),
        ("a", "user:tag", ["c3"], T(8), "r4"),  # still held by c4
        ("a", "user:tag", '"y"', T(5), "c5"),
        ("a", "user:tag", ["c5"], T(5), "r5"),  # never
        ("a", "mailbox:place", '"x"', "2024-03-01T10:00:00Z", "c6"),
        ("a", "mailbox:place", ["c6"], "2024-03-01T11:00:00Z", "r6"),
        ("a", "mailbox:place", '"x"', "2024-03-01T12:00:00Z", "c7"),
        ("a", "user:tag", '"z"', "2024-03-01T12:00:00", "c8"),  # names no instant
        ("b", "user:tag", ["c4"], T(9), "r7"),  # another subject
        ("a", "file:path", '"x"', T(1), "c9"),
    )
    assert rows(history.found(df)) == [
        ("a", "mailbox:place", '"x"', "2024-03-01T10:00:00Z", "2024-03-01T11:00:00Z"), ("a", "mailbox:place", '"x"', "2024-03-01T12:00:00Z", "open"),
        ("a", "user:tag", '"x"', T(1), T(4)), ("a", "user:tag", '"x"', T(6), "open"),
    ]


def test_periods_against_brute_force(claims, rows):
    r = random.Random(11)
    at = lambda n: (dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * n)).strftime("%Y-%m-%dT%H:%M:%SZ")
    made, lives = [], {}
    for i in range(300):
        v, a = r.choice('"v" "w"'.split()), r.randrange(60)
        made.append(("s", "user:tag", v, at(a), f"c{i}"))
        end = min((a + r.randrange(-2, 9) for _ in range(r.randrange(3))), default=None)
        if end is not None:
            made.append(("s", "user:tag", [f"c{i}"], at(end), f"r{i}"))
        if end is None or end > a:
            lives.setdefault(v, []).append((at(a), at(end) if end is not None else "~"))
    want = []
    for v, spans in lives.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want += [("s", "user:tag", v, a, b.replace("~", "open")) for a, b in merged]
    r.shuffle(made)
    assert rows(history.found(claims(*made))) == sorted(want, key=repr)


def lives_of(claims, *made):
    return history.lifetimes(claims(*made), history.TRACKED)


def test_satellites_take_only_what_differs(spark, claims, rows, tmp_path):
    kept = history.History(spark, str(tmp_path / "h"))
    first = [("a", "user:tag", '"x"', T(1), "c1"), ("a", "user:tag", ["c1"], T(3), "r1"), ("a", "mailbox:place", '"p"', T(2), "c2")]
    stored = lambda b: sum(spark.read.parquet(f"{tmp_path}/h/{n}/batch={b}").count() for n in set(kept.split.values()))
    kept.append(lives_of(claims, *first), 0)
    assert stored(0) == 3
    kept.append(lives_of(claims, *first), 1)
    assert stored(1) == 0
    late = ("a", "user:tag", '"x"', T(3), "c3")  # the end at T(3) is none any more
    kept.append(lives_of(claims, *first, late), 2)
    assert stored(2) == 1
    assert rows(kept.periods()) == [("a", "mailbox:place", '"p"', T(2), None), ("a", "user:tag", '"x"', T(1), None)]
    kept.append(lives_of(claims, *first, late, ("a", "user:tag", ["c3"], T(5), "r3")), 3)
    kept.append(lives_of(claims, *first, late, ("a", "user:tag", ["c3"], T(5), "r3")), 3)
    assert stored(3) == 1 and rows(kept.periods())[1] == ("a", "user:tag", '"x"', T(1), T(5))


def test_satellites_are_split_by_measured_rate(spark, claims, tmp_path):
    often = [x for k in range(9) for x in (("a", "user:tag", '"x"', f"2024-03-01T00:00:{2 * k:02}Z", f"c{k}"), ("a", "user:tag", [f"c{k}"], f"2024-03-01T00:00:{2 * k + 1:02}Z", f"r{k}"))]
    kept = history.History(spark, str(tmp_path / "h"))
    kept.append(lives_of(claims, *often, ("a", "mailbox:place", '"p"', T(2), "d")), 0)
    assert kept.split == {"user:tag": "often", "mailbox:place": "seldom"} and kept.periods().count() == 10


# -- p5


READINGS = [
        ("2024-03-01T00:24:38Z", None, None, "2024-03-01T00:24:38Z"), ("2024-03-01 00:24:38.999+02", None, None, "2024-02-29T22:24:38Z"),
        ("20240301T002438z", None, None, "2024-03-01T00:24:38Z"), ("2024-03-01T00:24-00:00", None, None, "2024-03-01T00:24:00Z"),
        ("Fri, 1 Mar 2024 10:00:00 +0530 (a (nested) note)", None, None, "2024-03-01T04:30:00Z"), ("(" * 30 + "deep" + ")" * 30 + "1 Mar 2024 10:00:00 (x)(y(z)) Z", None, None, "2024-03-01T10:00:00Z"), ("(" * 5000 + "1 Mar 2024 10:00:00 Z", None, None, None), ("Mon, 01 MARCH 24 10:00 pst", None, None, "2024-03-01T18:00:00Z"),
        ("Fri Mar  1 10:00:00 CEST 2024", None, None, "2024-03-01T08:00:00Z"), ("Fri, 1 Mar 2024 10:00:00 IST", "Asia/Kolkata", None, None),
        ("1709251200", None, None, "2024-03-01T00:00:00Z"), ("1709251200999", None, None, "2024-03-01T00:00:00Z"), ("170925120", None, None, None),
        ("2024-03-10 01:59:59", "America/New_York", None, "2024-03-10T06:59:59Z"), ("2024-03-10 02:30:00", "America/New_York", None, None),
        ("2024-11-03 01:30:00", "America/New_York", None, None), ("2024-11-03 02:00:00", "America/New_York", None, "2024-11-03T07:00:00Z"),
        ("2024-04-07T01:45", "Australia/Lord_Howe", None, None), ("2024-10-06T02:15", "Australia/Lord_Howe", None, None),
        ("03/04/2024 1:02 PM", "America/Phoenix", "mdy", "2024-03-04T20:02:00Z"), ("03/04/2024 13:02", "Europe/Berlin", "dmy", "2024-04-03T11:02:00Z"),
        ("13/04/2024 13:02", "Europe/Berlin", "mdy", None), ("03/04/2024 13:02", "Europe/Berlin", None, None), ("2024-03-01 12:30 am", "Asia/Tokyo", None, "2024-02-29T15:30:00Z"),
        ("2024-02-30T00:00:00Z", None, None, None), ("2023-02-29T00:00:00Z", None, None, None), ("2024-03-01T24:00:00Z", None, None, None), ("2024-03-01T10:61:00Z", None, None, None),
        ("2024-03-01T10:00:60Z", None, None, None), ("2024-03-01", "Asia/Tokyo", None, None), ("15:07", "Asia/Tokyo", None, None), ("2024-03-01T10:00:00", None, None, None),
        ("", None, None, None), ("  ", "Asia/Tokyo", None, None), (None, "Asia/Tokyo", None, None), ("0000-00-00T00:00:00Z", None, None, None), ("x|y|z", None, None, None),
        ("9999-12-31T23:59:59-01:00", None, None, None), ("0001-01-01T00:00:00Z", None, None, "0001-01-01T00:00:00Z"),
    ]


def test_readings(spark):
    df = spark.createDataFrame([(i, t, z, o) for i, (t, z, o, _) in enumerate(READINGS)], "i int, t string, z string, o string")
    got = dict(df.select("i", instants.spelled(instants.read_text(F.col("t"), F.col("z"), F.col("o")))).collect())
    assert {READINGS[i][:3]: x for i, x in got.items()} == {r[:3]: r[3] for r in READINGS}


def test_local_times_against_zoneinfo(spark):
    r = random.Random(2)
    zones = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "America/Los_Angeles"]
    cases = []
    for _ in range(3000):
        day = r.choice([dt.datetime(2024, 3, 10), dt.datetime(2025, 3, 30), dt.datetime(2025, 10, 26), dt.datetime(2024, 11, 3), dt.datetime(2025, 4, 6), dt.datetime(2024, 10, 6)])
        cases.append((str(day + dt.timedelta(minutes=5 * r.randrange(-12, 12 * 8))), r.choice(zones)))
    df = spark.createDataFrame(cases, "t string, z string")
    got = df.select("t", "z", instants.spelled(instants.read_text(F.col("t"), F.col("z"))).alias("i")).collect()
    for t, z, i in got:
        wall, zone, moments = dt.datetime.fromisoformat(t), zoneinfo.ZoneInfo(z), set()
        for fold in (0, 1):
            u = wall.replace(tzinfo=zone, fold=fold).astimezone(dt.UTC)
            if u.astimezone(zone).replace(tzinfo=None) == wall:
                moments.add(u)
        assert i == (moments.pop().strftime("%Y-%m-%dT%H:%M:%SZ") if len(moments) == 1 else None), (t, z)


def test_found_instants(spark, claims, rows):
    logs = spark.createDataFrame(
        [(1, "m", "2024-03-01T10:00"), (1, "m", "2024-03-01T10:00"), (2, None, "2024-03-01T10:00"), (3, "odd", "2024-03-01T10:00"), (4, None, "2024-03-01T10:00Z"), (None, "m", "2024-03-01T10:00"), (5, "m", None)],
        "log_id long, mailbox string, date string",
    )
    accounts = spark.createDataFrame([("m", "Asia/Tokyo", "dmy"), ("odd", "Nowhere/Land", "dmy"), (None, "Asia/Tokyo", "dmy")], "mailbox string, zone string, date_order string")
    df = claims(("a", "x:y", "1", T(1), "c1"), ("a", "x:y", "1", "2024-03-01 10:00:00Z", "C2"), ("a", "x:y", "1", "2024-03-01T10:00:00", "c3"), ("a", "x:y", "1", None, "c4"))
    assert rows(instants.found(logs, accounts, df)) == [("claims", "c2", "2024-03-01T10:00:00Z"), ("vault_logs", "1", "2024-03-01T01:00:00Z"), ("vault_logs", "4", "2024-03-01T10:00:00Z")]
    assert instants.found(logs.limit(0), accounts.limit(0), df.limit(0)).count() == 0


# -- p6


def _far(a, b):
    return nearby.angle(a[1], a[2], b[1], b[2]) * nearby.EARTH_M


def test_a_strip_of_200000_places_is_parted(spark):
    step = 0.0018  # about 129 m at 50 degrees north
    line = spark.range(200_000).select(F.lit(50.0).alias("lat"), (F.col("id") * step - 180.0).alias("lon"))
    parts = nearby.cells(line).groupBy("range", "part").agg(F.count("*").alias("n"), F.sum(F.col("native").cast("int")).alias("own")).collect()
    assert len(parts) == 10 and sum(p.own for p in parts) == 200_000 and max(p.n for p in parts) < 21_000
    assert nearby.near_places(line).count() == 200_000  # each with the next, and the last with the first


def test_a_place_of_many_subjects_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST", 50)
    df = spark.range(300).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit(1.0).alias("lat"), F.when(F.col("id") < 290, 1.0).otherwise(1.0005).alias("lon"))
    assert nearby.near_pairs(df).count() == 300 * 299 // 2


@pytest.mark.parametrize("crowd", [nearby.CROWD, 7])
def test_near_pairs_against_all_pairs(spark, crowd):
    r = random.Random(9)
    points = []
    for c, (lat, lon) in enumerate([(48.13, 11.57), (0.0, 179.9999), (0.0, -179.9999), (90.0, 0.0), (-89.9995, 50.0), (89.9987, -120.0), (60.0, -180.0), (-33.0, 180.0), (0.0001, 0.0001)]):
        for k in range(40):
            la = max(-90.0, min(90.0, lat + r.uniform(-0.003, 0.003)))
            lo = lon + r.uniform(-0.003, 0.003) / max(0.02, math.cos(math.radians(la)))
            points.append((f"p{c}-{k}", la, (lo + 180) % 360 - 180))
    points += [("same-1", 10.0, 20.0), ("same-2", 10.0, 20.0), ("same-2", 10.0, 20.0), ("same-3", 10.0, 20.0), (None, 10.0, 20.0), ("edge-a", 5.0, 180.0), ("edge-b", 5.0, -180.0), ("pole-a", 90.0, 10.0), ("pole-b", 90.0, 170.0)]
    df = spark.createDataFrame(points, "id string, lat double, lon double")
    named = sorted({p for p in points if p[0]})
    want = {(a[0], b[0]) for i, a in enumerate(named) for b in named[i + 1 :] if a[0] != b[0] and _far(a, b) <= 150}
    got = [tuple(x) for x in nearby.near_pairs(df, 150.0, crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("edge-a", "edge-b") in want and ("pole-a", "pole-b") in want


def test_locations(claims, rows):
    p = "geo:position"
    df = claims(
        ("A", p, '{"longitude":11.5,"latitude":48.1}', T(1), "c1"), ("a", p, '{"latitude":"48.1","longitude":"11.5","altitude":3}', T(1), "c2"),
        ("b", p, '{"latitude":4.81e1,"longitude":11.5}', T(1), "c3"), ("c", p, '{"latitude":"48,1","longitude":"11,5"}', T(1), "c4"), ("d", p, "[48.1,11.5]", T(1), "c5"),
        ("e", p, '{"latitude":91,"longitude":1}', T(1), "c6"), ("f", p, '{"latitude":0,"longitude":0.0}', T(1), "c7"), ("g", p, '{"latitude":true,"longitude":1}', T(1), "c8"),
        ("h", p, ["c1"], T(1), "c9"), ("i", p, None, T(1), "c10"), ("j", p, '{"latitude":1}', T(1), "c11"), ("k", p, "{broken", T(1), "c12"), (None, p, '{"latitude":1,"longitude":1}', T(1), "c13"),
    )
    assert rows(nearby.locations(df)) == [("a", 48.1, 11.5), ("b", 48.1, 11.5)]
    assert rows(nearby.found(df)) == [("a", "b")]
    assert nearby.found(df.limit(0)).count() == 0


# -- plans


def test_filters_reach_the_scan_and_no_join_multiplies(spark, tmp_path, claims):
    path = str(tmp_path / "claims.parquet")
    claims(("a", "raster:width", "1", T(1), "c1")).write.parquet(path)
    df = spark.read.parquet(path)
    for q in (wide.found(df), history.found(df), nearby.found(df), instants.claim_instants(df)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = changes.standing_claims(df, ["user:tag"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attribute,user:tag)" in plan and "position" not in plan


# -- nulls, other columns, long texts and empty tables, all operators

CLASHING = ["claim", "op", "k", "p", "row", "gone", "at", "day", "loaded", "holds", "start", "end", "batch", "key", "parent", "refs", "month", "range", "place", "number", "entity", "strip", "part", "lat", "lon", "id", "instant", "_of", "_share", "_seq"]


@pytest.fixture(scope="module")
def tables(spark, claims):
    """Claims of every kind beside rows with a null in each column, a very long text, and columns of the operators' own names."""
    good = [
        ("a", "raster:width", "1", T(1), "c1"), ("a", "user:tag", '"x"', T(1), "c2"), ("a", "user:tag", ["c2", "none", None], T(2), "r1"), ("b", "mailbox:place", '"p"', T(3), "c3"),
        ("a", "geo:position", '{"latitude":1,"longitude":1}', T(1), "c4"), ("b", "geo:position", '{"latitude":1,"longitude":1}', T(1), "c5"), ("b", "prov:origin", '"' + "d" * 64 + '"', T(1), "c6"), ("b", "file:path", '"/p"', T(1), "c7"),
        ("b", "user:tag", '"' + "y" * 200_000 + '"', T(1), "c8"), ("b", "x:y", "1", "(" * 300 + " 1 Mar 2024 10:00 Z", "c9"), ("b", "x:y", "2", "1 Mar 2024 10:00 Z", "c10"),
    ]
    holes = [tuple(None if i == k else x for i, x in enumerate(row)) for row in good for k in range(5)]
    df = claims(*good, *holes)
    df = df.unionByName(df.withColumns({"seq": F.lit(None).cast("long"), "position": F.lit(None).cast("long"), "run": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    more = lambda t: t.withColumns({c: F.lit(f"clash {c}") for c in CLASHING if c not in t.columns})
    blobs = spark.createDataFrame([("a", "content", None), (None, "content", None), ("b", None, None)], "digest string, store string, removed timestamp_ntz")
    standing = spark.createDataFrame([("c3", T(1)), ("zz", T(1)), (None, T(1)), ("qq", None)], "claim string, asserted string")
    logs = spark.createDataFrame([(1, "m", "2024-03-01 10:00"), (2, None, "2024-03-01 10:00Z"), (None, "m", "x"), (3, "m", None), (1, "m", "2024-03-01 10:00")], "log_id long, mailbox string, date string")
    accounts = spark.createDataFrame([("m", "UTC", "dmy"), (None, "UTC", None), ("n", None, None), ("o", "No/Where", "mdy")], "mailbox string, zone string, date_order string")
    return {n: more(t) for n, t in (("claims", df), ("blobs", blobs), ("standing", standing), ("vault_logs", logs), ("accounts", accounts))}


def answers(t):
    c = t["claims"]
    return {
        "p1": wide.found(c), "p2": changes.found(c, t["standing"]), "p3": orphans.found(c, t["blobs"], t["standing"]), "p3r": orphans.report(c, t["blobs"], t["standing"]),
        "p4": history.found(c), "p5": instants.found(t["vault_logs"], t["accounts"], c), "p6": nearby.found(c),
    }


def test_every_operator_bears_nulls_other_columns_and_long_texts(tables, rows):
    got = {n: rows(q) for n, q in answers(tables).items()}
    assert got["p1"] == [("a", 1, -1, -1, "", "")]
    assert got["p2"] == [("c7", "add"), ("c8", "add"), ("qq", "drop"), ("r1", "add"), ("zz", "drop")]  # without its ids, r1 is an assertion
    assert got["p3"] == [("claims.retracts", "2024-03", "none"), ("claims.value", "2024-03", "d" * 64), ("standing.claim", "2024-03", "zz")]
    assert [r[:3] for r in got["p3r"]] == [("claims.retracts", "2024-03", 1), ("claims.value", "2024-03", 1), ("standing.claim", "2024-03", 1)]
    assert [(s, a, f, t) for s, a, v, f, t in got["p4"]] == [("a", "user:tag", T(1), T(2)), ("b", "mailbox:place", T(3), "open"), ("b", "user:tag", T(1), "open")]
    assert got["p5"] == [("claims", "c10", "2024-03-01T10:00:00Z"), ("vault_logs", "1", "2024-03-01T10:00:00Z"), ("vault_logs", "2", "2024-03-01T10:00:00Z")]
    assert got["p6"] == [("a", "b")]


def test_every_operator_of_empty_tables(tables):
    assert all(q.count() == 0 for q in answers({n: t.limit(0) for n, t in tables.items()}).values())
