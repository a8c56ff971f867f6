"""The claim engine: standing set, terms, scopes, moments, lineage, paths, integrity, surgery."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import Window, functions as F

from claimwright.functions import grammar
from claimwright.operators import ask, lineage, paths, reconcile, rewrite, verify, write
from claimwright.plans import record as r
from claimwright.plans.find import find
from claimwright.plans.ranks import ranked
from claimwright.plans.terms import Term, closing, glob_to_regex, opening, part_path, spelled_json, widened
from claimwright.sources import log

T = "2024-03-0{}T00:00:00Z".format
A, B, C, D = ("a" * 64, "b" * 64, "c" * 64, "d" * 64)


@pytest.fixture(scope="module")
def archive(claims):
    return claims(
        (A, "file:mime", '"text/plain"', T(1), "1"), (A, "file:path", '"/home/a.txt"', T(1), "2"), (A, "user:tag", '"keep"', T(2), "3"), (A, "file:size", "7", T(1), "4"),
        (B, "file:mime", '"text/plain"', T(1), "5"), (B, "file:path", '"@inner/b.txt"', T(1), "6"), (B, "prov:origin", f'"{A}"', T(1), "7"), (B, "file:size", '"7"', T(1), "8"),
        (C, "file:mime", '"text/plain"', T(1), "9"), (C, "user:tag", '"keep"', T(1), "10"), (C, "user:tag", ["10"], T(3), "11"), (C, "file:size", "12.5", T(1), "12"),
        (D, "geo:position", '{"latitude":48.5,"longitude":11}', T(1), "13"), (D, "geo:position", '{"latitude":10,"longitude":20,"altitude":null}', T(1), "14"), (D, "mailbox:place", '"work:Inbox"', T(1), "15"),
        (D, "file:name", '"x?y"', T(1), "16"), (A, "file:mime", '"text/plain"', T(1), "1"),
    )


FINDS = [
    (["file:mime=text/plain"], (), "held", "ABC"), (["file:mime=text/*"], (), "held", "ABC"), (["file:mime=TEXT/*"], (), "held", ""), (['file:mime="text/plain"'], (), "held", "ABC"),
    (["file:mime=text/plain"], (), "present", "AB"), (["file:mime=text/plain"], ("user:tag",), "held", "BC"), (["file:mime=text/plain"], ("user:",), "present", "B"),
    (["file:size=7"], (), "held", "AB"), (['file:size="7"'], (), "held", "B"), (["file:size=7..20"], (), "held", "AC"), (["file:size=..8"], (), "held", "A"), (["file:size=.."], (), "held", "ABC"),
    (["user:tag=keep"], (), "held", "A"), (["user:tag=keep"], (), "record", "AC"), (["user:tag=a..l"], (), "held", "A"), (["user:tag=..keep"], (), "held", "A"), (["user:tag=..kee"], (), "held", ""),
    (["geo:position.latitude=40..50"], (), "held", "D"), (["geo:position.latitude=40..50", "geo:position.longitude=15..25"], (), "held", ""), (["geo:position.latitude=5..15", "geo:position.longitude=15..25"], (), "held", "D"),
    (["geo:position.altitude=.."], (), "held", "D"), (["geo:position=.."], ("geo:position.altitude",), "held", ""), (["geo:position=.."], ("geo:position.none",), "held", "D"),
    (["source=ingest", "time=2024-03-02"], (), "held", "A"), (["time=2024-03-02.."], (), "held", "A"), (["retract=true"], (), "record", "C"), ([f"subject={A.upper()}"], (), "held", "A"),
    ([], ("file:mime",), "held", "D"), ([], (), "held", ""), (["file:name=x[?]y"], (), "held", "D"), (["file:mime=text/plain", "user:tag=.."], (), "held", "A"), (["user:tag=none"], (), "held", ""),
]


def test_find(archive):
    for terms, missing, scope, want in FINDS:
        got = {x.subject[0].upper() for x in find(archive, terms, missing, scope).collect()}
        assert got == set(want), (terms, missing, scope)


def test_find_refuses():
    for bad in (lambda: Term.parse("nope"), lambda: Term.parse("a:b.C=1"), lambda: find(None, ["retract=true"]), lambda: find(None, [], scope="all")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("a*c", ["ac", "a/b\nc"], ["abcd"]), ("?", ["é", "\n"], ["", "ab"]), ("a[^b]", ["ac"], ["ab", "a"]), ("[!b]", ["!", "b"], ["a"]), ("[]a]", ["]", "a"], ["b"]), ("[a-c]x", ["bx"], ["dx"]), ("[a", [], ["[a", "a"]), ("a.b", ["a.b"], ["axb"]), ("[a&&b]", ["&", "a"], ["c"])],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x, x in yes) for x in yes + no], "x string, want boolean")
    assert df.where(F.col("x").rlike(glob_to_regex(glob)) != F.col("want")).count() == 0


def test_part_paths():
    assert part_path("a.0.b-c") == "$['a'][0]['b-c']"


def test_moments(claims, rows):
    df = claims((A, "user:tag", '"late"', T(5), "1"), (A, "user:tag", '"back"', T(1), "2"), (A, "user:tag", ["2"], T(6), "3"))
    runs = df.withColumn("run", F.when(F.col("cid") == "3", "r3").when(F.col("cid") == "1", "r1").otherwise("r2")).withColumn("seq", F.when(F.col("cid") == "1", 0).otherwise(1).cast("long"))
    assert rows(r.live_values(r.as_of(df, T(4))).select("value")) == [('"back"',)]
    assert rows(r.live_values(r.as_of_run(runs, "r2")).select("value")) == [('"back"',), ('"late"',)]
    assert rows(r.live_values(r.as_of_run(runs, "r3")).select("value")) == [('"late"',)]
    assert r.as_of_run(runs, "none").count() == 0


def test_record_keeps_the_last_place(claims):
    df = claims((A, "x:y", "1", T(1), "C"), (A, "x:y", "1", T(1), "c"), (A.upper(), "x:y", "1", T(1), "c"))
    assert [(x.cid, x.seq, x.position) for x in r.record(df).collect()] == [("c", 0, 2)]


def test_times_are_widened_or_refused(spark):
    assert (opening("2024-05-01"), closing(" 2024-05-01 "), opening("2024-05-01T10:00:00"), closing("2024-02-29T10:00:60Z")) == ("2024-05-01T00:00:00Z", "2024-05-01T23:59:59Z", "2024-05-01T10:00:00Z", "2024-02-29T10:00:60Z")
    for bad in ("2024-05", "nonsense", "2023-02-29", "2024-05-01T10:00Z", "2024-05-01T24:00:00", "", "2024-05-01T10:00:00+02:00"):
        with pytest.raises(ValueError):
            opening(bad)
        assert spark.range(1).select(widened(F.lit(bad), "T00:00:00")).first()[0] is None
    assert spark.range(1).select(widened(F.lit(" 2024-05-01"), "T23:59:59")).first()[0] == "2024-05-01T23:59:59Z"


def test_scalars_match_by_their_one_spelling(claims, rows):
    spelt = {"1e3": "1000.0", "8": "8", "-0": "-0.0", "1.50": "1.5", "1e16": "1e16", "123456789012345678": "123456789012345678", "1e-5": "0.00001", "12e-7": "1.2e-6", "true": "true", "1e300": "1e300", "18446744073709551616": "1.8446744073709552e19"}
    for word, want in spelt.items():
        assert spelled_json(json.loads(word, parse_int=lambda t: float(t) if t == "-0" else int(t))) == want
    df = claims((A, "x:y", "1000.0", T(1), "1"), (B, "x:y", '"1e3"', T(1), "2"), (C, "x:y", "1e3", T(1), "3"))
    assert rows(find(df, ["x:y=1e3"])) == [(A,), (B,)]


def test_pairs_are_bare_unless_they_would_be_misread(claims, rows):
    df = claims(*[(A, "user:tag", v, T(1), str(i)) for i, v in enumerate(['"2024-05"', '"true"', '"a b"', '"a..b"', '""', '"é*"', "7", '{"a":1}', '"x\\"y"'])])
    assert [p for _, p in rows(ask.pairs(df, ["user:tag"]))] == sorted(["user:tag=2024-05", "user:tag=true", 'user:tag="a b"', 'user:tag="a..b"', 'user:tag=""', 'user:tag="é*"', "user:tag=7", 'user:tag={"a":1}', 'user:tag="x"y"'])


def test_a_place_of_no_string_is_a_place(claims):
    df = claims((A, "file:path", "3", T(1), "1"), (B, "file:path", '"@in"', T(1), "2"))
    assert [x.subject for x in lineage.roots(df).collect()] == [A]


# -- lineage


def graph(spark, *pairs):
    return spark.createDataFrame(list(pairs), "origin string, subject string")


def test_closure_ends_on_cycles_and_goes_all_the_way(spark, rows):
    links = graph(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"))
    start = spark.createDataFrame([("a",), ("a",)], "node string")
    assert rows(lineage.closure(start, links.toDF("node", "next"))) == [("a",), ("b",), ("c",), ("d",)]


def test_placed_and_hits_agree(archive):
    placed = {x.subject for x in lineage.placed(archive).collect()}
    assert placed == {A, B, D}
    hits = archive.select("subject").distinct()
    assert {x.subject for x in lineage.placed_hits(archive, hits).collect()} == placed


def test_trees_and_descents(spark, rows):
    links = graph(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b"))
    assert [(x.node, x.place) for x in lineage.flat(lineage.trees(links, spark.createDataFrame([("a",)], "subject string"))).orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert rows(lineage.trees(links, spark.createDataFrame([("a",)], "subject string")).drop("path")) == [("a", "a", None, 0), ("a", "b", "a", 1), ("a", "c", "a", 1), ("a", "d", "b", 2)]
    down = lineage.descents(links, spark.createDataFrame([("d",), ("a",)], "subject string"))
    assert rows(down) == [("a", ["a"]), ("d", ["a", "b", "d"]), ("d", ["a", "c", "d"])]


def test_only_from_needs_all_origins_gone(spark, rows):
    links = graph(spark, ("a", "b"), ("b", "c"), ("a", "d"), ("x", "d"), ("b", "e"))
    gone, kept = spark.createDataFrame([("a",)], "subject string"), spark.createDataFrame([("e",)], "subject string")
    assert rows(lineage.only_from(links, gone, kept)) == [("a",), ("b",), ("c",)]


# -- ranks, paths


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 5003).alias("o"))
    same = ranked(df, ["k"], ["o"]).join(df.select(F.col("o").alias("p"), F.row_number().over(Window.partitionBy("k").orderBy("o")).alias("n")), F.col("o") == F.col("p"))
    assert same.where("rank <> n").count() == 0 and same.count() == 5000


@pytest.fixture(scope="module")
def tree(claims):
    names = ["/p/2023/a.jpg", "/p/2023/b.jpg", "/p/2024/a.jpg", "/p", "/q/x/1.txt", "/q/x/y/2.txt", "@in/a", "/pq/z"]
    return claims(*[(c * 64, "file:path", f'"{n}"', T(1), str(i)) for i, (c, n) in enumerate(zip("abcdef01", names))], (A, "file:path", '"/p/2024/a.jpg"', T(2), "9"), (A, "file:path", "3", T(2), "10"))


def test_paths(tree, rows):
    assert [p for p, _ in rows(paths.under(tree, "/p").select("path", "subject"))] == ["/p", "/p/2023/a.jpg", "/p/2023/b.jpg", "/p/2024/a.jpg", "/p/2024/a.jpg"]
    assert paths.under(tree, "/").count() == 8
    assert rows(paths.level(tree, "/q/x")) == [("1.txt", 1, 0), ("y", 0, 1)]
    assert dict(rows(paths.tree_counts(tree)))["/p/"] == 4
    assert {(x.path, x.subject[0]) for x in paths.newest_by_path(tree).collect()} >= {("/p/2024/a.jpg", "a"), ("/p", "d")}
    shown = {(x.id, x.parent, x.name, x.folder) for x in paths.forest(tree).collect()}
    assert shown == {
        (1, 0, "@in", True), (2, 1, "a", False), (3, 0, "p", True), (4, 3, "2023", True), (5, 4, "a.jpg", False), (6, 4, "b.jpg", False), (7, 3, "2024", True), (8, 7, "a.jpg", False),
        (9, 0, "p-dddddddd", False), (10, 0, "pq", True), (11, 10, "z", False), (12, 0, "q", True), (13, 12, "x", True), (14, 13, "1.txt", False), (15, 13, "y", True), (16, 15, "2.txt", False),
    }


def laid(spark, *pairs):
    kinds = {"p": "file:path", "n": "file:name", "m": "mailbox:place"}
    df = spark.createDataFrame([(s * 32, kinds[k], place) for s, k, place in pairs], "subject string, attribute string, place string")
    return sorted(x.target for x in paths.lay_out(df).collect())


def test_lay_out(spark):
    assert laid(spark, ("1f", "p", "/home/s/docs/report.pdf")) == ["report.pdf"]
    assert laid(spark, ("1f", "p", "/home/s/photos/a.jpg"), ("2e", "p", "/home/s/photos/2024/b.jpg")) == ["2024/b.jpg", "a.jpg"]
    assert laid(spark, ("1f", "p", "/home/s/photos/a.jpg"), ("2e", "p", "/home/s/mail/b.eml")) == ["mail/b.eml", "photos/a.jpg"]
    assert laid(spark, ("1f", "p", "/home/s/photos/a.jpg"), ("2e", "p", "/home/s/photos/b.jpg"), ("3d", "p", "/mnt/nas/mail/c.eml")) == ["mail/c.eml", "photos/a.jpg", "photos/b.jpg"]
    assert laid(spark, ("4c", "n", "invoice.pdf"), ("4c", "n", "invoice.pdf")) == ["invoice.pdf"]
    assert laid(spark, ("5b", "p", "/home/s/docs/a.txt"), ("5b", "p", "/home/s/docs/backup/a.txt")) == ["a.txt", "backup/a.txt"]
    assert laid(spark, ("7a", "p", "@dir/a.txt"), ("8b", "p", "@other/a.txt"), ("9c", "p", "@@odd.txt")) == ["@odd.txt", "dir/a.txt", "other/a.txt"]
    assert laid(spark, ("3d", "m", "example.org:Archive/2024"), ("6a", "m", "other:../../etc")) == [f"example.org/Archive/2024/{'3d' * 32}.eml", f"other/etc/{'6a' * 32}.eml"]
    assert laid(spark, ("6a", "n", "../../etc/evil")) == ["evil"] and laid(spark, ("1f", "p", "/a"), ("2e", "p", "/b/c")) == ["a", "b/c"]


def test_disambiguate(spark, rows):
    df = spark.createDataFrame([("b", "x/n.txt"), ("a", "x/n.txt"), ("c", "x/n.txt"), ("a", "solo")], "subject string, target string")
    assert rows(paths.disambiguate(df)) == [("a", "solo", "solo"), ("a", "x/n.txt", "x/n.txt"), ("b", "x/n.txt", "x/n-2.txt"), ("c", "x/n.txt", "x/n-3.txt")]
    taken = spark.createDataFrame([("a", "n.txt"), ("b", "n.txt"), ("c", "n.txt"), ("d", "n-2.txt"), ("e", "n-2.txt"), ("f", "n-4.txt"), ("g", "N.TXT"), ("h", ".x"), ("i", ".x")], "subject string, target string")
    assert [n for *_, n in rows(paths.disambiguate(taken))] == ["n.txt", "n-3.txt", "n-5.txt", "n-2.txt", "n-2-2.txt", "n-4.txt", "N.TXT", ".x", ".x-2"]
    assert [n for *_, n in rows(paths.disambiguate(taken, fold_case=True))] == ["n-3.txt", "n-5.txt", "n-6.txt", "n-2.txt", "n-2-2.txt", "n-4.txt", "N.TXT", ".x", ".x-2"]


def test_excludes(spark):
    cases = [("a/b.tmp", ["*.tmp"], True), ("a/b.tmpx", ["*.tmp"], False), ("a/cache/x", ["cache"], True), ("a/b/c", ["/a/*"], True), ("z/a/b", ["a/b"], False), ("a/x/y/b", ["a/**/b"], True), ("a/b", ["a/**/b"], True),
             ("a/x/y/b", ["a/*/b"], False), ("a.log", ["*.{tmp,log}"], True), ("x1", ["x[!0-4]"], False), ("x7", ["x[!0-4]"], True), ("a/b", ["a/**"], True), ("ab", ["a/**"], False)]
    for path, globs, want in cases:
        assert spark.range(1).select(paths.excluded(F.lit(path), globs)).first()[0] is want, path


def test_gone_places_spares_an_empty_listing(spark, tree, rows):
    listing = spark.createDataFrame([("/q/x/1.txt",)], "path string")
    assert [p for p, _ in rows(paths.gone_places(tree, listing, "/q"))] == ["/q/x/y/2.txt"]
    assert paths.gone_places(tree, listing, "/p").count() == 0


def test_questions(archive, rows):
    assert dict(rows(ask.attribute_counts(archive)))["user:tag"] == 1
    assert rows(ask.worklist(archive, ["text/plain"], "x")) == [(A,), (B,), (C,)]
    assert {x.short for x in ask.shortest_prefix(archive, 2).collect()} == {"aa", "bb", "cc", "dd"}
    assert {x.attribute for x in ask.placements(archive).where(F.col("subject") == D).collect()} == {"mailbox:place"}
    assert rows(ask.newest(archive, "file:size").select("subject", "value")) == [(A, "7"), (B, '"7"'), (C, "12.5")]
    h = ask.history(archive).collect()[0]
    assert (h.claims, h.retractions, h.files) == (16, 1, 4)


def test_shortest_prefix_of_near_digests(spark, claims, rows):
    near = ["ab" * 5 + "0" * 54, "ab" * 5 + "1" * 54, "cd" * 32]
    df = claims(*[(s, "x:y", "1", T(1), str(i)) for i, s in enumerate(near)])
    assert sorted(x.short for x in ask.shortest_prefix(df, 4).collect()) == ["ab" * 5 + "0", "ab" * 5 + "1", "cdcd"]


# -- integrity, surgery, listings


def test_chain(spark, rows):
    df = spark.createDataFrame([(0, "A", None), (1, "b", "a"), (2, "c", "B"), (3, "d", "b"), (4, "e", "zz")], "seq long, digest string, previous string")
    assert [x[2] for x in rows(verify.chain_check(df))] == ["first", "linked", "forked", "forked", "missing"]


def test_presence(spark, archive, rows):
    from datetime import datetime

    gone = datetime(2024, 1, 1)
    blobs = spark.createDataFrame([(A.upper(), "content", 7, gone, None), (A, "derived", 7, gone, None), (B, "content", 7, gone, gone), ("e" * 64, "derived", None, None, None)], "digest string, store string, length long, stored timestamp_ntz, removed timestamp_ntz")
    assert rows(verify.missing(archive, blobs)) == [(B,), (C,), (D,)]
    assert rows(verify.unrecorded(archive, blobs)) == [("e" * 64,)]
    assert rows(verify.twins(blobs)) == [(A,)]
    assert verify.undescribed(archive, blobs).count() == 0
    assert rows(verify.content_of(blobs)) == [(A, "content"), ("e" * 64, "derived")]
    segments = spark.createDataFrame([(0, None), (1, A)], "seq long, previous string")
    got = dict(rows(verify.sealed_digests(archive, segments).select("seq", "digest")))
    lines = [x.line for x in r.record(archive).where("seq = 1").select("time", grammar.claim_line().alias("line")).orderBy("time", "line").collect()]
    assert got[1] == log.segment_digest(A, lines) and len(got) == archive.select("seq").distinct().count()
    states = spark.createDataFrame([(A, "content", "sound"), (A, "derived", "damaged"), (B, "content", "damaged"), (B, "derived", "sound"), (C, "content", "damaged"), (C, "derived", "unreadable"), (D, "content", "sound")], "digest string, store string, fixity string")
    assert rows(verify.weed(states)) == [(A, "release"), (B, "repair"), (C, "stand")]
    assert {(x.digest, x.derived) for x in verify.set_aside(archive, states).collect()} == {(A, True), (B, False), (C, False)}
    kinds = {x.kind for x in verify.findings(archive, blobs, spark.createDataFrame([(0, "x", None, 4), (1, "y", "q", 1)], "seq long, digest string, previous string, n_claims long"), states).collect()}
    assert kinds >= {"missing", "unrecorded", "twin", "missing-segment", "miscounted", "damaged", "unreadable"}
    lacking = spark.createDataFrame([(A, True, False), (B, True, True)], "digest string, no_size boolean, no_mime boolean")
    told = verify.describe(lacking, spark.createDataFrame([(A, 3, "x/y")], "digest string, size long, mime string"), T(9), "r")
    assert rows(told.select("subject", "attribute", "value", "source")) == [(A, "file:size", "3", "maintain")]


def test_surgery(spark, claims, rows):
    df = claims(
        (A, "file:path", '"/a"', T(1), "1"), (B, "prov:origin", f'"{A}"', T(1), "2"), (B, "text:words", "3", T(1), "3"), (B, "user:tag", '"mine"', T(1), "4"),
        (A, "file:path", ["1"], T(2), "5"), (C, "prov:origin", f'"{A}"', T(1), "6"), (C, "prov:origin", f'"{D}"', T(1), "7"), (B, "text:words", ["3"], T(3), "8"),
    ).withColumn("source", F.when(F.col("cid").isin("2", "3"), "extractor:x/1").otherwise("user"))
    gone, kept = spark.createDataFrame([(A,)], "subject string"), spark.createDataFrame([(D,)], "subject string")
    assert [x[0] for x in rows(rewrite.remove(df, gone, kept).select("cid"))] == ["4", "7"]
    assert [x[0] for x in rows(rewrite.unextract(df).select("cid"))] == ["1", "4", "5", "6", "7"]
    once = rewrite.unextract(df)
    assert rows(rewrite.unextract(once).select("cid")) == rows(once.select("cid"))


def test_rehash_renames_subjects_links_and_targets(spark, claims):
    df = claims((A, "file:path", '"/a"', T(1), "1"), (B, "prov:origin", f'"{A}"', T(1), "2"), (A, "file:path", ["1", "zz"], T(2), "3"), (C, "x:y", "1", T(1), "4"), (B, "prov:origin", f'"{C}"', T(1), "5"))
    names = spark.createDataFrame([(A, "1" * 128), (B.upper(), "2" * 128)], "old string, new string")
    got = {x.cid: x for x in rewrite.rehash(df, names).collect()}
    line = lambda x: "{" + f'"subject":"{x.subject}","attribute":"{x.attribute}"' + (f',"value":{x.value}' if x.value else ',"retracts":' + json.dumps(x.retracts, separators=(",", ":"))) + f',"time":"{x.time}","source":"{x.source}","run":"{x.run}"' + "}"
    assert all(got[k].new_cid == hashlib.sha512(line(got[k]).encode()).hexdigest() for k in "123")
    assert got["2"].value == json.dumps("1" * 128) and got["3"].retracts == [got["1"].new_cid, "zz"] and got["4"].new_cid is None and got["5"].new_cid is None


def test_replacements_are_said_of_the_new_file(spark, claims, rows):
    df = claims((A, "user:tag", '"x"', T(1), "1"), (A, "user:tag", '"y"', T(1), "2"), (A, "file:size", "3", T(1), "3"), (B, "user:tag", '"y"', T(1), "4"), (A, "user:tag", '"x"', T(2), "5"))
    got = rewrite.replace(df, spark.createDataFrame([(A, B)], "old string, new string"))
    assert rows(got.select("subject", "attribute", "value", "time")) == [(B, "user:tag", '"x"', T(1))]


def test_retractions_by_value_become_retractions_by_id(spark, rows):
    one = lambda n, **more: (n, json.dumps({"subject": A, "attribute": "user:tag", **more, "time": T(1), "source": "user"}, separators=(",", ":")))
    lines = [one(1, value="x"), one(2, value="x"), one(3, value="y"), one(4, value="x", retract=True), one(5, value="x", retract=True), one(6, value="x"), one(7, retract=True)]
    got = dict(rows(rewrite.by_ids(spark.createDataFrame(lines, "n long, line string"))))
    ids = {n: hashlib.sha256(x.encode()).hexdigest() for n, x in lines}
    assert sorted(got) == [1, 2, 3, 4, 6, 7] and json.loads(got[4])["retracts"] == [ids[1], ids[2]] and sorted(json.loads(got[7])["retracts"]) == sorted([ids[3], ids[6]])


def test_cut_keys_are_claimed_by_prefix(spark, rows):
    long = "k" * 130
    archived = spark.createDataFrame([(x,) for x in (long + "a", long + "b", long + "b", "short", "one", "one", "")], "key string")
    listed = spark.createDataFrame(list(enumerate([long, long + "b", long, "short", "short", "one", "none", "", "k" * 128, long])), "place long, key string")
    got = rows(reconcile.claimed_copies(listed, archived).select("place", "taken", "settled"))
    assert got == [(0, True, False), (1, True, False), (2, True, False), (3, True, False), (4, False, False), (5, True, True), (6, False, False), (7, False, False), (8, False, False), (9, False, False)]
    assert rows(reconcile.claimed_copies(listed.where("place < 3"), archived).select("place", "taken", "settled")) == [(0, True, True), (1, True, True), (2, True, True)]


def test_a_folder_stops_after_refusals_in_a_row(spark, rows):
    tries = [("a", n, n in (3, 7)) for n in range(1, 30)] + [("b", n, n % 3 == 0) for n in range(40)] + [("c", n, False) for n in range(9)] + [("d", n, False) for n in range(12)]
    df = spark.createDataFrame(tries, "folder string, uid long, ok boolean")
    assert rows(reconcile.stopped(df, ["folder"], "uid", "ok")) == [("a", 17), ("d", 9)]


def test_restate_and_write(claims, spark, rows):
    df = claims((A, "old:name", "1", T(1), "1"), (A, "new:name", "1", T(1), "2"), (B, "old:name", "2", T(1), "3"))
    assert rows(rewrite.restate(df, "old:name", "new:name")) == [(B, "2")]
    taken = write.retract(df, "old:name", F.lit(True), T(9), "run").collect()
    assert {(x.subject, tuple(x.retracts)) for x in taken} == {(A, ("1",)), (B, ("3",))} and len({x.cid for x in taken}) == 2
    assert r.live(df.unionByName(spark.createDataFrame(taken, write.retract(df, "old:name", F.lit(True), T(9), "run").schema), allowMissingColumns=True)).count() == 1


def test_listings(spark, rows):
    keys = lambda *x: spark.createDataFrame([(k, i) for i, k in enumerate(x)], "key string, place int")
    assert rows(reconcile.settled(keys("a", "a", "b", None), keys("a", "b", "b", "c"))) == [("a", 2, 1, False), ("b", 1, 2, True)]
    assert rows(reconcile.claimed(keys("a", "a", "b", None), keys("a", "c"))) == [("a", 0)]
    old, new = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert rows(reconcile.snapshot_changes(old, new, ["k"])) == [(1, "retract"), (3, "assert")]
    uid = spark.createDataFrame([("f", 1, True), ("f", 2, True), ("f", 3, False), ("f", 4, True), ("g", 1, False)], "f string, u int, ok boolean")
    assert rows(reconcile.frontier(uid, "f", "u", "ok")) == [("f", 2)]
    assert rows(reconcile.pending(uid, ["f"])) == [("g", 1, False)]
    carriers = spark.createDataFrame([("i", "a", True, False), ("i", "b", False, False), ("j", "c", False, False), ("j", "d", False, True)], "id string, subject string, placed boolean, has boolean")
    assert rows(reconcile.receivers(carriers)) == [("i", "a"), ("j", "c")]


def test_standing_does_not_depend_on_the_order_of_the_log(claims, rows):
    rnd = random.Random(8)
    feed = [(A, "user:tag", f'"{i}"', T(1), f"c{i}") for i in range(40)] + [(A, "user:tag", [f"c{rnd.randrange(60)}"], T(2), f"r{i}") for i in range(20)]
    want = rows(r.live_values(claims(*feed)))
    rnd.shuffle(feed)
    assert rows(r.live_values(claims(*feed))) == want
