"""Programs as extractors, deliveries, listings of trees and mail folders, a service's delta, and answers as lines."""

from __future__ import annotations

import hashlib
import json
import os
import stat
import sys
import time

import pytest
from pyspark.sql import functions as F

from claimwright.extract import contracts, process
from claimwright.functions.blake3 import blake3
from claimwright.operators import ask, lineage, paths, verify, write
from claimwright.plans import record as r
from claimwright.sources import delivery, files
from claimwright.sources.archive import Mark
from claimwright.sources.delta import delta_round, fetched

A, B, C, D = ("a" * 64, "b" * 64, "c" * 64, "d" * 64)
T = "2024-03-0{}T00:00:00Z".format
SCRIPT = """#!{python}
import sys, json, os
if sys.argv[1:] == ["--identify"]:
    for name, derives in (("words", False), ("halves", True), ("wild", False)):
        print(json.dumps({{"extractor": 1, "contract": name, "source": "extractor:own-" + name + "/1", "mimes": ["text/plain"], "derives": derives, "later": 1}}))
    sys.exit()
data = sys.stdin.buffer.read()
if data == b"bad":
    sys.exit("own: it is bad")
if sys.argv[1] == "words":
    print("own: looked", file=sys.stderr)
    print(json.dumps({{"attribute": "own:words", "value": len(data.split())}}))
elif sys.argv[1] == "halves":
    open(os.path.join(sys.argv[2], "first"), "wb").write(data[: len(data) // 2])
    print(json.dumps({{"file": "first", "mime": "text/plain"}}))
    print(json.dumps({{"file": "first", "attribute": "file:name", "value": "f"}}))
else:
    print(data.decode())
"""


@pytest.fixture(scope="module")
def program(tmp_path_factory):
    path = tmp_path_factory.mktemp("bin") / "own"
    path.write_text(SCRIPT.format(python=sys.executable))
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_programs_answer_by_the_protocol(spark, program, rows, tmp_path):
    words, halves, wild = process.identify(program, str(tmp_path))
    assert words.source == "extractor:own-words/1" and words.mimes == ("text/plain",)
    assert words.read(b"a b").facts == [("own:words", 2)] and words.read(b"a b").remarks == ["looked"]
    assert halves.read(b"abcd").files == [(b"ab", [("file:mime", "text/plain"), ("file:name", "f")])]
    with pytest.raises(ValueError, match="it is bad"):
        words.read(b"bad")
    for answer in (b"no json", b"[]", b'{"attribute":"a:b"}', b'{"attribute":"a:b","value":1,"more":2}', b'{"attribute":"a b","value":1}', b'{"attribute":"a:b","value":null}', b'{"file":"x","mime":"y"}', b'{"file":"x","attribute":"a:b","value":1}'):
        with pytest.raises(ValueError):
            wild.read(answer)
    df = spark.createDataFrame([("x", bytearray(b"a b")), ("y", bytearray(b"bad"))], "subject string, content binary")
    got = contracts.examine(df, words)
    assert rows(got.select("subject", "value")) == [("x", "2"), ("y", None)]
    assert rows(ask.extraction_tally(got)) == [("extractor:own-words/1", 1, 1, 0, 1)]


def test_deliveries_never_overwrite(spark, tmp_path, rows):
    digest = lambda data: hashlib.sha256(data).hexdigest()
    contents = spark.createDataFrame([(digest(b"x"), bytearray(b"x")), (digest(b"y"), bytearray(b"y"))], "subject string, content binary")
    (tmp_path / "there").write_bytes(b"y")
    (tmp_path / "other").write_bytes(b"z")
    plan = spark.createDataFrame([(digest(b"x"), "a/b.txt"), (digest(b"y"), "there"), (digest(b"y"), "other"), (digest(b"q"), "gone"), (digest(b"x"), "../out")], "subject string, target string")
    done = {x.target: x.outcome for x in delivery.deliver(plan, contents, str(tmp_path)).collect()}
    assert done == {"a/b.txt": "exported", "there": "standing", "other": "failed: a different file stands here, left untouched", "gone": "failed: its content is missing", "../out": "failed: outside the destination"}
    assert (tmp_path / "a/b.txt").read_bytes() == b"x" and (tmp_path / "other").read_bytes() == b"z" and os.listdir(tmp_path / "a") == ["b.txt"]
    assert {x.outcome for x in delivery.deliver(plan.where("target = 'a/b.txt'"), contents, str(tmp_path)).collect()} == {"standing"}
    mixed = spark.createDataFrame([("file", digest(b"x")), ("segment", digest(b"y"))], "kind string, digest string")
    stores = contents.withColumn("store", F.when(F.col("subject") == digest(b"x"), "derived"))
    delivery.copied(mixed, stores, str(tmp_path / "copy"), {"content": 2, "derived": 1, "claims": 0}).collect()
    assert (tmp_path / f"copy/derived/{digest(b'x')[:2]}/{digest(b'x')}").read_bytes() == b"x" and (tmp_path / f"copy/claims/{digest(b'y')}").exists()


def test_target_state_and_tidy(tmp_path):
    mark = Mark(1, "sha256", {"content": 2, "derived": 2, "claims": 0})
    assert delivery.target_state(str(tmp_path), mark) == (False, None)
    (tmp_path / "FORMAT").write_text(json.dumps({"generation": 1, "algorithm": "sha256", "depths": mark.depths}) + "\n")
    (tmp_path / "open" / A).mkdir(parents=True)
    assert delivery.target_state(str(tmp_path), mark) == (True, A)
    with pytest.raises(ValueError, match="another mark"):
        delivery.target_state(str(tmp_path), Mark(1, "sha512", mark.depths))
    (tmp_path / "open" / A / "bundle=x").mkdir()
    with pytest.raises(ValueError, match="holds claims"):
        delivery.target_state(str(tmp_path), mark)
    os.rename(tmp_path / "open" / A, tmp_path / "open" / f"{A}.sealing")
    with pytest.raises(ValueError, match="sealed"):
        delivery.target_state(str(tmp_path), mark)
    for name, old in (("1-2.tmp", True), ("3-4.tmp", False), ("keep.tmp", True)):
        (tmp_path / name).write_bytes(b"xy")
        os.utime(tmp_path / name, (time.time() - 90_000 * old,) * 2)
    assert delivery.tidy([str(tmp_path), str(tmp_path / "none")], dry_run=True) == {"removed": 1, "bytes": 2, "young": 1}
    assert delivery.tidy([str(tmp_path)]) == {"removed": 1, "bytes": 2, "young": 1} and not (tmp_path / "1-2.tmp").exists() and (tmp_path / "keep.tmp").exists()


def test_trees_leave_out_links_and_archives(spark, tmp_path):
    root = tmp_path / "r"
    for name in ("a.txt", "cache/b.txt", "in/FORMAT", "in/deep/c.txt", "d/e.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root / "d", root / "linked")
    assert sorted(x.relative for x in files.file_tree(spark, str(root), ("cache",)).collect()) == ["a.txt", "d/e.txt"]


def test_mail_directories(spark, tmp_path):
    (tmp_path / "Entwürfe").mkdir()
    (tmp_path / "Entwürfe" / "1").write_bytes(b"From: a@x.org\nDate: x\n\n")
    (tmp_path / "2.eml").write_bytes(b"From: b@x.org\nDate: x\n\n")
    (tmp_path / ".3.eml").write_bytes(b"From: c@x.org\nDate: x\n\n")
    (tmp_path / "note.txt").write_bytes(b"no mail")
    assert sorted(x.place for x in files.mail_directory(spark, str(tmp_path), "acc").collect()) == ["acc", "acc:Entwürfe"]


def test_older_vaults(spark, tmp_path, rows):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "1.jsonl").write_text('{"version":1,"mailbox":"m","folder":"f"}\n{"store_id":"x","time":"2"}\n{"store_id":"y"}\n{"store_id":"x","ti')
    (tmp_path / "2.jsonl").write_text('{"version":1,"mailbox":"m","folder":"f"}\n{"store_id":"x","time":"1"}\n')
    (tmp_path / "3.jsonl").write_text("torn")
    assert rows(files.vault_messages(files.vault_lines(spark, str(tmp_path)))) == [("x", "m:f", "1"), ("y", "m:f", None)]


def test_delta_rounds():
    pages = {
        "start": (200, {}, {"value": [{"id": "1"}, {"id": "2", "@removed": {}}], "@odata.nextLink": "next"}), "next": (200, {}, {"value": [{"id": "3"}], "@odata.deltaLink": "kept"}),
        "old": (410, {}, {}), "kept": (200, {}, {"value": [], "@odata.deltaLink": "kept2"}),
    }
    first = delta_round(pages.get, "start")
    assert ([m["id"] for m in first.changed], first.removed, first.link, first.restarted) == (["1", "3"], ["2"], "kept", False)
    assert delta_round(pages.get, "start", "kept").link == "kept2"
    again = delta_round(pages.get, "start", "old")
    assert again.restarted and len(again.changed) == 2
    answers, waits, renewed = [(401, {}, {}), (429, {"Retry-After": "7"}, {}), (503, {}, {}), (200, {}, {"ok": 1})], [], []
    assert fetched(lambda _: answers.pop(0), "x", lambda: renewed.append(1), waits.append) == (200, {"ok": 1}) and waits == [7.0, 2.0] and renewed == [1]
    with pytest.raises(ConnectionError):
        fetched(lambda _: (500, {}, {}), "x", None, waits.append)
    with pytest.raises(ConnectionError):
        delta_round(lambda _: (403, {}, {}), "x")


def test_trees_as_nested_objects(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "c"), ("x", "y")], "origin string, subject string")
    tree = lineage.trees(links, spark.createDataFrame([("a",), ("x",), ("z",)], "subject string"))
    lines = {}
    for x in lineage.tree_lines(tree).orderBy("root", "place").collect():
        lines[x.root] = lines.get(x.root, "") + x.text
    leaf = lambda s: {"subject": s, "derived": []}
    assert json.loads(lines["a"]) == {"subject": "a", "derived": [{"subject": "b", "derived": [leaf("c")]}, leaf("d")]}
    assert json.loads(lines["x"]) == {"subject": "x", "derived": [leaf("y")]} and json.loads(lines["z"]) == leaf("z")


def test_levels_runs_and_attributes_as_lines(claims):
    df = claims((A, "file:path", '"/p/a"', T(1), "1"), (B, "file:path", '"/p/a"', T(1), "2"), (C, "file:path", '"/p/q/b"', T(2), "3"))
    assert sorted(x.line for x in paths.level_lines(df, "/p").collect()) == ['{"file":"a","subjects":["%s","%s"]}' % (A, B), '{"folder":"q"}']
    assert [x.line for x in ask.run_lines(df).collect()] == ['{"run":"r1","first":"%s","last":"%s","files":3,"claims":3,"retractions":0,"sources":["ingest"]}' % (T(1), T(2))]
    assert [x.line for x in ask.attribute_lines(df).collect()] == ['{"attribute":"file:path","files":3}']


def test_retractions_of_all_or_nothing(spark, claims, rows):
    df = claims((A, "user:tag", '"x"', T(1), "1"), (A, "user:tag", '"x"', T(2), "2"), (A, "user:tag", "7", T(1), "3"), (B, "user:tag", '"*"', T(1), "4"), (A, "x:y", "1", T(1), "5"))
    ask_for = lambda *x: spark.createDataFrame(list(x), "subject string, attribute string, pattern string")
    taken, unmet = write.retract_all(df, ask_for((A, "user:tag", "x"), (A, "x:y", ".."), (B, "user:tag", '"*"')), T(9), "r")
    assert rows(taken.select("subject", "attribute", "retracts")) == [(A, "user:tag", ["1", "2"]), (A, "x:y", ["5"]), (B, "user:tag", ["4"])] and unmet.count() == 0
    taken, unmet = write.retract_all(df, ask_for((A, "user:tag", "7"), (A, "user:tag", "none")), T(9), "r")
    assert taken.count() == 0 and rows(unmet) == [(A, "user:tag", "none")]
    with pytest.raises(ValueError, match="glob"):
        write.retract_all(df, ask_for((A, "user:tag", "x*")), T(9), "r")
    r.record(df)


def test_landing_tells_tags(spark, rows):
    df = spark.createDataFrame([(A, "m:f", "i", 3, T(1), True, ["t", "u"]), (B, "m:f", "j", 4, T(1), False, [])], "subject string, place string, message_id string, size long, time string, fresh boolean, tags array<string>")
    told = [(s, a, v) for s, a, v in rows(write.land(df, "r").select("subject", "attribute", "value")) if s == A]
    assert told == [(A, "file:mime", '"message/rfc822"'), (A, "file:size", "3"), (A, "mailbox:id", '"i"'), (A, "mailbox:place", '"m:f"'), (A, "mailbox:tag", '"t"'), (A, "mailbox:tag", '"u"')]


def test_blake3():
    pattern = lambda n: bytes(i % 251 for i in range(n))
    for size, want in {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
        31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    }.items():
        assert blake3(pattern(size)) == want, size


def test_fixity_by_algorithm(spark, rows):
    df = spark.createDataFrame([(blake3(b"x"), bytearray(b"x")), (blake3(b"x"), bytearray(b"y")), (hashlib.sha512(b"x").hexdigest(), bytearray(b"x")), (A, None)], "digest string, content binary")
    assert sorted(x.fixity for x in verify.fixity(df, algorithm="blake3").collect()) == ["damaged", "damaged", "sound", "unreadable"]
    assert sorted(x.fixity for x in verify.fixity(df).collect()) == ["damaged", "damaged", "sound", "unreadable"]
