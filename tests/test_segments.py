"""The log on files: bundles, seals and the states between their steps, and a reader's copy."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from claimwright.sources import segments
from claimwright.sources.log import header
from claimwright.sources.segments import Log, parse_header
from claimwright.streaming import ingest
from claimwright.streaming.index import Index

A, B = "a" * 64, "b" * 64


def some(claims, *tags, day=1):
    return claims(*[(A, "user:tag", f'"{t}"', f"2024-03-0{day}T00:00:0{n}Z", "x") for n, t in enumerate(tags)]).withColumn("run", F.lit(None).cast("string"))


def test_headers():
    assert header(None) == '{"segment":1}' and parse_header('{"segment": 1}') is None
    assert parse_header(header(A)) == A and parse_header(json.dumps({"segment": 1, "later": [1], "previous": A.upper()})) == A
    for bad in ("", "{}", "[1]", '{"segment":"1"}', '{"segment":true}', json.dumps({"segment": 2, "previous": 5}), json.dumps({"segment": 1, "previous": [A]}), json.dumps({"segment": 1, "previous": "x"})):
        with pytest.raises(ValueError):
            parse_header(bad)


def test_append_seal_and_read(spark, claims, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.open().folder is None and log.seal() is None and log.segments() == []
    log.append(some(claims, "b", "a"))
    log.append(some(claims, "b", "a"))  # the same bundle again
    assert len(log.open().bundles) >= 1 and log.head().count() == 2
    first = log.seal()
    log.append(some(claims, "c", day=2))
    second = log.seal()
    assert log.segments() == [first, second] and log.open().previous == second and not log.open().bundles
    rows = log.claims().orderBy("time").collect()
    assert [json.loads(r.value) for r in rows] == ["b", "a", "c"] and all(r.fault is None for r in rows)
    for digest, before in ((first, None), (second, first)):
        own = [r.line for r in rows if r.segment == digest]
        assert hashlib.sha256("".join(x + "\n" for x in (header(before), *own)).encode()).hexdigest() == digest
    assert all(hashlib.sha256(r.line.encode()).hexdigest() == r.cid for r in rows)


@pytest.fixture
def sealed(spark, claims, tmp_path):
    log = Log(spark, str(tmp_path))
    log.append(some(claims, "a"))
    first = log.seal()
    log.append(some(claims, "b", day=2))
    return log, first, tmp_path / "open"


def test_a_stopped_seal_reads_as_it_stands(sealed):
    log, first, open_ = sealed
    os.rename(open_ / first, open_ / f"{first}.sealing")
    assert log.open().previous == first and log.head().count() == 1  # nothing is decided
    os.rename(open_ / f"{first}.sealing", open_ / f"{first}.sealed-{B}")
    assert log.open().previous == B and log.head().count() == 1  # the record names a segment that is lost
    with pytest.raises(LookupError, match=B):
        log.segments()


def test_a_decided_seal_is_finished(sealed, claims, monkeypatch):
    log, first, open_ = sealed
    monkeypatch.setattr(Log, "_settle", lambda self, folder: folder)
    folder = log.seal()
    digest = folder.partition(".sealed-")[2]
    assert log.open().previous == first and log.head().count() == 1  # until then the record is the first segment and every bundle
    monkeypatch.undo()
    assert log.seal() == digest and log.segments() == [first, digest] and log.head().count() == 0


def test_two_open_segments_or_none_are_errors(sealed):
    log, first, open_ = sealed
    (open_ / "first").mkdir()
    with pytest.raises(ValueError, match="two open"):
        log.open()
    os.rmdir(open_ / "first")
    os.rename(open_ / first, open_.parent / "gone")
    with pytest.raises(LookupError):
        log.open()


def test_a_bad_line_is_told_with_its_number(sealed):
    log, first, _ = sealed
    where = log.root + f"/claims/{first}"
    name = next(n for n in os.listdir(where) if n.startswith("part-"))
    with open(f"{where}/{name}", "a") as f:
        f.write("{}\n")
    os.remove(f"{where}/.{name}.crc")  # the file system's own check
    with pytest.raises(ValueError, match=f"{first}, line 1: bytes"):
        log.claims([first])
    assert [r.number for r in log.claims([first], strict=False).where("fault is not null").collect()] == [3]


def test_a_copy_follows_the_log(spark, sealed, claims, tmp_path):
    log, first, _ = sealed
    copy = Index(log, str(tmp_path / "copy"))
    assert copy.catch_up() == [first] and copy.claims().count() == 2
    assert copy.catch_up() == []
    second = log.seal()
    assert copy.catch_up() == [second] and sorted(r.seq for r in copy.claims().collect()) == [0, 1]
    os.makedirs(tmp_path / f"copy/seq=7/segment={B}")
    assert copy.catch_up() == [first, second] and copy.claims().count() == 2  # it did not follow: folded again
    other = Log(spark, str(tmp_path / "other"))
    other.append(some(claims, "z"))
    other.seal()
    with pytest.raises(ValueError, match="another log"):
        Index(other, str(tmp_path / "copy")).catch_up()


def test_appending_beyond_the_rule_seals_first(spark, claims, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SEAL_BUNDLES", 1)
    log = Log(spark, str(tmp_path))
    log.append(some(claims, "a").coalesce(1))
    log.append(some(claims, "b", day=2).coalesce(1))
    assert len(log.segments()) == 1 and log.head().count() == 1


def test_audit(sealed, claims, spark):
    log, first, _ = sealed
    second = log.seal()
    assert log.audit() == {"segments": 2, "findings": [], "ends": ("first", None), "unreached": []}
    assert log.seal_checked() is None
    lone = log._write(spark.createDataFrame([('{"x":1}',)], "value string"), None, "made")
    os.rename(f"{log.root}/made", f"{log.root}/claims/{lone}")
    assert log.audit()["findings"] == [("broken", lone, 2)]
    with pytest.raises(ValueError, match="not sealed"):
        log.seal_checked()
    os.rename(f"{log.root}/claims/{first}", f"{log.root}/gone")
    found = log.audit()
    assert found["ends"] == ("missing", first) and ("missing", first, None) in found["findings"] and found["unreached"] == []
    os.rename(f"{log.root}/claims/{second}", f"{log.root}/claims/{B}")
    assert ("damaged", B, None) in log.audit()["findings"]


def test_rewrite_renames_from_the_first_change_on(spark, sealed, claims, tmp_path):
    log, first, _ = sealed
    second = log.seal()
    log.append(some(claims, "c", day=3))
    same = Log(spark, str(tmp_path / "same"))
    assert log.rewrite(same, lambda lines: lines) == {first: first, second: second} and same.segments() == [first, second] and same.head().count() == 1
    cut = Log(spark, str(tmp_path / "cut"))
    renamed = log.rewrite(cut, lambda lines: lines.where(~F.contains("value", F.lit('"b"'))))
    assert renamed[first] == first and renamed[second] != second and cut.segments() == [first, renamed[second]] and cut.audit()["findings"] == []
    assert [json.loads(r.value) for r in cut.claims().collect()] == ["a"] and [json.loads(r.value) for r in cut.head().collect()] == ["c"]


def test_a_log_without_one_chain_gets_one(spark, sealed, claims, tmp_path):
    log, first, _ = sealed
    second = log.seal()
    log.append(some(claims, "c", day=3))
    third = log.seal()
    os.rename(f"{log.root}/claims/{second}", f"{log.root}/gone")
    with pytest.raises(LookupError, match=second):
        log.segments()
    assert log.by_first_time() == [first, third]
    closed = Log(spark, str(tmp_path / "closed"))
    renamed = log.rewrite(closed, order=log.by_first_time())
    assert closed.segments() == [first, renamed[third]] and closed.audit()["findings"] == [] and closed.claims().count() == 2


def test_ingest_as_a_stream(spark, tmp_path):
    folder, log = tmp_path / "in", Log(spark, str(tmp_path / "archive"))
    (folder / "d").mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"same")
    (folder / "d" / "b.txt").write_bytes(b"same")
    run = lambda: ingest.ingest(spark, str(folder), log, str(tmp_path / "archive/content"), str(tmp_path / "memory"), str(tmp_path / "state"), "here", "0" * 8 + "-0000-0000-0000-" + "0" * 12, "2024-03-01T00:00:00Z").awaitTermination()
    run()
    digest = hashlib.sha256(b"same").hexdigest()
    assert (tmp_path / f"archive/content/{digest[:2]}/{digest}").read_bytes() == b"same"
    told = [(r.attribute, r.value) for r in log.head().collect()]
    assert sorted(v for a, v in told if a == "file:name") == ['"a.txt"', '"b.txt"'] and ("file:size", "4") in told and ("file:mime", '"text/plain"') in told
    (folder / "c.txt").write_bytes(b"same")
    run()
    run()
    told = [(r.attribute, r.value) for r in log.head().collect()]
    assert len([v for a, v in told if a == "file:name"]) == 3 and len([v for a, v in told if a == "file:size"]) == 1
    assert spark.read.parquet(str(tmp_path / "memory")).count() == 3
