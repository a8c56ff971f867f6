"""The log on a shared file system: appended bundles, sealed segments, the chain.

``claims/<digest>/`` holds a sealed segment as one text file: a header line that names the
segment before it, then claim lines by (time, line). ``open/<S>/`` is the open segment behind
the sealed segment S (``first`` before any seal): a folder a bundle, ``bundle=<digest>``, named
by the digest of its lines. Appending the same claims again writes the same bundles.

Sealing goes by renames, each atomic, so of several writers one wins each step:
``open/<S>`` to ``<S>.sealing``; the segment's bytes are written there; ``<S>.sealing`` to
``<S>.sealed-<S'>``; the bytes go to ``claims/<S'>``; what the segment holds is deleted and the
folder becomes ``open/<S'>``. A reader of a seal that stopped between two steps sees the
record as it then stands (``OpenSegment``), and ``seal`` finishes it first.

A segment is bounded by the seal rule (``SEAL_BUNDLES`` of at most ``BUNDLE_LINES`` lines), so
one task may sort, hash and write it; segments are read in parallel.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimwright.functions.grammar import claim_line, valid_time
from claimwright.sources.log import HEADER, header, parse_lines

BUNDLE_LINES, SEAL_BUNDLES, GENERATION = 1000, 1000, 1
FIRST = "first"
_DIGEST = r"(?:[0-9a-f]{128}|[0-9a-f]{96}|[0-9a-f]{64})"


def parse_header(line: str) -> str | None:
    """The segment that a header names as its predecessor.

    The generation is judged before all else; members that are not known are skipped; a
    predecessor is one digest, never a list.
    """
    try:
        raw = json.loads(line)
    except ValueError:
        raw = None
    if not isinstance(raw, dict) or type(raw.get(HEADER)) is not int:
        raise ValueError(f"no segment header: {line[:100]}")
    if raw[HEADER] != GENERATION:
        raise ValueError(f"generation {raw[HEADER]} is not {GENERATION}")
    previous = raw.get("previous")
    if isinstance(previous, list):
        raise ValueError("a header names one predecessor, not a list")
    if previous is not None and not (isinstance(previous, str) and re.fullmatch(_DIGEST, previous.lower())):
        raise ValueError(f"no segment header: {line[:100]}")
    return previous.lower() if previous else None


@dataclass(frozen=True)
class OpenSegment:
    """The open segment as a reader sees it: its folder, the sealed segment before it, and its bundles."""

    folder: str | None
    previous: str | None
    bundles: tuple[str, ...]


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{path}"))

    def _rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}"))

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{path}"), True)

    # -- reading

    def sealed(self) -> list[str]:
        """The digests in the claims store, in no order."""
        return [n for n in self._names("claims") if re.fullmatch(_DIGEST, n)]

    def open(self) -> OpenSegment:
        """The open segment; without one over sealed segments, or with two, an error."""
        names = self._names("open")
        plain = [n for n in names if n == FIRST or re.fullmatch(_DIGEST, n)]
        pending = [n for n in names if ".seal" in n]
        if len(plain) > 1 or (not plain and len(pending) > 1):
            raise ValueError(f"two open segments: {', '.join(plain or pending)}")
        if plain:
            return OpenSegment(plain[0], None if plain[0] == FIRST else plain[0], self._bundles(plain[0]))
        if not pending:
            if self.sealed():
                raise LookupError(f"{self.root}: the open segment over sealed segments is lost")
            return OpenSegment(None, None, ())
        folder = pending[0]
        before = folder.split(".")[0]
        before = None if before == FIRST else before
        decided = folder.partition(".sealed-")[2] or None
        if decided and self._exists(f"claims/{decided}"):
            held = {r[0] for r in self._contents([decided]).select("line").collect()}  # of bounded size by the seal rule
            left = [b for b in self._bundles(folder) if not {r.value for r in self._lines(folder, [b]).collect()} <= held]
            return OpenSegment(folder, decided, tuple(left))
        if decided and not any(n.startswith("segment-") for n in self._names(f"open/{folder}")):
            return OpenSegment(folder, decided, self._bundles(folder))  # the record names a segment that is lost
        return OpenSegment(folder, before, self._bundles(folder))

    def _bundles(self, folder: str) -> tuple[str, ...]:
        return tuple(n.partition("=")[2] for n in self._names(f"open/{folder}") if n.startswith("bundle="))

    def _lines(self, folder: str, bundles: list[str] | tuple[str, ...]) -> DataFrame:
        if not bundles:
            return self.spark.createDataFrame([], "value string")
        return self.spark.read.text([f"{self.root}/open/{folder}/bundle={b}" for b in bundles])

    def head(self) -> DataFrame:
        """The claims of the open segment, with ``fault`` where a line is none; each line once."""
        now = self.open()
        return parse_lines(self._lines(now.folder, now.bundles).distinct())

    def _contents(self, digests: list[str]) -> DataFrame:
        """Rows (segment, sound, header, number, line) of sealed segments; numbers are those of the file, the header's being 1."""
        if not digests:
            return self.spark.createDataFrame([], "segment string, sound boolean, header string, number int, line string")
        text = self.spark.read.text([f"{self.root}/claims/{d}" for d in digests], wholetext=True)
        segment = F.regexp_extract(F.input_file_name(), r"/claims/([0-9a-f]+)/[^/]*\z", 1)
        rows = text.select(segment.alias("segment"), F.col("value"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines"))
        sound = F.sha2("value", 256) == F.col("segment")
        rows = rows.select("segment", sound.alias("sound"), F.col("lines")[0].alias("header"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("rest"))
        return rows.select("segment", "sound", "header", F.posexplode_outer("rest").alias("at", "line")).select("segment", "sound", "header", (F.col("at") + 2).alias("number"), "line")

    def previous(self, digest: str) -> str | None:
        """The segment that a sealed one names before it; of its file only the first line is read."""
        folder = f"claims/{digest}"
        parts = [n for n in self._names(folder) if n.startswith("part-")]
        if not parts:
            raise LookupError(f"segment {digest} is missing")
        io = self.spark.sparkContext._jvm.java.io
        reader = io.BufferedReader(io.InputStreamReader(self._fs.open(self._path(f"{self.root}/{folder}/{parts[0]}")), "UTF-8"))
        try:
            return parse_header(reader.readLine() or "")
        finally:
            reader.close()

    def back_to(self, known: str | None = None) -> tuple[list[str], bool]:
        """The segments behind *known*, first to last, and whether the walk back from the last met it.

        A missing link and a cycle are errors that name who named it.
        """
        out, at, by = [], self.open().previous, "the open segment"
        while at is not None and at != known:
            if at in out:
                raise ValueError(f"segment {at} comes twice")
            try:
                before = self.previous(at)
            except LookupError:
                raise LookupError(f"segment {at} is missing; {by} names it") from None
            out.append(at)
            at, by = before, f"segment {at}"
        return out[::-1], at == known

    def segments(self) -> list[str]:
        """The chain from the first segment to the last."""
        return self.back_to()[0]

    def claims(self, digests: list[str] | None = None, strict: bool = True) -> DataFrame:
        """The claims of sealed segments (all of the chain) with ``segment``, ``number`` and ``fault``.

        Strictly, the first bad line or unsound segment is an error with its place.
        """
        digests = self.segments() if digests is None else digests
        rows = self._contents(digests)
        lines = rows.where(F.col("line").isNotNull())
        parsed = parse_lines(lines.withColumnRenamed("line", "value"), keep=("segment", "number", "sound"))
        if strict:
            bad = rows.where(~F.col("sound")).select("segment", F.lit(1).alias("number"), F.lit("bytes of another digest").alias("fault"))
            bad = bad.unionByName(parsed.where(F.col("fault").isNotNull()).select("segment", "number", "fault")).orderBy("segment", "number").first()
            if bad:
                raise ValueError(f"segment {bad.segment}, line {bad.number}: {bad.fault}")
        return parsed.drop("sound")

    # -- writing

    def append(self, claims: DataFrame) -> None:
        """Appends *claims* as bundles; the open segment is sealed first where it has enough of them."""
        if len(self.open().bundles) >= SEAL_BUNDLES or ".seal" in (self.open().folder or ""):
            self.seal()
        folder = self.open().folder or FIRST
        bad = claims.where(~F.coalesce(valid_time(F.col("time")), F.lit(False))).limit(1).count()
        if bad:
            raise ValueError("a claim's time is not of the strict form")
        self._bundle(claims.select("time", claim_line().alias("line")), folder)

    def _bundle(self, rows: DataFrame, folder: str) -> None:
        """Writes the lines of *rows* (time, line) as bundles of an open segment."""
        lines = rows.sortWithinPartitions("time", "line").select("line")

        def bundled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[str] = []

            def cut(own: list[str]) -> pd.DataFrame:
                name = hashlib.sha256("".join(x + "\n" for x in own).encode()).hexdigest()
                return pd.DataFrame({"bundle": name, "n": range(len(own)), "line": own})

            for part in parts:
                held += part["line"].tolist()
                while len(held) >= BUNDLE_LINES:
                    yield cut(held[:BUNDLE_LINES])
                    held = held[BUNDLE_LINES:]
            if held:
                yield cut(held)

        rows = lines.mapInPandas(bundled, "bundle string, n int, line string").sortWithinPartitions("bundle", "n")
        out = rows.select("line", "bundle").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bundle").text(f"{self.root}/open/{folder}")

    def seal(self) -> str | None:
        """Seals up to ``SEAL_BUNDLES`` bundles of the open segment; the digest of the new segment, or None if there is none."""
        now = self.open()
        if now.folder and ".sealed-" in now.folder:
            return self._settle(now.folder)
        if not now.bundles:
            return None
        name = now.previous or FIRST
        if now.folder == name and not self._rename(f"open/{name}", f"open/{name}.sealing"):
            raise RuntimeError("another writer is sealing")
        folder = f"{name}.sealing"
        digest = self._write(self._lines(folder, now.bundles[:SEAL_BUNDLES]).distinct(), now.previous, f"open/{folder}/segment-{uuid.uuid4().hex}")
        if not self._rename(f"open/{folder}", f"open/{name}.sealed-{digest}"):
            raise RuntimeError("another writer sealed first")
        return self._settle(f"{name}.sealed-{digest}")

    def _write(self, lines: DataFrame, previous: str | None, path: str) -> str:
        """Writes the segment of *lines* (value) behind *previous* to *path*; its digest. One task, of a size that the seal rule bounds."""
        head = self.spark.createDataFrame([(0, "", header(previous))], "kind int, time string, value string")
        rows = head.unionByName(lines.select(F.lit(1).alias("kind"), F.get_json_object("value", "$.time").alias("time"), "value"))
        rows.repartition(1).sortWithinPartitions("kind", "time", "value").select("value").write.text(f"{self.root}/{path}")
        return self._digest(path)

    def _digest(self, path: str) -> str:
        return self.spark.read.text(f"{self.root}/{path}", wholetext=True).select(F.sha2("value", 256)).first()[0]

    def seal_checked(self) -> str | None:
        """Seals if an audit finds nothing, else an error that names the first finding."""
        found = self.audit()
        if found["findings"]:
            raise ValueError(f"not sealed: {found['findings'][0]}")
        return self.seal()

    def audit(self) -> dict:
        """What a reader of the whole log meets: ``segments``, ``findings`` (kind, segment, line), where the walk back ``ends``, and ``unreached`` segments.

        The walk ends at the first segment, without a head, at one that is missing, or blocked by one that
        cannot be read; only a whole walk tells what it did not reach.
        """
        sealed = self.sealed()
        rows = self._contents(sealed)
        heads = {r.segment: r for r in rows.select("segment", "sound", "header").distinct().collect()}  # a row a segment
        first_bad = parse_lines(rows.where(F.col("line").isNotNull() & F.col("sound")).withColumnRenamed("line", "value"), keep=("segment", "number")).where(F.col("fault").isNotNull())
        broken = {r.segment: r.number for r in first_bad.groupBy("segment").agg(F.min("number").alias("number")).collect()}
        findings, previous = [], {}
        for name in sealed:
            if not heads[name].sound:
                findings.append(("damaged", name, None))
                continue
            try:
                before = parse_header(heads[name].header)
            except ValueError:
                findings.append(("broken", name, 1))
                continue
            if name in broken:
                findings.append(("broken", name, broken[name]))
            else:
                previous[name] = before
        try:
            at = self.open().previous
        except (LookupError, ValueError) as e:
            return {"segments": len(sealed), "findings": [*findings, ("no head", str(e), None)], "ends": ("no head", None), "unreached": []}
        seen, ends = [], ("first", None)
        while at is not None:
            if at not in previous:
                ends = ("blocked", at) if at in heads else ("missing", at)
                findings += [("missing", at, None)] * (ends[0] == "missing")
                break
            if at in seen:
                raise ValueError(f"segment {at} comes twice")
            seen.append(at)
            at = previous[at]
        return {"segments": len(sealed), "findings": findings, "ends": ends, "unreached": sorted(set(previous) - set(seen)) if ends[0] == "first" else []}

    def by_first_time(self) -> list[str]:
        """All sealed segments by their first claim's time: the order for a log whose headers give none."""
        rows = self._contents(self.sealed())
        first = rows.groupBy("segment").agg(F.min(F.get_json_object("line", "$.time")).alias("first"))
        return [r.segment for r in first.orderBy("first", "segment").collect()]  # a row a segment

    def rewrite(self, target: Log, edit: Callable[[DataFrame], DataFrame] = lambda lines: lines, order: list[str] | None = None) -> dict[str, str]:
        """Writes the chain into the empty log *target* with *edit* (of lines, value) applied; old segment to new name.

        With *order*, the segments that it names follow each other in the new chain, whatever theirs said:
        so gaps are closed, and a log without one chain gets one.

        Segments before the first that changes keep their names; all behind it get new ones, since each names
        the one before. The open segment is edited too. Segments are written one after the other, as the chain demands.
        """
        renamed: dict[str, str] = {}
        before: str | None = None
        for name in self.segments() if order is None else order:
            old = self._contents([name]).where(F.col("line").isNotNull()).select(F.col("line").alias("value"))
            made = f"open/.{uuid.uuid4().hex}"
            renamed[name] = target._write(edit(old), before, made)
            target._fs.mkdirs(target._path(f"{target.root}/claims"))
            target._rename(made, f"claims/{renamed[name]}")
            before = renamed[name]
        now = self.open()
        if now.bundles:
            lines = edit(self._lines(now.folder, now.bundles).distinct())
            target._bundle(lines.select(F.get_json_object("value", "$.time").alias("time"), F.col("value").alias("line")), before or FIRST)
        else:
            target._fs.mkdirs(target._path(f"{target.root}/open/{before or FIRST}"))
        return renamed

    def _settle(self, folder: str) -> str:
        """The last two steps of a seal: the segment to the claims store, its bundles deleted, the folder open again."""
        digest = folder.partition(".sealed-")[2]
        if not self._exists(f"claims/{digest}"):
            for n in self._names(f"open/{folder}"):
                if n.startswith("segment-") and self._digest(f"open/{folder}/{n}") == digest:
                    self._fs.mkdirs(self._path(f"{self.root}/claims"))
                    self._rename(f"open/{folder}/{n}", f"claims/{digest}")
                    break
        left = set(self.open().bundles)
        for n in self._names(f"open/{folder}"):
            if n.startswith("segment-") or n.partition("=")[2] not in left:
                self._delete(f"open/{folder}/{n}")
        self._rename(f"open/{folder}", f"open/{digest}")
        return digest
