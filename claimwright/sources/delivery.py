"""Files written out: exports that never overwrite, copies for another archive, and the care of temporary files.

Folders are those of a file system that all executors mount. Each task writes the files of
its rows under a name of its own first and then links them into place, so a task that runs
again meets its own work as done.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimwright.sources.archive import Mark

_ALGORITHM = {64: "sha256", 96: "sha384", 128: "sha512"}


def _hashed(path: str, like: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, _ALGORITHM[len(like)]).hexdigest()


def _placed(destination: str, target: str, digest: str, content: bytes | None) -> str:
    where = os.path.realpath(os.path.join(destination, target))
    if not where.startswith(os.path.realpath(destination) + os.sep):
        return "failed: outside the destination"
    if os.path.lexists(where):
        try:
            return "standing" if _hashed(where, digest) == digest else "failed: a different file stands here, left untouched"
        except OSError as e:
            return f"failed: {e.strerror}"
    if content is None:
        return "failed: its content is missing"
    own = f"{where}.{uuid.uuid4().hex}.part"
    try:
        os.makedirs(os.path.dirname(where), exist_ok=True)
        with open(own, "xb") as f:
            f.write(content)
        os.link(own, where)  # fails where another stands, unlike a rename
        return "exported"
    except FileExistsError:
        return "standing" if _hashed(where, digest) == digest else "failed: a different file stands here, left untouched"
    except OSError as e:
        return f"failed: {e.strerror}"
    finally:
        if os.path.exists(own):
            os.remove(own)


def deliver(plan: DataFrame, contents: DataFrame, destination: str) -> DataFrame:
    """Writes the files of *plan* (subject, target) with the bytes of *contents* (subject, content) below *destination*.

    Rows (subject, target, outcome): ``exported``, ``standing`` where the same bytes are there already, or
    ``failed`` with the reason; another file that stands at a target is never touched. The rows
    are the work: it is done as they are read.
    """
    rows = plan.select("subject", "target").join(contents.select("subject", "content"), "subject", "left")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [_placed(destination, t, s, None if c is None else bytes(c)) for s, t, c in zip(part["subject"], part["target"], part["content"])]
            yield pd.DataFrame({"subject": part["subject"], "target": part["target"], "outcome": done})

    return rows.mapInPandas(write, "subject string, target string, outcome string")


def copied(plan: DataFrame, contents: DataFrame, target: str, depths: dict[str, int]) -> DataFrame:
    """Copies what ``copy_plan`` names (kind, digest) into the stores of the archive at *target*, sharded as its mark says."""
    kind = F.when(F.col("kind") == "segment", "claims").otherwise(F.coalesce("store", F.lit("content")))
    rows = plan.join(contents.select(F.col("subject").alias("digest"), "store"), "digest", "left").withColumn("store", kind)
    depth = F.coalesce(F.create_map(*[F.lit(x) for pair in depths.items() for x in pair])[F.col("store")], F.lit(0))
    shards = F.transform(F.sequence(F.lit(1), depth), lambda n: F.substr("digest", n * 2 - 1, F.lit(2)))
    path = F.concat_ws("/", "store", F.array_join(F.when(depth > 0, shards).otherwise(F.array().cast("array<string>")), "/"), "digest")
    where = F.regexp_replace(path, "//+", "/")
    return deliver(rows.select(F.col("digest").alias("subject"), where.alias("target")), contents, target)


def target_state(root: str, mark: Mark) -> tuple[bool, str | None]:
    """(whether the mark is there, the last segment) of an archive that is to be copied to.

    It must have this mark or none, and at most one open segment, which holds no claims and is not being sealed.
    """
    marked, path = False, os.path.join(root, "FORMAT")
    if os.path.exists(path):
        with open(path) as f:
            if Mark.read(f.readline()) != mark:
                raise ValueError(f"{root}: another mark")
        marked = True
    folder = os.path.join(root, "open")
    names = os.listdir(folder) if os.path.isdir(folder) else []
    if any(".seal" in n for n in names):
        raise ValueError(f"{root}: the open segment is being sealed")
    if len(names) > 1:
        raise ValueError(f"{root}: {len(names)} open segments")
    if names and any(n.startswith("bundle=") or n.endswith(".jsonl") for n in os.listdir(os.path.join(folder, names[0]))):
        raise ValueError(f"{root}: the open segment holds claims")
    if names and names[0] != "first" and not re.fullmatch("[0-9a-f]{64,128}", names[0]):
        raise ValueError(f"{root}: {names[0]} names no segment")
    return marked, names[0] if names and names[0] != "first" else None


def tidy(folders: list[str], age: float | None = 86_400, dry_run: bool = False) -> dict[str, int]:
    """Removes the temporary files of stores, ``<number>-<number>.tmp``, that are older than *age* seconds: counts of removed, bytes and young."""
    out = {"removed": 0, "bytes": 0, "young": 0}
    for folder in folders:
        for entry in os.scandir(folder) if os.path.isdir(folder) else ():
            if not re.fullmatch(r"[0-9]+-[0-9]+\.tmp", entry.name) or not entry.is_file(follow_symlinks=False):
                continue
            state = entry.stat(follow_symlinks=False)
            if age is not None and state.st_mtime > time.time() - age:
                out["young"] += 1
                continue
            if not dry_run:
                os.remove(entry.path)
            out["removed"] += 1
            out["bytes"] += state.st_size
    return out
