"""A reader's copy of the log: claims in Parquet, a folder a sealed segment, brought up as segments are sealed.

The copy keeps no state but its folders, ``seq=<place in the chain>/segment=<digest>``. Catching
up walks the chain back from its end to the last segment folded, reading headers only, and
folds what is behind it, and the open segment anew. If the walk does not meet that
segment, the copy does not follow this log: with other segments of this log in it, it is
emptied and folded again; without any, it is another log's copy and refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimwright.sources.segments import Log

HEAD = "head"
FIELDS = "subject string, attribute string, value string, time string, source string, run string, retracts array<string>, cid string, position bigint"
_NAMES = [c.split()[0] for c in FIELDS.split(", ")]


class Index:
    def __init__(self, log: Log, path: str):
        self.log, self.spark, self.path = log, log.spark, path.rstrip("/")

    def _folded(self) -> dict[str, int]:
        """Segment to its place, of those folded."""
        where = self.log._path(f"{self.path}/seq=*/segment=*")
        found = (s.getPath() for s in self.log._fs.globStatus(where) or [])
        pairs = ((p.getName().partition("=")[2], int(p.getParent().getName().partition("=")[2])) for p in found)
        return {segment: seq for segment, seq in pairs if segment != HEAD}

    def catch_up(self) -> list[str]:
        """Folds what is new; the segments that were read."""
        have = self._folded()
        last = max(have, key=have.get, default=None)
        new, met = self.log.back_to(last)
        if not met:
            if not set(have) & set(new):
                raise ValueError(f"{self.path} is a copy of another log")
            self.log._fs.delete(self.log._path(self.path), True)
            have, last = {}, None
        start = have[last] + 1 if last else 0
        if new:
            place = F.map_from_arrays(F.array(*map(F.lit, new)), F.array(*[F.lit(start + k) for k in range(len(new))]))
            rows = self.log.claims(new).withColumns({"seq": place[F.col("segment")].cast("bigint"), "position": (F.col("number") - 2).cast("bigint")})
            self._write(rows)
        head = self.log.head().where(F.col("fault").isNull())
        for n in self.log._fs.globStatus(self.log._path(f"{self.path}/seq=*/segment={HEAD}")) or []:
            self.log._fs.delete(n.getPath(), True)
        self._write(head.withColumns({"position": F.lit(None).cast("bigint"), "seq": F.lit(start + len(new)).cast("bigint"), "segment": F.lit(HEAD)}))
        return new

    def _write(self, rows: DataFrame) -> None:
        out = rows.select(*_NAMES, "seq", "segment").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("seq", "segment").parquet(self.path)

    def claims(self) -> DataFrame:
        """The claims folded so far, those of the open segment last."""
        return self.spark.read.schema(FIELDS + ", seq bigint, segment string").parquet(self.path).drop("segment")
