"""A mail folder as a streaming source: messages above a resume point, under a validity mark.

A folder is a directory of ``<uid>.eml`` files with an optional ``VALIDITY`` file. The
offset is (validity, uid): when the mark changes, uids mean other messages and reading
starts anew. A server client has the same three operations and can take the place of
``Folder``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "uid bigint, validity bigint, content binary"


class Folder:
    """What a source asks of a mail folder."""

    def __init__(self, path: str):
        self.path = path

    def validity(self) -> int:
        try:
            with open(os.path.join(self.path, "VALIDITY")) as f:
                return int(f.read().strip() or 0)
        except FileNotFoundError:
            return 0

    def uids(self, above: int) -> list[int]:
        found = (name[:-4] for name in os.listdir(self.path) if name.endswith(".eml"))
        return sorted(int(n) for n in found if n.isdigit() and int(n) > above)

    def last(self) -> int:
        """The greatest uid, which a server tells without a listing."""
        return max((int(n[:-4]) for n in os.listdir(self.path) if n.endswith(".eml") and n[:-4].isdigit()), default=0)

    def fetch(self, uid: int) -> bytes | None:
        """The message, or None if it went away since it was listed."""
        try:
            with open(os.path.join(self.path, f"{uid}.eml"), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None


class Span(InputPartition):
    """Uids of one batch that one task fetches."""

    def __init__(self, validity: int, uids: list[int]):
        self.validity, self.uids = validity, uids


def _spans(validity: int, uids: list[int], size: int) -> list[Span]:
    return [Span(validity, uids[i : i + size]) for i in range(0, len(uids), size)] or [Span(validity, [])]


def _rows(folder: Folder, span: Span) -> Iterator[tuple]:
    for uid in span.uids:
        content = folder.fetch(uid)
        if content is not None:
            yield uid, span.validity, content


class _Reader(DataSourceReader):
    def __init__(self, folder: Folder, size: int):
        self.folder, self.size = folder, size

    def partitions(self):
        return _spans(self.folder.validity(), self.folder.uids(0), self.size)

    def read(self, partition):
        return _rows(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {"validity": self.folder.validity(), "uid": 0}

    def latestOffset(self) -> dict:
        return {"validity": self.folder.validity(), "uid": self.folder.last()}

    def partitions(self, start: dict, end: dict):
        above = start["uid"] if start["validity"] == end["validity"] else 0
        return _spans(end["validity"], [u for u in self.folder.uids(above) if u <= end["uid"]], self.size)

    def read(self, partition):
        return _rows(self.folder, partition)


class MailFolderSource(DataSource):
    """``spark.dataSource.register(MailFolderSource)``, then ``format("mailfolder").option("path", …)``."""

    @classmethod
    def name(cls) -> str:
        return "mailfolder"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> tuple[Folder, int]:
        return Folder(self.options["path"]), int(self.options.get("perTask", "100"))

    def reader(self, schema):
        return _Reader(*self._folder())

    def streamReader(self, schema):
        return _StreamReader(*self._folder())
