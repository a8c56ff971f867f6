"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Prefix dynamic programming. A sequence of tokens is what BPE gives for its bytes exactly
if each two neighbours are, by themselves, what BPE gives for their joined bytes. So each
byte prefix of a piece has exactly one valid last token: the token ending there that fits
behind the last token of the prefix before it. ``PrefixTable`` stores that token for each
prefix. Bytes can then be appended without looking back further than the longest token,
and after an edit the table is computed anew only until it agrees with the old one again.
Time is linear in the bytes, also for a piece of any length without a break.

Texts are cut into pieces by the vocabulary's own pattern first; tables never cross a
piece. The ids of short pieces are remembered by each worker, in a memory of bounded
size that is emptied when full; that changes time, never a result.

Defined results: a null and an empty text have the empty list; spellings of special
tokens are ordinary text; repeated ids keep their rows; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary lies on every executor; a parameter of all operators here.
VOCABULARY = os.environ.get("CLAIMWRIGHT_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

# The white space of Unicode, and the pattern that cuts text into pieces before the merges.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for ASCII text, where a class of 128 characters is enough.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Pieces of up to so many characters are remembered, and so many of them.
SHORT, REMEMBERED = 48, 200_000


class Vocabulary:
    """Tokens by rank, and the relation of tokens that may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self.ending = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if self.merged(token) == [rank]:
                self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The ids of *data* by the definition: join the pair of least rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether *right* may stand behind *left*."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class PrefixTable:
    """A piece's bytes with the one valid last token of each byte prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", array("i")
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds *data* at the end; no stored prefix changes."""
        start = len(self.data)
        self.data += data
        self.last.extend([-1]) if not self.last else None
        self._fill(start)

    def _fill(self, start: int, old: array | None = None, shift: int = 0) -> None:
        """Stores the last tokens of the prefixes longer than *start*.

        With *old*, the table before an edit whose bytes from *start* on stand unchanged
        *shift* places later: stops once so many prefixes in a row agree that all later ones do.
        """
        v, last, agreed = self.vocabulary, self.last, 0
        low = max(0, start - v.longest)
        by_end: dict[int, list[tuple[int, int]]] = {}
        at = start
        stop = len(self.data)
        block = stop if old is None else min(stop, start + 256)
        while at < stop:
            by_end.clear()
            for end, token in v.ending.iter(self.data[low:block].decode("latin-1")):
                if low + end >= at:
                    by_end.setdefault(low + end, []).append(token)
            for end in range(at, block):
                for rank, size in by_end[end]:
                    first = end + 1 - size
                    if first == 0 or (last[first] >= 0 and v.fits(last[first], rank)):
                        last.append(rank)
                        break
                else:  # cannot happen with a vocabulary that holds all bytes
                    raise ValueError("no token ends here")
                if old is not None:
                    before = end + 1 - shift
                    agreed = agreed + 1 if 0 < before < len(old) and old[before] == last[-1] else 0
                    if agreed > v.longest:
                        last.extend(old[before + 1 :])
                        return
            at, low = block, max(0, block - v.longest)
            block = min(stop, block + 256)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Puts *data* in place of the bytes *start* to *end*, encoding anew only near the edit."""
        old, tail = self.last, self.data[end:]
        self.data = self.data[:start] + data
        self.last = old[: start + 1]
        self._fill(start)
        edge = len(self.data)
        self.data += tail
        self._fill(edge, old, edge - end)

    def ids(self) -> list[int]:
        """The ids of all the bytes."""
        out, at = [], len(self.data)
        while at:
            rank = self.last[at]
            out.append(rank)
            at -= len(self.vocabulary.bytes_of[rank])
        return out[::-1]


class _Memory(dict):
    """Piece to ids, for short pieces; computed where missing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        rank = self.vocabulary.ranks.get(data)
        ids = (rank,) if rank is not None and len(data) < 3 else tuple(PrefixTable(self.vocabulary, data).ids())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.ids_of = _Memory(self.vocabulary)
        self._ascii, self._any = re.compile(ASCII_PIECES).findall, regex.compile(PIECES).findall

    def pieces(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.pieces(text)))) if text else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of the vocabulary file *path*, once a worker."""
    return Encoder(path)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids) of each row of *documents*. Rows stay where they are: there is no shuffle."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        get, pieces = e.ids_of.__getitem__, e.pieces
        for batch in rows:
            flat, ends = array("i"), [0]
            for t in batch.column(1):
                t = t.as_py()
                if t:
                    flat.extend(chain.from_iterable(map(get, pieces(t))))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"])

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, tokens)."""
    return encode(documents, vocabulary).select("doc_id", F.size("ids").alias("tokens"))
