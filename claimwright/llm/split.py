"""Oversized texts cut into pieces at natural boundaries (problem 9).

Agglomerative merging. A text over its limit is cut into atoms: at blank lines, line
ends, sentence ends; an atom over the limit at words; a word over the limit between
characters. Adjacent atoms stand in a heap, weakest boundary first (then smaller sum,
then earlier place), and are merged while their sum and the overlap fit the limit.
Boundaries that are left, the strongest ones, part the pieces.

Sizes are ids of the byte-level vocabulary. A cut stands only where the ids of the whole
text are the ids of the parts, so sizes add up and a piece has the same ids by itself.
(Two pieces of white space in a row would join at an end; an apostrophe at a beginning
may bind anew; a token may begin inside a character. No cut stands there.)

Each piece after the first begins with exactly the last ``overlap_tokens`` ids of the one
before. Where an overlap of that size would begin inside a character, or at an apostrophe
that binds anew, the boundary is *unclean*. Unclean boundaries of any strength are merged
away first, and cuts at words and between characters take their place where there are
clean ones. Only where no clean cut is within reach does an unclean one stay: its overlap
then begins at the character's first token, and ``beyond`` counts the tokens more.

Defined results: texts within the limit, null texts, and texts of a null or unknown
source are not oversized and give no piece; a source with several limits has its least,
with that row's overlap; a null limit is none, a null or negative overlap is 0. A text whose
limit cannot hold the overlap and one of its characters is refused: it gives one row,
piece 0, that is null in all other columns.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimwright.llm.encode import VOCABULARY, Encoder, encoder

#: Strength of boundaries, from the strongest.
BLANK_LINE, LINE, SENTENCE, WORD, CHARACTER = 4, 3, 2, 1, 0
_ENDS = tuple(".!?。！？…؟।")
_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_CLOSING = "\"')]}»”’"


def _strength(piece: str) -> int:
    """What a piece of the pattern says about the boundary behind it."""
    if any(c in piece for c in _BREAKS):
        return LINE
    return SENTENCE if piece.rstrip(_CLOSING).endswith(_ENDS) else 0


class _Marks(dict):
    """Piece to its strength, computed where missing and remembered for short pieces."""

    def __missing__(self, piece: str) -> int:
        mark = _strength(piece)
        if len(piece) < 64:
            if len(self) > 200_000:
                self.clear()
            self[piece] = mark
        return mark


class Splitter:
    """Texts to token ranges, with one encoder's memory."""

    def __init__(self, e: Encoder):
        self.e, self.bytes_of = e, e.vocabulary.bytes_of
        self.marks = _Marks()

    def boundaries(self, pieces: list[str]) -> list[tuple[int, int]]:
        """(index of the first piece behind it, strength) of the natural boundaries of a text."""
        out, k, n = [], 0, len(pieces)
        at = [i for i, m in enumerate(map(self.marks.__getitem__, pieces)) if m]
        while k < len(at):
            i = at[k]
            k += 1
            if self.marks[pieces[i]] == LINE:
                first = i - 1 if pieces[i - 1].isspace() and i else i  # a run of white space is one or two pieces
                last = i + 1 if i + 1 < n and pieces[i + 1].isspace() else i
                run = "".join(pieces[first : last + 1])
                while k < len(at) and at[k] <= last:
                    k += 1
                # Behind the first: the second would join it if it stood at an end.
                out.append((first + 1, BLANK_LINE if len(run.splitlines()) > 1 else LINE))
            elif i + 1 < n and (pieces[i + 1][0].isspace() or pieces[i].rstrip(_CLOSING)[-1:] in "。！？"):
                if not pieces[i + 1].isspace() or not self.marks[pieces[i + 1]]:
                    out.append((i + 1, SENTENCE))
        return [(b, s) for b, s in out if 0 < b < n]

    def split(self, text: str, limit: int, overlap: int) -> tuple[list[int], list[tuple[int, int, int]] | None]:
        """The ids of *text* and its pieces (first id, first id behind the overlap, end).

        No piece if the text fits; None for them if the limit cannot hold the overlap and a character.
        """
        pieces = self.e.pieces(text)
        coded = list(map(self.e.ids_of.__getitem__, pieces))
        ends = list(accumulate(map(len, coded), initial=0))
        ids = list(chain.from_iterable(coded))
        if len(ids) <= limit:
            return ids, []
        overlap = max(0, overlap)
        return ids, _Cuts(self, pieces, ids, ends, limit, overlap).pieces() if overlap < limit else None


class _Cuts:
    """One oversized text: where it may be cut, and how."""

    def __init__(self, splitter: Splitter, pieces: list[str], ids: list[int], ends: list[int], limit: int, overlap: int):
        self.s, self.words, self.ids, self.ends, self.limit, self.overlap = splitter, pieces, ids, ends, limit, overlap
        self.total = ends[-1]
        self.strengths = {ends[b]: s for b, s in splitter.boundaries(pieces)}
        self.starts: dict[int, int] = {}

    def begins(self, at: int) -> bool:
        """Whether the text from token *at* on has, by itself, the ids that follow."""
        i = bisect_right(self.ends, at) - 1
        if self.ends[i] == at:
            return True
        token = self.s.bytes_of[self.ids[at]]
        if token[0] & 0xC0 == 0x80:
            return False
        if not token.startswith(b"'"):
            return True
        rest = b"".join(map(self.s.bytes_of.__getitem__, self.ids[at : self.ends[i + 1]])).decode("utf-8", "replace")
        return self.s.e.pieces(rest + "".join(self.words[i + 1 : i + 2])[:4])[0] == rest

    def parts(self, at: int) -> bool:
        """Whether a cut may stand before token *at*."""
        i = bisect_right(self.ends, at) - 1
        if self.ends[i] == at:
            return not (i > 1 and self.words[i - 1].isspace() and self.words[i - 2].isspace())
        if not self.begins(at):
            return False
        if i and self.words[i - 1].isspace():
            return not b"".join(map(self.s.bytes_of.__getitem__, self.ids[self.ends[i] : at])).decode("utf-8", "replace").isspace()
        return True

    def start(self, cut: int) -> int:
        """Where the piece behind *cut* begins, overlap included."""
        at = self.starts.get(cut)
        if at is None:
            at = max(0, cut - self.overlap)
            while not self.begins(at):
                at -= 1
            self.starts[cut] = at
        return at

    def clean(self, cut: int) -> bool:
        return cut <= self.overlap or self.start(cut) == cut - self.overlap

    def _fits(self, a: int, b: int) -> bool:
        return b - (self.start(a) if a else 0) <= self.limit

    def _stepped(self, a: int, b: int) -> list[int] | None:
        """Cuts that part tokens *a* to *b* as far apart as possible, clean ones before others; None if none does."""
        out = []
        while not self._fits(a, b):
            last = min((self.start(a) if a else 0) + self.limit, b - 1)
            allowed = [c for c in range(last, a, -1) if self.parts(c)]
            best = next((c for c in allowed if self.clean(c)), None)
            if best is None and allowed:
                edges = set(self.ends[bisect_right(self.ends, a) : bisect_right(self.ends, last)])
                best = max(allowed, key=lambda c: (self.strengths.get(c, WORD if c in edges else CHARACTER), c))
            if best is None:
                return None
            out.append(best)
            a = best
        return out

    def pieces(self) -> list[tuple[int, int, int]] | None:
        places = [0, *(c for c in sorted(self.strengths) if self.clean(c) and self.parts(c)), self.total]
        atoms = [0]
        for a, b in zip(places, places[1:]):
            if not self._fits(a, b):
                inner = self.ends[bisect_right(self.ends, a) : bisect_right(self.ends, b - 1)]
                fine = [a, *(c for c in inner if self.clean(c) and self.parts(c)), b]
                for x, y in zip(fine, fine[1:]):
                    steps = [] if self._fits(x, y) else self._stepped(x, y)
                    if steps is None:
                        return None
                    atoms += steps + [y]
            else:
                atoms.append(b)
        kept = self._merged(atoms)
        out, before = [], 0
        for a, b in zip(kept, kept[1:]):
            before = max(before, self.start(a)) if a else 0
            out.append((before, a, b))
        return out

    def _merged(self, places: list[int]) -> list[int]:
        """The boundaries left when the weakest have been merged away, as far as the sums fit."""
        n = len(places) - 1  # segment k is places[k] to places[k + 1]; boundary k parts k - 1 and k
        start, end = places[:-1], places[1:]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        known = self.strengths.get
        edges = set(self.ends) if any(known(c) is None for c in start[1:]) else ()  # only cuts at words and characters need them
        strength = [(self.clean(c), WORD if (s := known(c)) is None and c in edges else s or CHARACTER) for c in start]

        def pair(right: int):
            return strength[right], end[right] - start[before[right]], right

        heap = [pair(k) for k in range(1, n)]
        heapq.heapify(heap)
        while heap:
            _, size, right = heapq.heappop(heap)
            if not alive[right] or pair(right)[1] != size:
                continue
            left = before[right]
            if not self._fits(start[left], end[right]):
                continue
            alive[right] = False
            end[left], after[left] = end[right], after[right]
            if after[right] < n:
                before[after[right]] = left
                heapq.heappush(heap, pair(after[right]))
            if before[left] >= 0:
                heapq.heappush(heap, pair(left))
        return [start[k] for k in range(n) if alive[k]] + [places[-1]]


PIECE_SCHEMA = "doc_id bigint, piece int, tokens int, overlap int, beyond int, text string"


def limits_of(limits: DataFrame) -> DataFrame:
    """One row (source, max_tokens, overlap_tokens) per source: that of the least limit."""
    rows = limits.where(F.col("source").isNotNull() & F.col("max_tokens").isNotNull())
    best = F.min(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))).alias("b")
    return rows.groupBy("source").agg(best).select("source", "b.max_tokens", "b.overlap_tokens")


def split(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY, texts: bool = True) -> DataFrame:
    """Rows (doc_id, piece, tokens, overlap, beyond, text) of the pieces of the oversized documents.

    Spark broadcasts the limits where they are small. *texts* false leaves the texts null.
    """
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source")
    # A text has at most as many ids as bytes, so shorter ones need not be read.
    rows = docs.join(limits_of(limits), "source").where(F.octet_length("text") > F.col("max_tokens"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Splitter(encoder(vocabulary))
        for part in parts:
            out: list[tuple] = []
            for key, text, limit, overlap in zip(*(part.column(i).to_pylist() for i in range(4))):
                ids, cut = s.split(text, limit, overlap)
                if cut is None:
                    out.append((key, 0, None, None, None, None))
                    continue
                for k, (start, own, end) in enumerate(cut):
                    shown = b"".join(map(s.bytes_of.__getitem__, ids[start:end])).decode("utf-8", "replace") if texts else None
                    out.append((key, k, end - start, own - start, max(0, own - start - max(0, overlap)), shown))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return rows.select("doc_id", "text", "max_tokens", "overlap_tokens").mapInArrow(batches, PIECE_SCHEMA)


def found(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (doc_id) of the documents that are over their limit."""
    return split(documents, limits, texts=False).where((F.col("piece") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
