"""Evaluation texts that leaked into training texts (problem 8).

Greedy string tiling. Documents and items are read as sequences of words. *Seeds* are
shared runs of ``least`` words, found by Karp-Rabin hashes of all windows of a document
against the sorted hashes of all windows of the items. Seeds that follow each other on
one diagonal join to maximal matches, and the longest match is marked again and again,
among words that no tile holds yet, until none of ``least`` words is left. The tiles of
a document and an item say how much of the item the document holds, in whatever order
its passages come; an item is called leaked whole where that share reaches ``cover``.

A document and an item have a tile exactly if they have ``least`` consecutive words in
common, since the longest match is always marked.

Items and documents are two tables of any size. Both are cut into windows, a row per text
and window hash with the places of that hash in the text (so repeated windows are one
row). The windows of the items also set bits of two bitmaps of fixed size, of their words
and of their window hashes, which are sent to all executors: a document's window that no
item can have never leaves its task. What is left, true hits but for few, meets the
items' windows in a join on the hash, hot hashes dealt out; the tiles of a document and
an item are then found in one group, whose size is bounded by the two texts. Window
hashes have 128 bits, made of 128-bit hashes of words.

Where a document and an item repeat themselves, a hash of many places in both would give
a seed for each two of them. Such pairs are not seeded: the longest match is found by
bisection over its length, with exact names for runs of equal windows, once a tile.

Defined results: null, empty or blank texts have no words and no tiles; a text of fewer
words than ``least`` has none; repeated item rows are one item (an id with several texts
has the windows of each); rows without an id are left out.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimwright.plans.skew import spread_join
from claimwright.plans.tables import checkpointed

LEAST = 12
COVER = 0.5
#: Bits of the maps of the items' words and windows, whatever the number of items.
WORD_BITS, WINDOW_BITS = 23, 25
#: Seeds of a document and an item up to which they are listed; beyond, matches are bisected.
SEEDS = 20_000
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)

_DROPPED = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # fixed values
_ASCII_WORDS, _WORDS = re.compile("[0-9a-z]+").findall, re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and numbers of the normalised, lower-cased text."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORDS(text.lower())
    return _WORDS(unicodedata.normalize("NFKC", text.translate(_DROPPED)).lower())


class _Words:
    """Words as numbers, with the two halves of their hashes; 0 is a word that the bits rule out."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = [0], [0]

    def numbers(self, text: str | None) -> list[int]:
        get, number = self.number.get, self._number
        return [n if (n := get(w)) is not None else number(w) for w in words(text)]

    def _number(self, word: str) -> int:
        whole = xxhash.xxh3_128_intdigest(word)
        low, n = whole & 0xFFFFFFFFFFFFFFFF, 0
        if self.bits is None or _has(self.bits, np.array([low], dtype=np.uint64), WORD_BITS)[0]:
            n = len(self.hashes[0])
            self.hashes[0].append(low)
            self.hashes[1].append(whole >> 64)
        self.number[word] = n
        return n


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _has(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _place(hashes, bits)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def window_hashes(hashes: np.ndarray, at: np.ndarray, least: int, base: np.uint64) -> np.ndarray:
    """The Karp-Rabin hashes of the windows that begin at *at*, of words with *hashes*."""
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(least):
            out = out * base + hashes[at + k]
    return out ^ (out >> np.uint64(29))


WINDOWS = "doc bigint, part bigint, h bigint, g bigint, places array<int>, words int"


def _windows(texts: DataFrame, least: int, sent=None) -> DataFrame:
    """Rows (doc, part, h, g, places, words) of the windows of *texts* (doc, part, text), a row per text and hash."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits, window_bits = (np.frombuffer(b, dtype=np.uint8) for b in sent.value) if sent else (None, None)
        known = _Words(word_bits)
        for part in parts:
            if len(known.number) > REMEMBERED:
                known.clear()
            flat, starts = array("q"), []
            for text in part.column(2):
                starts.append(len(flat))
                flat.extend(known.numbers(text.as_py()))
                flat.append(0)
            ids, first = np.frombuffer(flat, dtype=np.int64) if len(flat) else np.empty(0, np.int64), np.array(starts + [len(flat)])
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            at = np.flatnonzero(unknown[least:] == unknown[: max(0, len(ids) - least + 1)]) if len(ids) >= least else np.empty(0, np.int64)
            low, high = (np.array(h, dtype=np.uint64)[ids] for h in known.hashes)
            h = window_hashes(low, at, least, _BASES[0])
            if window_bits is not None:
                hit = _has(window_bits, h, WINDOW_BITS)
                at, h = at[hit], h[hit]
            g = window_hashes(high, at, least, _BASES[1])
            row = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((at, g, h, row))
            at, h, g, row = at[order], h[order], g[order], row[order]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            begin = np.flatnonzero(new)
            own = row[begin]
            places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array((at - first[row]).astype(np.int32)))
            size = (np.diff(first)[own] - 1).astype(np.int32)
            columns = [part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(h[begin].view(np.int64)), pa.array(g[begin].view(np.int64)), places, pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WINDOWS.split(", ")])

    return texts.mapInArrow(batches, WINDOWS)


def _bitmaps(items: DataFrame, windows: DataFrame):
    """The two bitmaps of the items, broadcast: together 5 MiB, whatever the items."""

    def word_places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = [xxhash.xxh3_128_intdigest(w) & 0xFFFFFFFFFFFFFFFF for w in {w for t in part.column(2) for w in words(t.as_py())}]
            yield pa.RecordBatch.from_arrays([pa.array(_place(np.array(hashes, dtype=np.uint64), WORD_BITS))], ["at"])

    made = []
    window_places = windows.select(F.shiftrightunsigned("h", 64 - WINDOW_BITS).alias("at"))
    for places, bits in ((items.mapInArrow(word_places, "at bigint"), WORD_BITS), (window_places, WINDOW_BITS)):
        packed = bytearray(1 << (bits - 3))
        rows = places.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
        for bucket, some in rows.collect():  # at most 1024 rows of 4 KiB
            packed[(bucket - 1) * 4096 : bucket * 4096] = some
        made.append(bytes(packed))
    return items.sparkSession.sparkContext.broadcast(tuple(made))


def tiles(shared: list[tuple[list[int], list[int]]], least: int, seeds: int = SEEDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, words), from the places of each shared window in both."""
    if sum(len(d) * len(i) for d, i in shared) > seeds:
        return _bisected(shared, least)
    matches, open_runs = [], {}
    for d, i in sorted((d, i) for ds, is_ in shared for d in ds for i in is_):
        run = open_runs.get(d - i)
        if run and run[0] + run[2] - least + 1 == d:
            run[2] += 1
        else:
            open_runs[d - i] = run = [d, i, least]
            matches.append(run)
    heap = [(-n, d, i) for d, i, n in matches]
    heapq.heapify(heap)
    in_document = np.zeros(max((max(d) for d, _ in shared), default=0) + least, bool)
    in_item, out = np.zeros(max((max(i) for _, i in shared), default=0) + least, bool), []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        taken = in_document[d : d + n] | in_item[i : i + n]
        if not taken.any():
            in_document[d : d + n] = in_item[i : i + n] = True
            out.append((d, i, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], taken.view(np.int8), [1]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), d + int(a), i + int(a)))
    return out


def _bisected(shared: list[tuple[list[int], list[int]]], least: int) -> list[tuple[int, int, int]]:
    """The same tiles: each is the longest run of equal windows that is left, found by bisection over its length."""
    sides = [np.zeros(max(max(x[k]) for x in shared) + 1, dtype=np.int64) for k in (0, 1)]
    for name, places in enumerate(shared, 1):
        for side, own in zip(sides, places):
            side[own] = name
    open_ = [side > 0 for side in sides]
    names = [sides]  # names[k]: equal numbers are equal runs of 2 ** k windows
    while 2 << (len(names) - 1) <= min(map(len, sides)):
        step, last = 1 << (len(names) - 1), names[-1]
        both = np.concatenate([x[:-step] * (1 << 31) + x[step:] for x in last])
        code = np.unique(both, return_inverse=True)[1]
        cut = len(last[0]) - step
        names.append([code[:cut], code[cut:]])

    def runs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side, the places where *n* open windows follow each other, and exact names of those runs."""
        k = n.bit_length() - 1
        out = []
        for free, name in zip(open_, names[k]):
            shut = np.concatenate(([0], np.cumsum(~free)))
            at = np.flatnonzero(shut[n:] == shut[: len(free) - n + 1])
            out.append((at, name[at] * (1 << 31) + name[at + n - (1 << k)]))
        return out

    out, high = [], min(map(len, sides))
    while True:
        low = 0
        while low < high:
            n = (low + high + 1) // 2
            (_, a), (_, b) = runs(n)
            low, high = (n, high) if len(np.intersect1d(a, b)) else (low, n - 1)
        if not low:
            return out
        (at, a), (other, b) = runs(low)
        first = np.flatnonzero(np.isin(a, b))[0]
        d, i = int(at[first]), int(other[np.flatnonzero(b == a[first])[0]])
        out.append((d, i, low + least - 1))
        for free, start in ((open_[0], d), (open_[1], i)):
            free[max(0, start - least + 1) : start + low + least - 1] = False
        high = low  # no later tile is longer


SCHEMA = "doc_id bigint, item_id bigint, tiles int, words int, item_words int, cover double"


def _tiled(least: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc, item, size, shared in zip(*(part.column(k).to_pylist() for k in range(4))):
                found_ = tiles([(x["places"], x["item_places"]) for x in shared], least)
                count = sum(t[2] for t in found_)
                out.append((doc, item, len(found_), count, size, count / size))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return batches


def overlaps(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, item_id, tiles, words, item_words, cover) of each document and item with a tile.

    An id with several texts has the row of the text that is covered most.
    """
    texts = lambda df, key: df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.xxhash64("text").alias("part"), "text")
    query = texts(items, "item_id").distinct()
    own = checkpointed(_windows(query, least))
    hits = checkpointed(_windows(texts(documents, "doc_id"), least, _bitmaps(query, own)).drop("words"))
    own = own.select("h", "g", F.col("doc").alias("item"), F.col("part").alias("item_part"), F.col("places").alias("item_places"), F.col("words").alias("item_words"))
    both = spread_join(hits, own, ["h", "g"])
    pairs = both.groupBy("doc", "part", "item", "item_part", "item_words").agg(F.collect_set(F.struct("h", "g", "places", "item_places")).alias("shared"))
    every = pairs.select("doc", "item", "item_words", F.transform("shared", lambda x: F.struct(x.places.alias("places"), x.item_places.alias("item_places"))).alias("shared")).mapInArrow(_tiled(least), SCHEMA)
    best = F.max(F.struct("cover", "words", "tiles", "item_words")).alias("b")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.tiles", "b.words", "b.item_words", "b.cover")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id) of documents and items with ``LEAST`` consecutive words in common."""
    return overlaps(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """Per item that leaked: (item_id, documents, whole, most); *whole* counts those that cover *cover* of it."""
    rows = overlaps(documents, items)
    return rows.groupBy("item_id").agg(
        F.count("*").alias("documents"), F.sum((F.col("cover") >= cover).cast("bigint")).alias("whole"), F.round(F.max("cover"), 6).alias("most")
    )
