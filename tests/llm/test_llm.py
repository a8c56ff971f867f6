"""The training-text operators against the public libraries and brute force."""

from __future__ import annotations

import random
import time
import unicodedata

import pytest
import regex
import tiktoken

from claimwright.llm import encode, leaks, split
from claimwright.plans import skew

E = encode.encoder(encode.VOCABULARY)
# Written out here on its own: the pattern of the vocabulary's description.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=E.vocabulary.ranks, special_tokens={})
BITS = [
    "a", " ", "  ", "\n", "\n\n", "\r\n", "'s", "'", "''", "!!!'", "Ü", "ß", "日本", "‍", "👩‍🔧", "\x1c", "\x85", "᠎", "١", "½", "Ⅷ", "the ", "end. ", "word",
    " ", "　", "<|endoftext|>", "\t", "é", "é", "﻿", "\x00", "\x1f", "ǅ", "\U0001d7d8", "x" * 30, "日" * 20, "。", "3.14", "don't",
]


def mixed(r: random.Random, most: int) -> str:
    return "".join(r.choice(BITS) for _ in range(r.randint(0, most)))


# -- p7


def test_ids_are_those_of_the_library():
    r = random.Random(1)
    for _ in range(1500):
        text = mixed(r, 30)
        assert E.encode(text) == ORACLE.encode_ordinary(text), text
    for text in ("ab" * 20_000, "x" * 50_000, " " * 5_000 + "x", "\n" * 3_000, "日本語" * 3_000, "'" * 999):
        assert E.encode(text) == ORACLE.encode_ordinary(text)


def test_prefix_table_appends_and_edits():
    r, v = random.Random(2), E.vocabulary
    some = lambda n: bytes(r.choice(b"abcdethe nio") for _ in range(r.randint(0, n)))
    for _ in range(120):
        table = encode.PrefixTable(v, some(600))
        table.append(some(40))
        for _ in range(3):
            start = r.randint(0, len(table.data))
            table.replace(start, r.randint(start, min(len(table.data), start + 20)), some(9))
        fresh = encode.PrefixTable(v, table.data)
        assert table.last == fresh.last and table.ids() == v.merged(table.data)


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x"), (None, "a", "x"), (4, "<|endoftext|>", "x")], "doc_id int, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode.encode(df).collect()), key=repr)
    assert got == sorted([(1, ORACLE.encode_ordinary("hello world"))] * 2 + [(2, []), (3, []), (None, ORACLE.encode_ordinary("a")), (4, ORACLE.encode_ordinary("<|endoftext|>"))], key=repr)
    assert encode.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in encode.token_counts(df).collect()}[2] == 0


# -- p8


def plain_words(text):
    text = "".join(c for c in text or "" if c not in "­​‌‍⁠﻿")
    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text).lower())


def test_words():
    for text in ("Foo_bar-9½ İx ﬁne ＡＢ", "so­ft zero​width", "", None, "  ", "éte Ⅷ ١٢", "a" * 10_000):
        assert leaks.words(text) == plain_words(text)


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 40)))) for i in range(30)]
    items += [(3, items[5][1]), (40, ""), (41, None), (42, "too short"), (None, items[0][1]), items[7]]
    docs = []
    for d in range(80):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            own = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(own) - 13))
            parts.append(("—" if r.random() < 0.2 else ", ").join(own[a : a + r.randint(8, 20)]).upper())
        docs.append((d, " zz ".join(parts)))
    docs += [(100, None), (101, ""), (102, "  "), (None, items[0][1]), docs[0], (103, items[0][1] * 40)]
    grams = lambda x: {tuple(w[k : k + 12]) for w in [plain_words(x)] for k in range(len(w) - 11)}
    want = {(d, i) for d, x in docs if d is not None for i, y in items if i is not None and grams(x) & grams(y)}
    got = [tuple(x) for x in leaks.found(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_reordered_passages_are_covered(spark):
    a, b = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    items = spark.createDataFrame([(1, f"{a} {b}"), (2, "none of it " * 9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {b} y {a}"), (2, a)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.tiles, r.words, r.cover) for r in leaks.overlaps(docs, items).collect()}
    assert got == {(1, 1): (2, 30, 1.0), (2, 1): (1, 15, 0.5)}
    assert [tuple(r) for r in leaks.report(docs, items).collect()] == [(1, 2, 2, 1.0)]
    assert leaks.found(docs.limit(0), items).count() == 0 and leaks.found(docs, items.limit(0)).count() == 0


def shared_windows(document, item, least):
    out = {}
    for k, side in enumerate((document, item)):
        for at in range(len(side) - least + 1):
            out.setdefault(tuple(side[at : at + least]), ([], []))[k].append(at)
    return [x for x in out.values() if x[0] and x[1]]


def test_tiles_are_longest_first_and_disjoint():
    shared = shared_windows([1, 2, 3, 4, 5, 6, 1, 2, 3], [1, 2, 3, 4, 9, 1, 2, 3], 3)
    assert sorted(leaks.tiles(shared, 3)) == sorted(leaks.tiles(shared, 3, 0)) == [(0, 0, 4), (6, 5, 3)]


def test_bisected_tiles_are_those_of_listed_seeds():
    r = random.Random(8)
    for _ in range(300):
        document, item = ([r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(3, 60))] for _ in range(2))
        shared = shared_windows(document, item, 3)
        if shared:
            assert leaks.tiles(shared, 3) == leaks.tiles(shared, 3, 0), (document, item)


def test_repeated_words_give_no_product_of_seeds(spark):
    began = time.time()
    docs = spark.createDataFrame([(1, "no " * 20_000), (2, "yes no " * 9_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "no " * 2_000), (2, "yes no " * 500)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.tiles, r.words) for r in leaks.overlaps(docs, items).collect()}
    assert got == {(1, 1): (1, 2000), (2, 2): (1, 1000)} and time.time() - began < 30


def test_hot_windows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST", 5)
    line = " ".join(f"task{k}" for k in range(13))
    docs = spark.createDataFrame([(i, f"own{i} {line} end{i}") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{line} item{i}") for i in range(30)], "item_id long, text string")
    assert leaks.found(docs, items).count() == 40 * 30


# -- p9


def exact(ids, at):
    """Whether a text may begin at token *at*: its bytes are characters, and encode to the same ids."""
    data = b"".join(map(E.vocabulary.bytes_of.__getitem__, ids[at:]))
    return data[0] & 0xC0 != 0x80 and ORACLE.encode_ordinary(data.decode()) == ids[at:]


def faults(text, limit, overlap, ids, cut):
    """What is wrong with a split."""
    if len(ORACLE.encode_ordinary(text)) <= limit:
        return ["cut without need"] if cut else []
    out, before, bytes_of = [], None, E.vocabulary.bytes_of
    if not cut or cut[0][0] or cut[-1][2] != len(ids):
        return ["ends"]
    for start, own, end in cut:
        shown = b"".join(map(bytes_of.__getitem__, ids[start:end])).decode("utf-8")
        if end - start > limit or ORACLE.encode_ordinary(shown) != ids[start:end]:
            out.append(("size or ids", shown))
        if before:
            if own != before[2] or own - start < overlap or start < before[0]:
                out.append(("overlap", start, own, before))
            elif own - start > overlap and any(exact(ids, k) for k in range(start + 1, own - overlap + 1)):
                out.append(("longer overlap than a character needs", start, own))
        before = start, own, end
    return out


def test_splits_hold_their_promises():
    r, s, beyond, joins = random.Random(4), split.Splitter(E), 0, 0
    for _ in range(1500):
        text, limit, overlap = mixed(r, 90), r.randint(20, 64), r.choice([0, 0, 3, 8, 15])
        ids, cut = s.split(text, limit, overlap)
        assert ids == ORACLE.encode_ordinary(text) and not faults(text, limit, overlap, ids, cut), (text, limit, overlap)
        beyond, joins = beyond + sum(own - start > overlap for start, own, _ in cut[1:]), joins + len(cut[1:])
    assert 0 < beyond < joins / 8  # in texts that are full of characters of several tokens


def test_all_small_limits_and_overlaps():
    r, s, refused = random.Random(9), split.Splitter(E), 0
    for limit in range(1, 65):
        for overlap in {0, 1, limit // 2, limit - 2, limit - 1, limit}:
            text = mixed(r, 60)
            ids, cut = s.split(text, limit, overlap)
            if cut is None:
                refused += 1
                assert overlap > limit - 8, (limit, overlap)  # never where the overlap and any character fit
            else:
                assert not faults(text, limit, max(0, overlap), ids, cut), (text, limit, overlap)
    assert refused


def test_ascii_overlaps_are_what_was_asked():
    s = split.Splitter(E)
    text = "The quick brown fox didn't jump over 12 lazy dogs; it slept. " * 40
    for limit, overlap in [(40, 35), (64, 60), (32, 31), (9, 5)]:
        ids, cut = s.split(text, limit, overlap)
        assert not faults(text, limit, overlap, ids, cut) and all(own - start == overlap for start, own, _ in cut[1:])


def test_cuts_prefer_strong_boundaries():
    s = split.Splitter(E)
    paragraph = "One short sentence here. " * 6
    text = "\n\n".join([paragraph.strip()] * 5)
    ids, cut = s.split(text, 80, 0)
    shown = [b"".join(map(E.vocabulary.bytes_of.__getitem__, ids[a:b])).decode() for a, _, b in cut]
    assert "".join(shown) == text and all(x.strip().startswith("One") and x.strip().endswith("here.") for x in shown)
    assert all(x.count("One") % 6 == 0 for x in shown)


def test_split_rows(spark):
    long = "word " * 300
    docs = spark.createDataFrame(
        [(1, long, "a"), (2, "short", "a"), (3, None, "a"), (4, long, None), (5, long, "unknown"), (6, "", "a"), (7, "x" * 9000, "b"), (1, long, "a"), (None, long, "a"), (8, long, "n")],
        "doc_id int, text string, source string",
    )
    limits = spark.createDataFrame([("a", 100, 10), ("a", 400, 0), ("b", 50, None), (None, 1, 1), ("n", None, 1)], "source string, max_tokens int, overlap_tokens int")
    assert sorted(r.doc_id for r in split.found(docs, limits).collect()) == [1, 7]
    pieces = split.split(docs, limits).where("doc_id = 7").orderBy("piece").collect()
    assert "".join(p.text for p in pieces) == "x" * 9000 and all(p.tokens <= 50 and p.overlap == 0 for p in pieces)
    first, second = split.split(docs.limit(1), limits).orderBy("piece").limit(2).collect()
    assert second.overlap == 10 and second.text.startswith(E_text(first.text, 10))
    assert split.found(docs.limit(0), limits).count() == 0 and split.found(docs, limits.limit(0)).count() == 0


def E_text(text, n):
    ids = ORACLE.encode_ordinary(text)
    return ORACLE.decode(ids[-n:])


@pytest.mark.parametrize("limit", [1, 2, 9])
def test_tiny_limits_are_refused(spark, limit):
    text = "👩‍🔧 naïve 日本 text. " * 5
    assert split.Splitter(E).split(text, limit, limit)[1] is None
    docs = spark.createDataFrame([(1, text, "a"), (2, "a b c d e f g h i j k l", "a")], "doc_id long, text string, source string")
    limits = spark.createDataFrame([("a", limit, limit)], "source string, max_tokens int, overlap_tokens int")
    assert sorted(r.doc_id for r in split.found(docs, limits).collect()) == [1, 2]
    assert [tuple(r) for r in split.split(docs, limits).where("doc_id = 1").collect()] == [(1, 0, None, None, None, None)]


def test_every_piece_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    limits = {r.source: r for r in spark.read.parquet("/root/testdata/sf0.01/size_limits.parquet").collect()}
    s, joins, beyond = split.Splitter(E), 0, 0
    for r in docs.where("text is not null and source is not null").collect():
        if r.source in limits:
            limit, overlap = limits[r.source].max_tokens, limits[r.source].overlap_tokens
            ids, cut = s.split(r.text, limit, overlap)
            assert not faults(r.text, limit, overlap, ids, cut), r.doc_id
            joins += len(cut[1:])
            beyond += sum(own - start != overlap for start, own, _ in cut[1:])
    assert joins > 300 and beyond == 0


def test_other_columns_and_empty_tables(spark):
    """Columns of any name beside those that are read change nothing, and tables without rows give none."""
    line = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(1, line, "a", 9, 9, 9, "x"), (None, None, None, None, None, None, None)], "doc_id long, text string, source string, doc long, part long, h long, places string")
    items = spark.createDataFrame([(7, line, 1, 2, "y")], "item_id long, text string, item long, g long, words string")
    limits = spark.createDataFrame([("a", 5, 1, 3)], "source string, max_tokens int, overlap_tokens int, piece int")
    assert [tuple(r) for r in leaks.found(docs, items).collect()] == [(1, 7)]
    assert [r.doc_id for r in split.found(docs, limits).collect()] == [1]
    assert sorted((r.doc_id, len(r.ids)) for r in encode.encode(docs.where("doc_id = 1")).collect()) == [(1, len(ORACLE.encode_ordinary(line)))]
    empty = docs.limit(0)
    assert leaks.report(empty, items).count() == 0 and split.split(empty, limits).count() == 0 and encode.encode(empty).count() == 0
    assert leaks.overlaps(docs, items.limit(0)).count() == 0


def test_repeated_rows_and_ties(spark):
    line = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(1, line)] * 3 + [(1, f"x {line} y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, line)] * 2 + [(8, line)], "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.found(docs, items).collect()) == [(1, 7), (1, 8)]
    assert {(r.tiles, r.words, r.cover) for r in leaks.overlaps(docs, items).collect()} == {(1, 15, 1.0)}
    assert encode.encode(docs).count() == 4
