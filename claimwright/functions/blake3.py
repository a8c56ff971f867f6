"""BLAKE3 digests of bytes, all chunks of a file at once in numpy.

A file is cut into chunks of 1024 bytes; each is compressed block by block, the chunks side by
side as lanes of one array. Their chaining values are then joined in pairs, level by level; a
value without a neighbour rises as it is, which gives the tree of the definition.
"""

from __future__ import annotations

import numpy as np

from claimwright.functions.batched import batched

# The initial state, the order of message words in the next round, and the flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
NEXT = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
COLUMNS, DIAGONALS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)], [(0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
CHUNK, BLOCK = 1024, 64


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compressed(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The chaining values (8, lanes) after one block of *words* (16, lanes) in each lane."""
    lanes = words.shape[1]
    low, high = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v = np.concatenate([chain, np.repeat(IV[:4, None], lanes, 1), low[None], high[None], size[None], flags[None]])
    with np.errstate(over="ignore"):
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(COLUMNS + DIAGONALS):
                for word, first, second in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                    v[a] += v[b] + word
                    v[d] = _turned(v[d] ^ v[a], first)
                    v[c] += v[d]
                    v[b] = _turned(v[b] ^ v[c], second)
            words = words[NEXT]
    return v[:8] ^ v[8:]


def blake3(data: bytes) -> str:
    """The 256-bit digest of *data* in hexadecimal."""
    lanes = max(1, -(-len(data) // CHUNK))
    padded = np.frombuffer(data.ljust(lanes * CHUNK, b"\0"), dtype="<u4").reshape(lanes, CHUNK // BLOCK, 16).astype(np.uint32)
    left = np.minimum(np.maximum(len(data) - np.arange(lanes) * CHUNK, 0), CHUNK)
    blocks = np.maximum(1, -(-left // BLOCK))
    chain = np.repeat(IV[:, None], lanes, 1)
    for k in range(CHUNK // BLOCK):
        own = np.flatnonzero(blocks > k)
        if not len(own):
            break
        ends = blocks[own] == k + 1
        flags = (CHUNK_START * (k == 0) + CHUNK_END * ends + ROOT * (ends & (lanes == 1))).astype(np.uint32)
        size = np.minimum(left[own] - k * BLOCK, BLOCK).astype(np.uint32)
        chain[:, own] = _compressed(chain[:, own], padded[own, k].T.copy(), own.astype(np.uint64), size, flags)
    while chain.shape[1] > 1:
        pairs = chain.shape[1] // 2
        words = np.concatenate([chain[:, 0 : 2 * pairs : 2], chain[:, 1 : 2 * pairs : 2]])
        root = ROOT * (chain.shape[1] == 2)
        joined = _compressed(np.repeat(IV[:, None], pairs, 1), words, np.zeros(pairs, np.uint64), np.full(pairs, BLOCK, np.uint32), np.full(pairs, PARENT + root, np.uint32))
        chain = np.concatenate([joined, chain[:, 2 * pairs :]], 1)
    return chain[:, 0].astype("<u4").tobytes().hex()


#: The digest of a binary column.
digest = batched(lambda data: None if data is None else blake3(bytes(data)), "string")
