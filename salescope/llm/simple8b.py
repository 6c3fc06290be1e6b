"""Simple-8b word-aligned integer coding, vectorised.

A 64-bit word is a 4-bit selector (top) and 60 bits of data.  Selector s packs COUNT[s] values of
BITS[s] bits each, the first value in the lowest bits; selector 0 is a run of 120 zeros.  A value of
more than 60 bits is an escape: a word of selector 15 (its data bits are 0), then the value itself.
"""

from __future__ import annotations

import struct

import numpy as np

COUNT = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15
MAGIC = b"S8B1"
_HEAD = "<4sIQQ"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value (0 for 0), as uint8."""
    limits = np.array([1 << b for b in range(64)], np.uint64)
    if len(values) and int(values.max()) < 1 << 16:
        return _TABLE[values.astype(np.int64)]
    return np.searchsorted(limits, values, "right").astype(np.uint8)


_TABLE = np.array([int(v).bit_length() for v in range(1 << 16)], np.uint8)


def encode(values: np.ndarray) -> np.ndarray:
    """Words (uint64) of the values; the last word is filled up with zeros, so the count is kept apart."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(n + 120, np.uint64)
    padded[:n] = values
    width = _widths(padded)
    widest = width[:n].copy()
    pick = np.full(n, 14, np.uint8)
    pick[widest > 60] = ESCAPE
    by_count = {int(c): s for s, c in enumerate(COUNT[:14])}
    for k in range(2, 121):  # widest[i]: bits of the widest of the k values from i
        np.maximum(widest, width[k - 1:k - 1 + n], out=widest)
        s = by_count.get(k)
        if s is not None:
            pick[widest <= BITS[s]] = s
        if k == 60 and not (widest == 0).any():
            break
    step = COUNT[pick].astype(np.uint8).tobytes()  # the greedy choice at every position ...
    at, i = [], 0
    while i < n:  # ... and the chain of those that are taken
        at.append(i)
        i += step[i]
    pos = np.array(at)
    sel = pick[pos]
    size = 1 + (sel == ESCAPE)
    where = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(where[-1], np.uint64)
    out[where[:-1]] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[where[rows] + 1] = padded[pos[rows]]
        elif s:
            c = int(COUNT[s])
            packed = padded[pos[rows]]
            for k in range(1, c):
                packed = packed | (padded[pos[rows] + k] << np.uint64(k * int(BITS[s])))
            out[where[rows]] |= packed
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of the words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (sel == ESCAPE).any():  # a word after an escape is raw data, whatever its top bits
        i = 0
        for i in np.flatnonzero(sel == ESCAPE):
            if head[i] and i + 1 < len(words):
                head[i + 1] = False
    at = np.flatnonzero(head)
    sel = sel[at]
    count = COUNT[sel]
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(max(int(start[-1]), n), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[rows]] = words[at[rows] + 1]
        elif s:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for k in range(int(COUNT[s])):
                out[start[rows] + k] = (words[at[rows]] >> np.uint64(k * int(BITS[s]))) & mask
    return out[:n]


def pack_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block: magic, number of documents, ids and words; the documents' id offsets; the words."""
    words = encode(ids)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return struct.pack(_HEAD, MAGIC, len(lengths), len(ids), len(words)) + offsets.tobytes() + words.astype("<u8").tobytes()


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of document i are ids[offsets[i]:offsets[i + 1]]."""
    magic, docs, n, words = struct.unpack_from(_HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    offsets = np.frombuffer(block, "<u8", docs + 1, struct.calcsize(_HEAD)).astype(np.int64)
    return decode(np.frombuffer(block, "<u8", words, struct.calcsize(_HEAD) + 8 * (docs + 1)).astype(np.uint64), n), offsets
