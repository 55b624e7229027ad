"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, lower-cased
in A-Z.  All work is numpy over the column's byte buffer: no Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# Powers that a worker keeps (both arrays 8 MB); those of a longer slice go with it.
_POW_KEPT = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, up to n."""
    if "up" in _POW and len(_POW["up"]) >= n:
        return _POW["up"][:n], _POW["down"][:n]
    size = n if n > _POW_KEPT else _POW_KEPT
    made = []
    for base in (_BASE, _INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size == _POW_KEPT:
        _POW["up"], _POW["down"] = made
    return made[0][:n], made[1][:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0]:offs[-1]] if buf is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, down): the hash of bytes [i, j) is ``(P[j] - P[i]) * down[i]`` modulo 2**64."""
    up, down = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=p[1:])
    return p, down


def word_spans(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text
    (length of ``offs``): text t has words ``first[t]:first[t + 1]``."""
    w = IS_WORD[low]
    before = np.zeros(len(w) + 1, bool)
    before[1:] = w
    edge = offs[(offs >= 0) & (offs <= len(w))]
    before[edge] = False  # a text starts afresh
    start = np.flatnonzero(w & ~before[:-1])
    after = np.zeros(len(w) + 1, bool)
    after[:-1] = w
    after[edge] = False
    end = np.flatnonzero(w & ~after[1:]) + 1
    return start, end, np.searchsorted(start, offs)


def slices(offs: np.ndarray, most: int = 1 << 19):
    """Cut texts into runs of about ``most`` bytes (one long text may exceed it): numpy's
    64-bit intermediate arrays take some 30 times that."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, first word of each text)."""
    low = LOWER[data]
    start, end, first = word_spans(low, offs)
    p, down = prefix_hash(low)
    return mix((p[end] - p[start]) * down[start]), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its k-word shingles.  A text of
    fewer than k words has one shingle of all its words; one without words has none."""
    n = len(hashes)
    roll = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        roll = roll * _BASE + hashes[j:j + len(roll)]
    roll = mix(roll)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(roll[a:b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in hashes[a:b]:
                h = np.uint64((int(h) * int(_BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
