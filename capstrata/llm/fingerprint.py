"""Vectorised word hashing and winnowing over Arrow text buffers.

A word is a run of a-z or 0-9 after lower-casing A-Z; everything else separates words. Word hashes come from
one polynomial prefix sum per buffer (arithmetic modulo 2^64, where the base is odd and so invertible), so the
cost is a few array passes over the bytes whatever the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text handled at once; bounds the memory of the power tables to 16 times as much.
CHUNK = 2 << 20

_FOLD = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in range(26):
    _FOLD[65 + _c] = 97 + _c

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array):
    """(first row, row count, bytes, offsets from 0) for runs of rows of about CHUNK bytes; nulls are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield i, j - i, raw[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of every word, in order."""
    folded = _FOLD[raw]
    inside = folded != 0
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(before)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _tables(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(folded * up[: len(raw)], dtype=np.uint64, out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, rows, starts, ends


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of the whole sequence; runs across rows must be masked by the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _STEP + hashes[j : j + n]
    return mix(h)


def winnow(hashes: np.ndarray, rows: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the k-grams kept: of every w consecutive k-grams of a row, those with the least hash.

    Any span of at least w + k - 1 words that two rows share holds one whole window, whose least k-gram both
    rows keep. Rows with fewer words keep nothing.
    """
    h = gram_hashes(hashes, k)
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, size = h.copy(), 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[w - size : w - size + n])
    whole = rows[:n] == rows[w + k - 2 : w + k - 2 + n]
    kept = np.zeros(len(h), dtype=bool)
    for d in range(w):
        kept[d : d + n] |= whole & (h[d : d + n] == least)
    return np.flatnonzero(kept)
