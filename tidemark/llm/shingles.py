"""Sets of word shingles of many texts at once, as sorted 64-bit hashes.

Bytes are handled as arrays: A-Z are lower-cased by a table, words are runs of bytes other
than ASCII white space, and the hash of a word is a polynomial over 64-bit constants of its
bytes, taken from running sums, so no text is split in Python. Two different shingles of a
table of n get the same hash with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F88695, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: Bytes hashed at once, unless one word is longer.
AT_ONCE = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n, AT_ONCE) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word ``data[starts[i]:ends[i]]``; words in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, at + AT_ONCE, side="right")))
        up, down = _powers(int(ends[last - 1]) - at)
        part = data[at : int(ends[last - 1])]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE))
        first = last
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, one without words none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    low = int(offsets[0])
    data = np.frombuffer(body, dtype=np.uint8)[low : int(offsets[-1])] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - low
    data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    behind = np.concatenate([word[1:], [False]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~behind | edge[1:])) + 1
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    rolled = None
    if len(hashes) >= width:
        rolled = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for k in range(width):
            rolled = mix(rolled + hashes[k : k + len(rolled)] * _PLACE[k])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n == 0:
            yield np.empty(0, np.uint64)
        elif n < width:
            value = np.zeros(1, np.uint64)
            for k in range(n):
                value = mix(value + hashes[a + k : a + k + 1] * _PLACE[k])
            yield mix(value + np.uint64(n))
        else:
            yield np.unique(rolled[a : b - width + 1])
