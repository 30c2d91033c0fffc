"""Texts as byte arrays: columns of Arrow batches without Python strings, words and their hashes by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; arrays beside them take about fifty times as much.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def byte_table(separators: bytes, fold: bool = True) -> np.ndarray:
    """256 bytes: separators become 0, A-Z lower case if ``fold``, others stay (a NUL byte becomes 1)."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = 1
    if fold:
        out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


#: White space as the contracts define it.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column: text i is ``data[offsets[i]:offsets[i + 1]]``; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


class Powers:
    """Powers of an odd number and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(n, _P, np.uint64))
                self.down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def _words(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of non-zero bytes."""
    inside = np.concatenate(([False], folded != 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    up, down = _POWERS(len(folded))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * up)))
        return start, end, mixed((sums[end] - sums[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, hash) of every word of the texts of one range, places within the range's bytes.

    A long text is cut at separators, so the arrays beside it stay small whatever its length.
    """
    base = int(offsets[0])
    folded = table[data[base : int(offsets[-1])]]
    if len(offsets) == 2:
        start, end, hashed = _cut(folded)
        return np.zeros(len(start), np.int64), start, end, hashed
    # a separator between the texts keeps words from running over
    between = offsets[1:-1] - base
    start, end, hashed = _words(np.insert(folded, between, 0))
    text = np.searchsorted(between + np.arange(len(between)), start)
    return text, start - text, end - text, hashed


def _cut(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text, in parts of about CHUNK bytes."""
    parts, first = [], 0
    while first < len(folded):
        last = min(len(folded), first + CHUNK)
        while last < len(folded):  # go on to the next separator
            stop = np.flatnonzero(folded[last : last + CHUNK] == 0)
            if len(stop):
                last += int(stop[0])
                break
            last = min(len(folded), last + CHUNK)
        start, end, hashed = _words(folded[first:last])
        parts.append((start + first, end + first, hashed))
        first = last
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
