"""Texts as byte arrays: runs of rows, words, rolling hashes and sliding minima, all in numpy.

A run is a few rows of an Arrow batch laid end to end, so that one numpy call serves many short texts. Hashes are 64-bit polynomials
over random byte values, mixed at the end; equal inputs have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 * 8 + 3 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), grown by doubling and kept."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    _POWERS[base] = have if len(have) <= 4 * RUN_BYTES else have[: 4 * RUN_BYTES].copy()
    return have[:n]


class Spans:
    """Hashes of any spans of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=self._sums[1:])
        self._shift = _powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._shift[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every span of `width` values, by its start."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:n]) * self._shift[:n] + np.uint64(width))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


_PLACE_BITS = 26


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values, the position of its smallest value by the upper 38 bits; the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    most = 1 << _PLACE_BITS
    if len(values) > most:
        step = most - width + 1
        return np.concatenate([least_positions(values[i : i + most], width) + i for i in range(0, n, step)])
    low = np.uint64(most - 1)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (best[:n] & low).astype(np.int64)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a run of texts: starts, ends, the text each is in, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        first = offsets[:-1]
        before[first[first < len(data)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.bounds = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.bytes = Spans(byte_values(data))
        self.hashes = self.bytes.of(self.starts, self.ends)


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of about `limit` bytes; a longer text is a run of its own. Null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    _, places, content = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(places, places[first] + limit, "right")) - 1)
        yield first, content[places[first] : places[last]], places[first : last + 1] - places[first]
        first = last


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: keys that occur more than once, and keys that occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many | later, later


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n places inside any [start, start + width)."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, n), -1)
    return np.cumsum(edges[:n]) > 0


def kept_in_worker(name: str, make):
    """An object that stays with a Python worker over its tasks (workers are reused), made at its first use."""
    import sys

    store = sys.modules["__main__"].__dict__.setdefault("__cinelake_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def free_name(df, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shielded(df):
    """`df` with columns whose names begin like an operator's own (two underscores) renamed; `toDF(*df.columns)` gives the names back."""
    out = df
    for c in df.columns:
        if c.startswith("__"):
            out = out.withColumnRenamed(c, free_name(out, "kept" + c.strip("_")))
    return out
