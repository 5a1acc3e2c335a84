"""Substring dedup of bytes by column-wise construction of a collection's order.

All strings of a batch are sorted together by inserting one symbol of each per round, as in the column-wise construction of the
Burrows-Wheeler transform of a collection: a round reads one column of symbols in sequence, moves every string by a stable sort on its new
symbol, and updates the common prefixes of neighbours from those of the round before. The strings are segments aligned at their anchors
(see `repeats`), so two windows can only be equal in the same columns, and a window is repeated exactly if a neighbour in the order after its
last column shares as many symbols as the window is long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cinelake.llm.repeats import ByBytes, Windows, remove_repeats

WIDTH, GRAM = 400, 50


def resolve(keys: np.ndarray, offsets: np.ndarray, contents: list[bytes], width: int) -> list[np.ndarray]:
    """Per segment the windows that another segment of its class holds too; all classes of the batch in one order, classes apart."""
    n = len(contents)
    sizes = np.array([len(c) for c in contents])
    left = int(offsets.max(initial=0))
    first = left - offsets
    last = first + sizes
    columns = np.zeros((int(last.max(initial=0)), n), np.uint8)  # one row per round
    for i, c in enumerate(contents):
        columns[first[i] : last[i], i] = np.frombuffer(c, np.uint8)
    group = np.concatenate([[0], np.cumsum(np.diff(keys) != 0)]) if n else np.zeros(0, np.int64)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # symbols shared with the string before, up to this column
    windows: list[list[int]] = [[] for _ in range(n)]
    for column in range(len(columns)):
        here = (first <= column) & (column < last)
        symbol = np.where(here, columns[column].astype(np.int64), 256)[order]
        place = np.argsort(group[order] * 257 + symbol, kind="stable")
        moved, symbol = order[place], symbol[place]
        same = np.zeros(n + 1, bool)
        same[1:n] = (group[moved[1:]] == group[moved[:-1]]) & (symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)
        fresh = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            # the strings between two that are now neighbours: the least they share is what the two share
            bounds = np.empty(2 * len(at), np.int64)
            bounds[0::2], bounds[1::2] = place[at - 1] + 1, place[at] + 1
            fresh[at] = np.minimum.reduceat(common, bounds)[0::2] + 1
        order, common = moved, fresh
        if column + 1 >= width:
            full = np.maximum(common[:n], common[1:]) >= width
            for i in order[full].tolist():
                windows[i].append(column - width + 1 - int(first[i]))
    return windows


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Bytes in strings of `width` that occur elsewhere too, for every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    report = remove_repeats(docs, Windows(ByBytes, width, gram, resolve))
    return report.withColumnRenamed("n_units", "n_bytes")
