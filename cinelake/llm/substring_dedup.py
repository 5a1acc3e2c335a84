"""Substring dedup by suffix automata over words.

The reference shards are classes of segments that share an anchor (see `repeats`), small enough for one automaton each, and every segment is
streamed through the automaton of its own class only: a shard and what can match in it travel to the same task, instead of every automaton
travelling to every task. Where the matching statistic reaches the window, the window's place in the automaton counts its occurrences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cinelake.llm.repeats import ByWords, Windows, remove_repeats

WIDTH, GRAM = 35, 6


class SuffixAutomaton:
    """The suffix automaton of a set of sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state for the shorter strings of q that end an edge from p by `symbol`."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            p = last
            q = self.next[p].get(symbol)
            if q is not None:  # an earlier sequence led here
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                continue
            last = self._state(self.length[p] + 1, 0, {})
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)

    def places(self, sequence, width: int):
        """For each place of `sequence` where the matching statistic is at least `width`: (first symbol of the window, state that holds it)."""
        state = size = 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            if size >= width:
                at = state
                while self.length[self.link[at]] >= width:
                    at = self.link[at]
                yield i - width + 1, at


def resolve(keys: np.ndarray, offsets: np.ndarray, contents: list[bytes], width: int) -> list[list[int]]:
    """Per segment the windows that another segment of its class holds too; one automaton per class."""
    found: list[list[int]] = [[] for _ in contents]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(contents)]):
        if b - a < 2:
            continue
        sequences = [c.split() for c in contents[a:b]]
        automaton = SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        met = [list(automaton.places(s, width)) for s in sequences]
        times: dict[int, int] = {}
        for places in met:
            for _, state in places:
                times[state] = times.get(state, 0) + 1
        for i, places in enumerate(met):
            found[a + i] = [start for start, state in places if times[state] > 1]
    return found


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Words in runs of `width` that occur elsewhere too, for every document: doc_id, n_words, n_removed, kept_sha256, n_spans."""
    report = remove_repeats(docs, Windows(ByWords, width, gram, resolve))
    return report.withColumnRenamed("n_units", "n_words").select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")
