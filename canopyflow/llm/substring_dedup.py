"""Removal of repeated word passages by suffix automata.

The reference is the corpus itself, which no task can hold, so its shards are
the buckets of anchor grams (see ``repeats``) rather than broadcast files: each
task builds the automaton of its shard's spans, in document order, and streams
the shard's spans through it.  The matching state of the last ``WINDOW`` words
tells where they occur first.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from canopyflow.llm.repeats import Kind, steps_of, without_repeats, word_symbols

WINDOW, GRAM = 20, 8
#: Words in one automaton, or those of one gram.
STEP_WORDS = 150_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences added in order; ``first`` is
    the number of the word that ends a state's earliest occurrence."""

    def __init__(self):
        self.next, self.link, self.length, self.first, self.read = [{}], [-1], [0], [-1], 0

    def _state(self, moves, link, length, first):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p, symbol, q):
        """State for the strings of ``q`` that are at most one longer than ``p``."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
            else:
                new, p = self._state({}, 0, self.length[last] + 1, self.read), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
                last = new
            self.read += 1

    def earliest(self, sequence, size: int):
        """For each window of ``size`` symbols, the word number that ends its earliest occurrence."""
        state, matched, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
                matched = self.length[state]
            out.append(self.first[state] if matched >= size else -1)
        return out[size - 1:]


def later_windows(doc, start, windows, gram, content, size: int = WINDOW):
    by_gram = np.argsort(gram, kind="stable")
    n = np.cumsum(windows[by_gram] + size - 1)
    head = np.flatnonzero(np.r_[True, np.diff(gram[by_gram]) != 0])
    steps = steps_of(head, n, STEP_WORDS)
    rows, numbers = [], []
    for a, b in zip(steps[:-1], steps[1:]):
        own = by_gram[a:b]
        own = own[np.lexsort((start[own], doc[own]))]
        automaton, begins = SuffixAutomaton(), []
        for i in own:
            begins.append(automaton.read)
            automaton.add(content[i])
        for i, begin in zip(own, begins):
            for number, end in enumerate(automaton.earliest(content[i], size)):
                if 0 <= end < begin + number + size - 1:
                    k = bisect_right(begins, end) - 1
                    first = own[k]
                    # rows that repeat a document are at the same place
                    if (doc[first], start[first] + end - begins[k] - size + 1) < (doc[i], start[i] + number):
                        rows.append(i)
                        numbers.append(number)
    return np.array(rows, int), np.array(numbers, int)


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id, n_symbols`` (words), ``spans`` removed and ``kept`` words joined by one space.

    A word goes if a window of 20 words that covers it starts earlier too, in a
    document with a smaller doc_id or earlier in the same one.  Words lie between
    ASCII white space.  Null text has none; a null doc_id stays null and counts
    as the smallest.  Rows that repeat both doc_id and text are one document at
    the same place and do not remove each other; rows with one doc_id and other
    texts are compared by start.  Extra columns are not read.
    """
    return without_repeats(docs, Kind(WINDOW, GRAM, True, word_symbols, bytes.split), b" ", later_windows)
