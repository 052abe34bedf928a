"""Removal of byte passages that an earlier document holds, by a depth-limited radix sort.

Suffixes are sorted only through the threshold: most-significant-digit passes of
eight bytes refine groups of windows, and a group that no other document shares
is dropped at once.  Groups left after the last pass are exactly the repeated
windows.  The first digit, taken while documents are scanned, is the window's
anchor gram (see ``repeats``), so that only suffixes that can repeat are moved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from canopyflow.llm.repeats import Kind, byte_symbols, steps_of, without_repeats

WINDOW, GRAM = 50, 18
#: Windows sorted in one step, or those of one gram.
STEP_WINDOWS = 1_000_000


def radix_groups(flat: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose ``depth`` bytes also occur in another document, and the
    smallest document of their group."""
    chosen = np.arange(len(at))
    flat = np.r_[flat, np.zeros(8, np.uint8)]
    digits = np.lib.stride_tricks.sliding_window_view(flat, 8)
    for k in range(0, depth, 8):
        digit = np.ascontiguousarray(digits[at[chosen] + min(k, depth - 8)] if depth >= 8 else digits[at[chosen]])
        if depth < 8:
            digit[:, depth:] = 0
        digit = digit.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group[chosen]))
        chosen, digit = chosen[order], digit[order]
        if not len(chosen):
            break
        g = group[chosen]
        head = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])])
        size = np.diff(np.r_[head, len(chosen)])
        low, high = np.minimum.reduceat(doc[chosen], head), np.maximum.reduceat(doc[chosen], head)
        group[chosen] = np.repeat(np.arange(len(head)), size)
        shared = np.repeat(low < high, size)
        lowest, chosen = np.repeat(low, size)[shared], chosen[shared]
    return chosen, lowest if len(chosen) else np.zeros(0, np.int64)


def later_windows(doc, start, windows, gram, content, depth: int = WINDOW):
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], np.cumsum(windows[order])
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    steps = steps_of(head, n, STEP_WINDOWS)
    rows, numbers = [], []
    for a, b in zip(steps[:-1], steps[1:]):
        own = order[a:b]
        flat = np.frombuffer(b"".join(content[i] for i in own), np.uint8)
        count = windows[own]
        base = np.cumsum(np.r_[0, count[:-1] + depth - 1])
        row = np.repeat(np.arange(len(own)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, count[:-1]]), count)
        group = np.cumsum(np.r_[True, gram[a + 1:b] != gram[a:b - 1]])[row]
        found, lowest = radix_groups(flat, base[row] + number, group, doc[own][row], depth)
        late = doc[own][row][found] > lowest
        rows.append(own[row[found[late]]])
        numbers.append(number[found[late]])
    return np.concatenate(rows), np.concatenate(numbers)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_symbols`` (bytes), ``spans`` removed and ``kept`` bytes, one row for each row of ``docs``.

    A byte goes if a 50-byte string that covers it also starts in a document with
    a smaller doc_id.  Null text is empty; a null doc_id stays null and counts as
    the smallest; rows with one doc_id count as one document, so they never
    remove each other; extra columns are not read.
    """
    return without_repeats(docs, Kind(WINDOW, GRAM, False, byte_symbols, bytes), b"", later_windows)
