"""Exact search for windows that repeat across documents, without a row per window.

A window is ``window`` consecutive symbols (bytes or words).  Each window is
routed by its anchor, the smallest hashed gram inside it: equal windows have
equal anchors at equal places, so they meet in one bucket.  Neighbouring windows
with the same anchor travel as one row, their span.

1. ``anchors``: documents are scanned once; per batch and bucket one packed row
   leaves the task.  Repeats of a whole span inside the batch are settled there,
   so that a common passage sends one row a batch.
2. ``settle``: in each bucket, spans that equal an earlier one are removed whole.
   Spans that share only their anchor gram with another one stay open.
3. ``fetch``: the symbols of open spans are cut out of the texts and meet again
   in their buckets, where the operator's own exact method decides every window.
4. ``keep``: removed spans meet their texts, which gives the kept ones.

Texts and spans meet in parts of about ``PART_BYTES`` of text, numbered by a
hash of the doc_id; the number of parts and buckets follows the input.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import NO_ID, ids_of, slices, stored, utf8

PART_BYTES = 10_000_000
#: Text whose spans a task holds at once.
BATCH_BYTES = 10_000_000
#: Symbols hashed in one step; positions in a step take the low bits of a sort key.
STEP = 1 << 20
POSITION = np.uint64((1 << 22) - 1)
ROUTED = "target long, kind string, payload binary"
_random = np.random.default_rng(20240607)
BYTE_HASH = _random.integers(0, 2 ** 64, 256, dtype=np.uint64)
MULTIPLIERS = _random.integers(0, 2 ** 64, 16, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Kind:
    """What is a symbol, and how long windows and anchor grams are.

    ``symbols`` turns bytes and document offsets into a hash per symbol and the
    offsets in symbols; ``cut`` splits a text into a sequence that can be sliced.
    ``by_start``: an earlier start in the same document counts as earlier.
    """

    window: int
    gram: int
    by_start: bool
    symbols: Callable
    cut: Callable


def byte_symbols(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[flat], offsets


def word_symbols(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word between ASCII white space."""
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    before = np.r_[False, inside[:-1]] if len(flat) else inside
    before[offsets[:-1][offsets[:-1] < len(flat)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(inside & ~before) - 1
    place = np.arange(len(flat)) - starts[np.maximum(word, 0)]
    place[~inside] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, MULTIPLIERS[15]), dtype=np.uint64)
    value = BYTE_HASH[flat] * powers[place]
    value[~inside] = 0
    hashed = np.add.reduceat(value, starts)
    return mixed(hashed), np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIERS[14]
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    x = left * MULTIPLIERS[level] + right
    return x ^ (x >> np.uint64(31))


def _level(size: int) -> int:
    return size.bit_length() - 1


def spans(symbols: np.ndarray, offsets: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Document row, first symbol in the document, windows, anchor gram and content of each span."""
    w, g = kind.window, kind.gram
    if len(symbols) < w:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    doubled = [symbols]
    for level in range(_level(w)):
        h = doubled[-1]
        doubled.append(_joined(h[:-(1 << level)], h[1 << level:], level))
    half = 1 << _level(g)
    h = doubled[_level(g)]
    grams = mixed(_joined(h[:len(symbols) - g + 1], h[g - half:], 8))
    low = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    reach, size = w - g + 1, 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:len(symbols) - w + 1], low[reach - size:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(row[:len(low)] == row[w - 1:])
    if not len(at):
        return spans(symbols[:0], offsets[:1], kind)
    anchor = (low[at] & POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(anchor) != 0)])
    windows, start, anchor = np.diff(np.r_[first, len(at)]), at[first], anchor[first]
    h, block = doubled[_level(w)], 1 << _level(w)
    length = windows + w - 1
    content = _joined(_joined(h[start], h[start + (length - block) // 2], 9), h[start + length - block], 10)
    content = mixed(_joined(content, (anchor - start).astype(np.uint64) << np.uint64(32) | length.astype(np.uint64), 11))
    return row[start], start - offsets[row[start]], windows, grams[anchor], content


def all_spans(flat: np.ndarray, offsets: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """``spans`` of any number of documents of any length, in steps."""
    out = []
    for a, b in slices(offsets, STEP):
        symbols, where = kind.symbols(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        for at in range(0, max(1, len(symbols)), STEP) if b == a + 1 else [0]:
            part = symbols[at:at + STEP + kind.window - 1] if b == a + 1 else symbols
            found = spans(part, where if b > a + 1 else np.array([0, len(part)]), kind)
            out.append((found[0] + a, found[1] + at, *found[2:]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else spans(np.zeros(0, np.uint64), np.zeros(1, np.int64), kind)


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _later(kind: Kind, doc, start, content, gram):
    """Order by gram, content, document and start; which rows equal an earlier one."""
    order = np.lexsort((start, doc, content, gram))
    doc, content, gram = doc[order], content[order], gram[order]
    fresh = np.r_[True, (content[1:] != content[:-1]) | (gram[1:] != gram[:-1])] if len(order) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0)) if len(doc) else order
    later = doc > doc[head]
    if kind.by_start:
        later |= (doc == doc[head]) & (start[order] > start[order][head])
    return order, later, fresh


#: Rows on their way: doc_id and tag once per run of rows, then start, windows and the columns that follow.
def _packed(doc, tag, start, windows, *more) -> bytes:
    run = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    return pickle.dumps((doc[run], tag[run].astype(np.uint32), np.diff(np.r_[run, len(doc)]).astype(np.uint32),
                         start.astype(np.uint32) if start.max() < 2 ** 32 else start, windows.astype(np.uint16), *more), 5)


def _unpacked(payloads) -> list[np.ndarray]:
    rows = []
    for p in payloads:
        doc, tag, n, start, windows, *more = pickle.loads(p)
        rows.append((np.repeat(doc, n), np.repeat(tag, n).astype(np.int64), start.astype(np.int64), windows.astype(np.int64), *more))
    return [np.concatenate(x) for x in zip(*rows)]


def _dealt(target, chosen, *columns):
    """(target, packed rows) of the chosen rows, sorted by document."""
    order = np.flatnonzero(chosen)
    order = order[np.lexsort((columns[2][order], columns[1][order], columns[0][order], target[order]))]
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(target[own[0]]), _packed(*(c[own] for c in columns))


def _routed(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()))],
                                      ["target", "kind", "payload"])


def tags_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tell rows apart that share a doc_id."""
    whole = flat.tobytes()
    return np.array([zlib.crc32(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)


def _short(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (gram >> np.uint64(32)).astype(np.uint32), (gram >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)


def _wide(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64)


def anchors(docs: DataFrame, kind: Kind, parts: int) -> DataFrame:
    def found(batches):
        for batch in batches:
            every, places = utf8(batch.column(1))
            docs_of, tags = ids_of(batch.column(0)), tags_of(every, places)
            for a, b in slices(places, BATCH_BYTES):
                flat, offsets = every[places[a]:places[b]], places[a:b + 1] - places[a]
                row, start, windows, gram, content = all_spans(flat, offsets, kind)
                doc, tag = docs_of[a:b][row], tags[a:b][row]
                order, later, _ = _later(kind, doc, start, content, gram)
                doc, tag, start, windows, gram, content = (x[order] for x in (doc, tag, start, windows, gram, content))
                bucket = ((gram >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
                rows = [(-1 - p, "done", x) for p, x in _dealt(part_of(doc, parts), later, doc, tag, start, windows)]
                rows += [(k, "span", x) for k, x in _dealt(bucket, ~later, doc, tag, start, windows, *_short(gram), *_short(content))]
                if rows:
                    yield _routed(rows)

    return docs.select("doc_id", "text").mapInArrow(found, ROUTED)


def settle(routed: DataFrame, kind: Kind, parts: int) -> DataFrame:
    """``done`` rows of whole spans to remove and ``open`` rows, both by part."""

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        target = int(pdf["target"].iloc[0])
        if target < 0:
            return pdf.assign(target=-1 - target)
        doc, tag, start, windows, *keys = _unpacked(pdf["payload"])
        gram, content = _wide(*keys[:2]), _wide(*keys[2:])
        order, later, fresh = _later(kind, doc, start, content, gram)
        doc, tag, start, windows, gram = (x[order] for x in (doc, tag, start, windows, gram))
        head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        own = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(gram)]))
        several = np.add.reduceat(fresh.astype(int), head) > 1
        if not kind.by_start:
            several &= np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)
        part = part_of(doc, parts)
        rows = [(p, "done", x) for p, x in _dealt(part, later, doc, tag, start, windows)]
        rows += [(p, "open", x) for p, x in _dealt(part, ~later & several[own], doc, tag, start, windows, gram)]
        return pd.DataFrame(rows, columns=["target", "kind", "payload"])

    return routed.groupBy("target").applyInPandas(settled, ROUTED)


def texts(docs: DataFrame, parts: int) -> DataFrame:
    """The documents of each part, a compressed block for each batch they come from."""

    def blocks(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            doc, tag, whole = ids_of(batch.column(0)), tags_of(flat, offsets), flat.tobytes()
            part = part_of(doc, parts)
            order = np.argsort(part, kind="stable")
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                held = pickle.dumps((doc[own], tag[own], [whole[offsets[i]:offsets[i + 1]] for i in own]), 5)
                rows.append((int(part[own[0]]), "text", pack.compress(held)))
            if rows:
                yield _routed(rows)

    return docs.select("doc_id", "text").mapInArrow(blocks, ROUTED)


def _documents(pdf: pd.DataFrame):
    unpack = zstandard.ZstdDecompressor()
    for block in pdf["payload"]:
        yield from zip(*pickle.loads(unpack.decompress(block)))


def _by_document(payloads) -> tuple[dict, list[np.ndarray]]:
    """Row ranges of each (doc_id, tag), rows sorted by it and by start."""
    columns = _unpacked(payloads)
    order = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    doc, tag = columns[:2]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    return {(int(doc[a]), int(tag[a])): (a, b) for a, b in zip(head, np.r_[head[1:], len(doc)])}, columns


def fetch(texts_of: DataFrame, opened: DataFrame, kind: Kind, parts: int) -> DataFrame:
    """The symbols of open spans, by bucket of their gram."""

    def fetched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            ranges, (doc, tag, start, windows, gram) = _by_document(right["payload"])
            taken, content = [], []
            for d, t, text in _documents(left):
                if (int(d), int(t)) in ranges:
                    a, b = ranges.pop((int(d), int(t)))  # a repeated row needs no second look
                    whole = kind.cut(text)
                    for i in range(a, b):
                        taken.append(i)
                        content.append(whole[start[i]:start[i] + windows[i] + kind.window - 1])
            taken = np.array(taken, int)
            bucket = (gram[taken] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                i = taken[own]
                rows.append((int(bucket[own[0]]), "content", zlib.compress(pickle.dumps(
                    (doc[i], tag[i], start[i], windows[i], gram[i], [content[k] for k in own]), 5), 1)))
        return pd.DataFrame(rows, columns=["target", "kind", "payload"])

    return texts_of.groupBy("target").cogroup(opened.groupBy("target")).applyInPandas(fetched, ROUTED)


def decide(fetched: DataFrame, kind: Kind, parts: int, later_windows: Callable) -> DataFrame:
    """``done`` rows of single windows; ``later_windows(doc, start, windows, gram, content)``
    gives span rows and window numbers of windows that occur earlier."""

    def decided(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [pickle.loads(zlib.decompress(p)) for p in pdf["payload"]]
        doc, tag, start, windows, gram = (np.concatenate([h[k] for h in held]) for k in range(5))
        row, window = later_windows(doc, start, windows, gram, [c for h in held for c in h[5]])
        doc, tag, start = doc[row], tag[row], start[row] + window
        rows = [(p, "done", x) for p, x in _dealt(part_of(doc, parts), np.ones(len(doc), bool), doc, tag, start, np.ones(len(doc), int))]
        return pd.DataFrame(rows, columns=["target", "kind", "payload"])

    return fetched.groupBy("target").applyInPandas(decided, ROUTED)


def steps_of(head: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """Row numbers that cut groups, which start at ``head``, into steps of about
    ``size``; ``total`` is the running size of the rows."""
    cut = np.searchsorted(total[head], np.arange(0, total[-1], size), "right") - 1
    return np.r_[np.unique(head[np.maximum(cut, 0)]), len(total)]


def removed_runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges sorted by start, touching ones merged."""
    furthest = np.maximum.accumulate(end)
    head = np.flatnonzero(np.r_[True, start[1:] > furthest[:-1]])
    return list(zip(start[head].tolist(), furthest[np.r_[head[1:], len(start)] - 1].tolist()))


def keep(texts_of: DataFrame, done: DataFrame, kind: Kind, glue: bytes) -> DataFrame:
    """``doc_id, n_symbols, spans, kept``: what stays of every document."""

    def rest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ranges, columns = _by_document(right["payload"]) if len(right) else ({}, None)
        rows = []
        for d, t, text in _documents(left) if len(left) else []:
            whole, runs = kind.cut(text), []
            if (int(d), int(t)) in ranges:
                a, b = ranges[int(d), int(t)]
                start, windows = columns[2][a:b], columns[3][a:b]
                runs = removed_runs(start, start + windows + kind.window - 1)
            edges = [0, *(x for r in runs for x in r), len(whole)]
            pieces = [whole[x:y] for x, y in zip(edges[::2], edges[1::2])]
            kept = b"".join(pieces) if isinstance(whole, bytes) else glue.join(w for p in pieces for w in p)
            rows.append((None if d == NO_ID else int(d), len(whole), [{"start": x, "end": y} for x, y in runs], kept))
        return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "n_symbols": [r[1] for r in rows],
                             "spans": [r[2] for r in rows], "kept": [r[3] for r in rows]})

    return texts_of.groupBy("target").cogroup(done.groupBy("target")).applyInPandas(
        rest, "doc_id long, n_symbols long, spans array<struct<start:long,end:long>>, kept binary")


def without_repeats(docs: DataFrame, kind: Kind, glue: bytes, later_windows: Callable) -> DataFrame:
    """All four steps; see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-n_bytes // PART_BYTES))
    first = stored(settle(anchors(docs, kind, parts), kind, parts), "spans")
    opened = first.where("kind = 'open'")
    second = decide(fetch(texts(docs, parts), opened, kind, parts), kind, parts, later_windows)
    return keep(texts(docs, parts), first.where("kind = 'done'").union(second), kind, glue)
