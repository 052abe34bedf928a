"""Quality scores by gradient-boosted trees over document statistics.

Each text becomes a row of statistics of its bytes, words and lines.  Trees are
grown on histograms of binned statistics of a bounded labelled sample; all trees
are flattened into four arrays, and tasks walk them with numpy, one level of all
trees and texts at a time.

The fit takes at most ``SAMPLE_ROWS`` labelled rows that are not held out, those
with the smallest hash; every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import slices, utf8
from canopyflow.llm.langid import held_out
from canopyflow.llm.words import byte_set, coded, runs, strings

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 80, 4, 64
RATE, RIDGE, LEAST_ROWS = 0.15, 1.0, 10
PREDICT_AT = 0.3
STEP_BYTES = 4_000_000
#: Kinds of bytes whose shares are statistics; what is in none is its own kind.
KINDS = {
    "lower": byte_set((0x61, 0x7A)), "upper": byte_set((0x41, 0x5A)), "digit": byte_set((0x30, 0x39)),
    "blank": byte_set((0x20, 0x20), (0x09, 0x09)), "line": byte_set((0x0A, 0x0D)), "beyond": byte_set((0x80, 0xFF)),
    "stop": byte_set(*((ord(c), ord(c)) for c in ".!?")), "comma": byte_set(*((ord(c), ord(c)) for c in ",;:")),
    "quote": byte_set(*((ord(c), ord(c)) for c in "'\"`")), "bar": byte_set((0x7C, 0x7C)),
    "bracket": byte_set(*((ord(c), ord(c)) for c in "()[]{}<>")), "dash": byte_set(*((ord(c), ord(c)) for c in "-_/\\")),
}
_KIND = np.full(256, len(KINDS), np.int64)
for _k, _inside in enumerate(KINDS.values()):
    _KIND[_inside] = _k
_ALPHA = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SPACE = byte_set((0x09, 0x0D), (0x20, 0x20))
_LINE_END = byte_set((0x0A, 0x0A))
STATISTICS = ([f"share_{k}" for k in [*KINDS, "other"]]
              + ["bytes", "words", "word_bytes", "word_spread", "short_words", "long_words", "plain_words", "upper_words",
                 "title_words", "marked_ends", "distinct_words", "top_word", "lines", "line_words", "distinct_lines", "same_as_before", "entropy"])


def _repeats(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and how often its commonest occurs."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    key, count = np.unique(row * (code.max() + 1) + code, return_counts=True)
    of = key // (code.max() + 1)
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    return np.bincount(of, minlength=n).astype(float), top


def statistics(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda count, total: count / np.maximum(total, 1)
    kinds = np.bincount(of_byte * (len(KINDS) + 1) + _KIND[flat], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    inside = ~_SPACE[flat]
    start, end, row = runs(inside, offsets)
    length = end - start
    per = lambda weights: np.bincount(row, weights, n)
    words = np.bincount(row, minlength=n).astype(float)
    mean = share(per(length), words)
    alpha, upper = np.r_[0, np.cumsum(_ALPHA[flat])], np.r_[0, np.cumsum(_KIND[flat] == 1)]
    letters, capitals = alpha[end] - alpha[start], upper[end] - upper[start]
    code, _ = coded(strings(flat, inside, start, end))
    distinct, top = _repeats(row, code, n)
    here = ~_LINE_END[flat]
    line_start, line_end, line_row = runs(here, offsets)
    lines = np.bincount(line_row, minlength=n).astype(float)
    line_code, _ = coded(strings(flat, here, line_start, line_end))
    distinct_lines, _ = _repeats(line_row, line_code, n)
    same = np.r_[False, (flat[1:] == flat[:-1]) & (of_byte[1:] == of_byte[:-1])] if len(flat) else np.zeros(0, bool)
    p = share(kinds, size[:, None])
    columns = [*p.T, np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, share(per(length.astype(float) ** 2), words) - mean ** 2)),
               share(per(length <= 3), words), share(per(length >= 20), words), share(per(letters == length), words),
               share(per((capitals == letters) & (letters > 1)), words),
               share(per((capitals == 1) & (letters > 1) & (_KIND[flat[start]] == 1)), words), share(per(~_ALPHA[flat[end - 1]]), words),
               share(distinct, words), share(top, words), np.log1p(lines), share(words, lines), share(distinct_lines, lines),
               share(np.bincount(of_byte, same, n), size), -(p * np.log(np.maximum(p, 1e-12))).sum(1)]
    return np.column_stack(columns)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.uint8)


def _best_split(grad: np.ndarray, hess: np.ndarray, count: np.ndarray):
    """Gain, statistic and bin of the best split of each node, from its histograms."""
    g, h, c = (np.cumsum(a, 2) for a in (grad, hess, count))
    whole_g, whole_h, whole_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
    gain = g ** 2 / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g ** 2 / (whole_h + RIDGE)
    gain[(c < LEAST_ROWS) | (whole_c - c < LEAST_ROWS)] = 0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    return flat[np.arange(len(flat)), at], at // gain.shape[2], at % gain.shape[2]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Trees on the logistic loss, flattened: node ``i`` asks whether statistic
    ``feature[i]`` is at most ``limit[i]`` and goes on to ``child[i]`` or the node
    after that; a leaf is its own child and adds ``value[i]``."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = _binned(x, edges).astype(np.int64)
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    score = np.full(n, base)
    feature, limit, child, value, roots = [], [], [], [], []

    def node() -> int:
        for column, start in ((feature, 0), (limit, np.inf), (child, len(child)), (value, 0.0)):
            column.append(start)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        roots.append(node())
        at, open_nodes = np.full(n, roots[-1]), [roots[-1]]
        for _ in range(depth):
            rank = np.full(len(feature), -1)
            rank[open_nodes] = np.arange(len(open_nodes))
            rows = np.flatnonzero(rank[at] >= 0)
            cell = ((rank[at[rows]][:, None] * width + np.arange(width)) * BINS + bins[rows]).ravel()
            shape = (len(open_nodes), width, BINS)
            sums = [np.bincount(cell, None if w is None else np.repeat(w[rows], width), np.prod(shape)).reshape(shape) for w in (grad, hess, None)]
            after = []
            for parent, gain, f, b in zip(open_nodes, *_best_split(*sums)):
                if gain <= 1e-9 or b >= len(edges[f]):
                    continue
                feature[parent], limit[parent] = int(f), float(edges[f][b])
                child[parent], right = node(), node()
                mine = at == parent
                at[mine] = np.where(bins[mine, f] <= b, child[parent], right)
                after += [child[parent], right]
            if not after:
                break
            open_nodes = after
        for leaf in np.unique(at):
            mine = at == leaf
            value[leaf] = RATE * float(grad[mine].sum() / (hess[mine].sum() + RIDGE))
        score += np.array(value)[at]
    return {"feature": np.array(feature), "limit": np.array(limit), "child": np.array(child), "value": np.array(value),
            "roots": np.array(roots), "base": base, "depth": depth}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities for rows of statistics: all trees go down one level at a time."""
    at = np.tile(model["roots"], (len(x), 1))
    rows = np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        right = x[rows, model["feature"][at]] > model["limit"][at]
        at = model["child"][at] + (right & (model["child"][at] != at))
    return 1 / (1 + np.exp(-(model["base"] + model["value"][at].sum(1))))


def _with_statistics(docs: DataFrame, kept: str, result: str, value) -> DataFrame:
    """Column ``kept`` of each row, and ``value`` of its text's statistics."""

    def measured(batches):
        for batch in batches:
            flat, offsets = utf8(batch.column(0))
            for a, b in slices(offsets, STEP_BYTES):
                x = statistics(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], value(x)], [kept, result.split(" ")[0]])

    plain = docs.select("text", kept)
    return plain.mapInArrow(measured, f"{kept} {plain.schema[kept].dataType.simpleString()}, {result}")


def learn(docs: DataFrame, labels: DataFrame, learn_from, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)`` where ``learn_from``
    holds.  Of several labels or texts of one id the smallest counts."""
    chosen = (labels.where("doc_id is not null and quality in (0, 1)").where(learn_from)
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = _with_statistics(sample, "quality", "x array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64()))).toArrow()
    y = rows["quality"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return {"constant": float((y.sum() + 0.5) / (len(y) + 1))}
    x = np.array(rows["x"].to_pylist())
    order = np.lexsort(x.T)
    return boost(x[order], y[order])


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from ``labels`` whose ids are not held out.  Null and empty texts have
    statistics of 0 and are scored by them; without both labels every score is
    the share of label 1; a null doc_id stays null, is not held out and is not
    learned from; repeated rows are all returned; extra columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, ~held_out(), sample_rows))

    def value(x):
        fixed = model.value.get("constant")
        return pa.array(scores(x, model.value) if fixed is None else np.full(len(x), fixed), pa.float64())

    return _with_statistics(docs, "doc_id", "score double", value).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
