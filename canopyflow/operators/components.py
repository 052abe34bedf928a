"""Connected components by alternating star contraction.

Every round replaces the neighbours of a node by links to the smallest node it
knows, once towards larger neighbours and once towards smaller ones.  The edge
set shrinks to one star per component in a number of rounds that grows with the
logarithm of the longest path.  Edges and labels are merged where they lie: their
files are small enough to be broadcast in every round, which would send each one
through the driver.  Edges that lie beside each other can be replaced by stars
inside tasks first, which leaves few rounds to do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.operators.skew import HOT_SHARE, MIN_HOT_ROWS, salted_join
from canopyflow.session import cut_lineage, rounds

#: Edges that a task contracts at once.
HELD_EDGES = 200_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node each of ``n`` nodes is linked to: roots are hung below smaller
    ones until no edge has two."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _stars(edges: pa.Table, keys: Sequence[str]) -> pa.RecordBatch:
    """Edges ``a, b`` from each node to the smallest one that ``edges`` lead to."""
    edges = edges.combine_chunks().to_batches()[0]
    key = np.zeros(len(edges), np.int64)
    for k in keys:
        code = edges[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.unique(key * (code.max() + 1) + code, return_inverse=True)[1]
    both, node = np.r_[key, key], np.r_[edges["a"].to_numpy(), edges["b"].to_numpy()]
    order = np.lexsort((node, both))
    first = np.r_[True, (both[order][1:] != both[order][:-1]) | (node[order][1:] != node[order][:-1])]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(first) - 1
    at = order[first]
    root = _roots(code[:len(key)], code[len(key):], len(at))
    moved = np.flatnonzero(root != np.arange(len(at)))
    rows = pa.array(at[moved] % len(key))
    return pa.RecordBatch.from_arrays([*(edges[k].take(rows) for k in keys), pa.array(node[at[moved]]), pa.array(node[at[root[moved]]])],
                                      [*keys, "a", "b"])


def contracted(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``edges(keys, a, b)`` with those that a task reads one after the other replaced by
    stars with the same components."""
    keys = list(keys)
    edges = edges.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD_EDGES:
                yield _stars(pa.Table.from_batches(held), keys)
                held, n = [], 0
        if n:
            yield _stars(pa.Table.from_batches(held), keys)

    return edges.mapInArrow(stars, edges.schema)


def _with_smallest(edges: DataFrame, keys: Sequence[str], n_edges: int) -> DataFrame:
    """Edges ``u -> v`` with the smallest neighbour of ``u``; hubs are spread.

    At most ``HOT_SHARE`` nodes can be hubs, and below ``MIN_HOT_ROWS`` edges none.
    """
    node = [*keys, "u"]
    smallest = edges.groupBy(*node).agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree"))
    if n_edges <= MIN_HOT_ROWS:
        return edges.join(smallest.drop("degree").hint("merge"), node)
    hubs = smallest.where(F.col("degree") > max(n_edges // HOT_SHARE, MIN_HOT_ROWS))
    return salted_join(edges, smallest.drop("degree"), node, ["v"], hubs.select(*node))


def _large_star(edges: DataFrame, keys: Sequence[str], n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    known = _with_smallest(both, keys, 2 * n_edges)
    return (known.where(F.col("v") > F.col("u"))
            .select(*keys, F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct())


def _small_star(edges: DataFrame, keys: Sequence[str], n_edges: int) -> DataFrame:
    """Expects edges from larger to smaller nodes."""
    known = _with_smallest(edges, keys, n_edges)
    links = known.select(*keys, F.inline(F.array(
        F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
        F.struct(F.col("u").alias("u"), F.col("low").alias("v")))))
    return links.where(F.col("u") > F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first())


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str],
                         max_rounds: int = 60) -> DataFrame:
    """``nodes(keys, node)`` with ``label``, the smallest node of each component.

    ``edges(keys, a, b)`` may come in any direction and with repeats.
    """
    keys = list(keys)
    with rounds(nodes.sparkSession) as written:
        current = written(edges.where(F.col("a") != F.col("b"))
                          .select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        state = _state(current)
        for _ in range(max_rounds):
            n_edges = state[0]
            wide = written(_large_star(current, keys, n_edges))
            current = written(_small_star(wide, keys, 2 * n_edges))
            before, state = state, _state(current)
            if state == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        labels = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        return cut_lineage(nodes.join(labels.hint("merge"), [*keys, "node"], "left")
                           .withColumn("label", F.coalesce("root", "node")).drop("root"))
