"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are put into lists by k-means centres fitted on a bounded sample.  Inside
a probed list, vectors are rotated at random and scanned in blocks of columns:
after a block, a random share of the difference to the query is known, which
estimates its whole length.  Candidates whose inner product is, by a test on that
estimate, unlikely to reach the query's bar are abandoned.  Those that remain are
scored exactly on the original vectors.  The bar is what twice the wanted number
of sampled vectors in the probed lists reach; queries that find too few are
scanned once more without it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.llm.common import stored

#: Rows the centres are fitted on, at most.
SAMPLE_ROWS = 20_000
NEAREST = 20
#: Share of the lists that a query probes.
PROBED = 0.8
COLUMNS = 16
#: Standard deviations that a squared distance may lie below what the columns seen suggest.
DEVIATIONS = 2.5
CELL_ROWS, CELL_QUERIES = 4096, 2048
#: Queries scanned at once, and pairs scored at once.
STEP_QUERIES, PAIRS = 128, 100_000


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) without vectors that are null, zero or hold null or
    non-finite components, rows without id, and vectors of a rare dimension."""
    held = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    held = held.where("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    sizes = held.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return held.where(F.size("v") == (sizes["n"] if sizes else 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty lists keep their centre."""
    sample = unit(sample)
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(sample[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=lists) > 0
        centres[filled] = unit(sums[filled])
    return centres


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((size, size)))[0]


def top(ids: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` pairs of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    _, first, count = np.unique(query[order], return_index=True, return_counts=True)
    return order[np.arange(len(order)) - np.repeat(first, count) < k]


def scan(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of one cell for each query, by adaptive scan.

    Columns are added block by block.  A pair is abandoned where the length that
    the seen columns suggest puts it below the query's bar; a vector that no query
    of the step wants any more leaves the blocks that follow.
    """
    size = vectors.shape[1]
    turn = rotation(size)
    rotated, asked = vectors @ turn, queries @ turn
    bars = bars - 1e-9 * (1 + np.where(np.isfinite(bars), np.abs(bars), 0))
    ends = [*range(COLUMNS, size, COLUMNS), size]
    own_sq, query_sq = np.cumsum(rotated ** 2, 1), np.cumsum(asked ** 2, 1)
    out = []
    for at in range(0, len(queries), STEP_QUERIES):
        q = slice(at, at + STEP_QUERIES)
        left, lo = np.arange(len(ids)), 0
        part = np.zeros((len(asked[q]), len(ids)))
        alive = query_ids[q, None] != ids
        for hi in ends:
            part += asked[q, lo:hi] @ rotated[left, lo:hi].T
            lo = hi
            if hi < size:
                # inner product = (both squared lengths - squared distance) / 2, the distance from the columns seen
                scale = size / hi / (1 + DEVIATIONS * math.sqrt(2 / hi * (1 - hi / size)))
                own = (own_sq[left, -1] - scale * own_sq[left, hi - 1]) / 2
                need = bars[q] - (query_sq[q, -1] - scale * query_sq[q, hi - 1]) / 2
                alive &= scale * part + own >= need[:, None]
                wanted = alive.any(0)
                if wanted.mean() < 0.75:
                    left, part, alive = left[wanted], part[:, wanted], alive[:, wanted]
        row, column = np.nonzero(alive & (part >= bars[q, None]))
        column, row = left[column], row + at
        score = np.concatenate([np.zeros(0), *((vectors[column[i:i + PAIRS]] * queries[row[i:i + PAIRS]]).sum(1) for i in range(0, len(row), PAIRS))])
        best = top(ids[column], row, score, k)
        out.append(pd.DataFrame({"query_id": query_ids[row[best]], "vec_id": ids[column[best]], "score": score[best]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = NEAREST, probed: float = PROBED) -> DataFrame:
    """``query_id, rank, vec_id, score`` by largest inner product, ties to the smaller vec_id.

    Queries are the rows where ``is_query`` holds; every other row is a candidate.
    All candidates come back where there are fewer than ``k``.  An empty table
    gives an empty result; rows that repeat an id count once for each row, but
    never for a query of their id; extra columns are not read.
    """
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    held = stored(usable(vectors), "vectors")
    total = held.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r["v"] for r in held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()])
    # lists grow with the root of the rows, and so does what each query is sent to
    lists = int(min(max(1, total ** 0.5 // 4), 1024, len(sample)))
    centres = fit_centres(sample, lists)
    sample_list = (sample @ centres.T).argmax(1)

    def assigned(batches):
        for batch in batches:
            v = np.stack(batch["v"]) if len(batch) else np.zeros((0, centres.shape[1]))
            yield batch[["vec_id", "v"]].assign(list=(v @ centres.T).argmax(1))

    listed = stored(held.mapInPandas(assigned, "vec_id long, v array<double>, list int"), "listed")
    size = np.zeros(lists, int)
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["list"]] = r["n"]
    salts = -(-size // CELL_ROWS)
    least = max(1, math.ceil(probed * lists))

    def bars_of(v: np.ndarray, probed_lists: list[np.ndarray]) -> np.ndarray:
        bars = np.full(len(v), -np.inf)
        for at in range(0, len(v), STEP_QUERIES):
            score, open_lists = v[at:at + STEP_QUERIES] @ sample.T, np.zeros((len(v[at:at + STEP_QUERIES]), lists), bool)
            for mask, own in zip(open_lists, probed_lists[at:at + STEP_QUERIES]):
                mask[own] = True
            score[~open_lists[:, sample_list]] = -np.inf
            if score.shape[1] > 2 * k:  # one more for the query itself
                bars[at:at + STEP_QUERIES] = -np.partition(-score, 2 * k, 1)[:, 2 * k]
        return bars

    def probes(batches):
        for batch in batches:
            v = np.stack(batch["v"]) if len(batch) else np.zeros((0, centres.shape[1]))
            order = np.argsort(-(v @ centres.T), 1, kind="stable")
            enough = (np.cumsum(size[order], 1) > k).argmax(1) + 1
            enough = np.where(size.sum() > k, np.maximum(enough, least), lists)
            opened = [o[:n] for o, n in zip(order, enough)]
            yield batch[["vec_id", "v"]].assign(list=opened, bar=bars_of(v, opened))

    def every_list(batches):
        for batch in batches:
            yield batch[["vec_id", "v"]].assign(list=[np.arange(lists)] * len(batch), bar=-np.inf)

    per_list = F.array(*(F.lit(int(n)) for n in salts))
    cell = ["list", "salt", "chunk"]

    def cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
        return scan(left["vec_id"].to_numpy(), np.stack(left["v"]), right["vec_id"].to_numpy(), np.stack(right["v"]),
                    right["bar"].to_numpy(), k)

    def searched(asked: DataFrame, opened, share: float) -> DataFrame:
        chunks = max(1, math.ceil(2 * asked.count() * share / CELL_QUERIES))
        queries = (asked.mapInPandas(opened, "vec_id long, v array<double>, list array<int>, bar double")
                   .withColumn("list", F.explode("list")).where(F.get(per_list, F.col("list")) > 0)
                   .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
                   .withColumn("salt", F.explode(F.sequence(F.lit(0), F.get(per_list, F.col("list")) - 1))))
        base = (listed.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.get(per_list, F.col("list"))).cast("int"))
                .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
        found = base.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(cells, out)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = held.where(is_query)
    found = stored(searched(asked, probes, max(probed, least / lists)), "found")
    whole = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(asked.join(whole, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(whole.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(searched(short, every_list, 1.0))
