"""Near copies just above and just below the similarity of 0.8."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from canopyflow.llm import wide_simhash as wide
from pyspark.sql import functions as F


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_only_pairs_at_the_similarity_are_linked(spark):
    rng = random.Random(11)
    rows, above, below = [], [], []
    for g in range(250):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([60, 150, 400]))]
        # edits five apart or more take five shingles each; this many lead to 0.74 to 0.86
        n = len(base) - 4
        edits = max(1, round(n * rng.uniform(0.075, 0.15) / 5))
        other = list(base)
        for k in range(edits):
            other[5 + k * (len(base) // edits) % (len(base) - 10)] = f"other{g}-{k}"
        a, b = " ".join(base), " ".join(other)
        x, y = shingles(a), shingles(b)
        (above if 5 * len(x & y) >= 4 * len(x | y) else below).append(2 * g + 1)
        rows += [(2 * g, a), (2 * g + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, "").collect()}
    assert len(above) >= 50 and len(below) >= 50
    assert set(below) <= left and {2 * g for g in range(250)} <= left
    assert len([i for i in above if i not in left]) >= 0.98 * len(above)


def test_candidates_meet_once_in_their_buckets():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (1, wide.ROW_BYTES), np.uint8)
    fps = np.repeat(base, 12, axis=0)
    fps[:, wide.NODE_BYTES] = np.arange(12)
    for row in fps:
        for bit in rng.integers(0, 8 * wide.BYTES, 12):
            row[bit // 8] ^= np.uint8(1 << bit % 8)
    found = wide.buckets(fps)
    bucket, row = found.ravel(), np.repeat(np.arange(12), found.shape[1])
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], row[order]
    value = wide.segments(fps[row])
    got = set()
    for a, b in wide.close_pairs(bucket, fps[row]):
        w = wide.wanted_pairs(bucket, fps[row], value, a, b)
        got |= {(min(p), max(p)) for p in zip(row[a[w]].tolist(), row[b[w]].tolist())}
    assert got == {(i, j) for i in range(12) for j in range(i + 1, 12)}


def test_a_large_group_gives_few_pairs(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(600)]
    texts += [" ".join([f"v{rng.randrange(10 ** 6)}" for _ in range(120)]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = wide.nodes(docs).select("fp", F.col("fp").alias("label"))
    pairs = wide.candidates(distinct, False)
    assert 600 <= 2 * pairs.count() and pairs.count() < 600 * 40
    kept = sorted(r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, "").collect())
    assert kept == [0, *range(600, 620)]
