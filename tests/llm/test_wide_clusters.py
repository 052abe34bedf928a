"""Large groups of near copies: what is sent grows with the rows, and no link is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest
from canopyflow.llm import wide_simhash as wide
from canopyflow.llm.common import stored


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def alike(rng, n, words, edits, name):
    """``n`` texts that differ from one text in ``edits`` own words each."""
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(5, words - 5), edits):
            text[at] = f"{name}{i}-{at}"
        out.append(" ".join(text))
    return out


def exact(texts):
    """The smallest row reachable over pairs of similarity 0.8 or more."""
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                low[b] = a
    return [top(i) for i in range(len(texts))]


def test_groups_around_the_similarity_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wide, "BLOCK_TEXTS", 40)
    rng = random.Random(21)
    # each text has about 0.87 of the middle one in common: 0.7 to 0.8 with each other
    texts = alike(rng, 120, 150, 4, "a") + alike(rng, 60, 150, 2, "b") + alike(rng, 60, 60, 1, "c") + alike(rng, 20, 80, 30, "d")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in wide.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == exact(texts)


@pytest.mark.parametrize("edits", [2, 6])
def test_rows_grow_with_the_group(spark, monkeypatch, edits):
    """Similarities of about 0.88 and 0.68."""
    written = {}

    def counted(df, name):
        out = stored(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(wide, "stored", counted)
    sent = []
    for n in (600, 1200, 2400):
        texts = alike(random.Random(n), n, 160, edits, "a")
        written.clear()
        of = wide.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert of.select("component_id").distinct().count() == (1 if edits == 2 else n)
        sent.append(written["wide-candidates"] + written["wide-found"])
    assert all(b <= 2.4 * a for a, b in zip(sent, sent[1:])), sent


def test_parted_pairs_are_whole(monkeypatch):
    monkeypatch.setattr(wide, "FEW", 8)
    rng = np.random.default_rng(2)
    fps = np.repeat(rng.integers(0, 256, (3, wide.ROW_BYTES), np.uint8), [40, 5, 3], axis=0)
    fps[:, wide.NODE_BYTES] = np.arange(len(fps))
    for row in fps:
        for bit in rng.integers(0, 8 * wide.BYTES, 12):
            row[bit // 8] ^= np.uint8(1 << bit % 8)
    found = wide.buckets(fps)
    bucket, row = found.ravel(), np.repeat(np.arange(len(fps)), found.shape[1])
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], row[order]
    pairs, root = set(), np.arange(len(fps))
    for a, b, kind in wide.parted(bucket, fps[row]):
        if kind:
            root = wide.joined(root, row[a], row[b])
        else:
            pairs |= {(min(p), max(p)) for p in zip(row[a].tolist(), row[b].tolist())}
    groups = np.repeat([0, 1, 2], [40, 5, 3])
    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            assert groups[i] != groups[j] or (i, j) in pairs or root[i] == root[j]
    assert len(np.unique(root[:40])) == 1 and (root[40:] == np.arange(40, 48)).all()


def test_common_shingles():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(90)]
    sets[3] = np.zeros(0, np.int64)
    rows = np.repeat(np.arange(90), [len(s) for s in sets])
    got = wide.common_shingles(rows, np.concatenate(sets), 90)
    for i in range(90):
        for j in range(90):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert wide.common_shingles(np.zeros(0, int), np.zeros(0, int), 2).sum() == 0
