"""Wide SimHash against brute force over shingle sets."""

from __future__ import annotations

import random

import numpy as np

from canopyflow.llm import wide_simhash as wide


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"other{rng.randrange(10 ** 6)}"
    return words


def test_copies_above_the_similarity_meet_and_other_texts_do_not(spark):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 300, 900]))]
        for k in range(4):
            text = " ".join(base if k == 0 else edited(base, rng.randint(0, len(base) // 80), rng))
            group[len(rows)] = g
            rows.append((len(rows), text if k < 3 else text.upper()))
    of = {r.doc_id: r.component_id for r in wide.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(group[i] == group[c] and c <= i for i, c in of.items())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if group[i] == group[j]]
    above = []
    for i, j in pairs:
        a, b = shingles(rows[i][1]), shingles(rows[j][1])
        if len(a & b) >= 0.85 * len(a | b):
            above.append(of[i] == of[j])
    assert len(above) > 100 and np.mean(above) >= 0.98


def test_links_equal_brute_force_in_small_and_large_buckets(monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 256, (3, wide.BYTES), np.uint8)
    fps = np.repeat(centre, 30, axis=0)
    for row in fps:
        for bit in rng.integers(0, 8 * wide.BYTES, 30):
            row[bit // 8] ^= np.uint8(1 << bit % 8)
    words = fps.view(np.uint64)
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(2) <= wide.MAX_BITS

    def groups(a, b):
        label = np.arange(len(fps))
        for _ in range(len(fps)):
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
        return label

    want = groups(*np.nonzero(near))
    for small, block in ((64, 512), (100, 512), (8, 16)):
        monkeypatch.setattr(wide, "SMALL", small)
        monkeypatch.setattr(wide, "BLOCK", block)
        got = groups(*wide.linked_rows(np.zeros(len(fps), np.int64), fps))
        assert (got == want).all()


def test_two_bits_in_one_segment_share_a_bucket():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (1, wide.BYTES), np.uint8)
    b = rng.integers(0, 256, (1, wide.BYTES), np.uint8)
    b[0, :3] = a[0, :3]
    b[0, 0] ^= np.uint8(3)
    assert np.intersect1d(wide.buckets(a), wide.buckets(b)).size == 2


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(4, None, "x"), (2, "", "x"), (9, " \n", "x"), (None, "one two", "x"), (7, "ONE  two", "x"), (7, "one two", "x"), (1, "one three", "x")],
        "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1), r.component_id) for r in wide.near_copies(docs).collect())
    assert got == [(-1, 7), (1, 1), (2, 2), (4, 2), (7, 7), (7, 7), (9, 2)]
    assert wide.near_copies(docs.limit(0)).count() == 0
