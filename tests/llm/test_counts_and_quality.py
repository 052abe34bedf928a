"""Collocations, source divergence and quality against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.llm import collocations, divergence, quality

SCHEMA = "doc_id long, text string, lang string, source string, score string, n string, rank string"
SF = "/root/testdata/sf0.01"


def corpus(seed=11, n=90):
    rng = random.Random(seed)
    vocabulary = ["of", "The", "the", "new", "york", "Ünder", "x1", "don't", "a-b", "İs", " z", "日本"] + [f"w{'abcdef'[i % 6]}{i}" for i in range(20)]
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, [9, 8, 7, 5, 5] + [1] * (len(vocabulary) - 5), k=rng.randint(0, 40))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for w in words)
        texts.append(text + (" new York City hall. " if i % 3 == 0 else ""))
    texts += ["", None, "   \n", "...", "new york " * 3000, texts[0], texts[0]]
    rows = [(i, t, rng.choice(["en", "en", "fr", None, "", "und"]), rng.choice(["s1", "s1", "s2", "s3", None]), "c", "c", "c")
            for i, t in enumerate(texts)]
    return rows + [(None, "new york", "en", "s1", "", "", ""), rows[2], rows[2], (7, None, "xx", "lone", "", "", ""), (8, "...", "xx", "none", "", "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def collocations_by_hand(rows, least, longest, top):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    subsumed = {(lang, p[i:j]) for (lang, p), v in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * v >= 100 * f[lang, p[i:j]]}
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if (lang, p) not in subsumed:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (6, 3, 7), (100, 5, 2000)])
def test_collocations(odd, least, longest, top):
    out = collocations.collocations(odd, least, longest, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = collocations_by_hand(corpus(), least, longest, top)
    assert want and sorted(map(tuple, out.collect())) == want


def test_collocations_do_not_depend_on_steps(odd, monkeypatch):
    want = sorted(map(tuple, collocations.collocations(odd, 3).collect()))
    monkeypatch.setattr(collocations, "STEP_BYTES", 200)
    monkeypatch.setattr(collocations, "STRIPE_CELLS", 2)
    monkeypatch.setattr(collocations, "HELD_CELLS", 30)
    monkeypatch.setattr(collocations, "SEGMENTS", 4)
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 64)
    monkeypatch.setattr(collocations, "MOST_BUCKETS", 64)
    assert sorted(map(tuple, collocations.collocations(odd.repartition(1), 3).collect())) == want


def test_buckets_drop_rare_phrases_only(odd):
    bits = collocations.full_buckets(odd, range(1, 3), 1 << 16, {}, 50)
    passed = collocations.merged(collocations.partial_stripes(odd, 2, 1 << 16, {1: bits, 2: bits}))
    every = collocations.merged(collocations.partial_stripes(odd, 2, 1 << 16, {}))
    frequent = {tuple(r) for r in every.where("n >= 50").collect()}
    assert frequent <= {tuple(r) for r in passed.collect()} <= {tuple(r) for r in every.collect()}
    assert passed.where("size > 0").count() < every.where("size > 0").count() // 4


def test_splits_do_not_multiply_cells(odd):
    """Partial stripes follow the cores, not the splits of the input."""
    def cells(stripes):
        return stripes.selectExpr("sum(size(words)) AS n").first().n

    few, many = (collocations.partial_stripes(odd.repartition(n), 2, 1 << 16, {}, 1000) for n in (1, 64))
    assert many.rdd.getNumPartitions() <= 2 * odd.sparkSession.sparkContext.defaultParallelism
    assert cells(many) <= 16 * cells(few)
    assert sorted(map(tuple, collocations.merged(many).collect())) == sorted(map(tuple, collocations.merged(few).collect()))


def divergence_by_hand(rows, least_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: [t for t, d in docs[lang].items() if d >= least_docs] for lang, _ in groups}

    def shares(lang, count):
        total, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + 1 * v) for t in kept[lang]}

    p = {g: shares(g[0], counts[g]) for g in groups}
    q = {lang: shares(lang, sum((counts[g] for g in groups if g[0] == lang), Counter())) for lang in kept}
    gain = lambda a, b: (a - b) * (a - b) // b
    out = []
    for g in groups:
        pairs = [(-sum(gain(p[g][t], p[o][t]) for t in kept[g[0]]), o[1].encode()) for o in groups if o[0] == g[0] and o != g]
        terms = [(-gain(p[g][t], q[g[0]][t]), t.encode()) for t in kept[g[0]] if counts[g][t] and p[g][t] > q[g[0]][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(*g, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "top"), [(3, 200), (1, 4), (1000, 200)])
def test_divergence(odd, least_docs, top):
    out = divergence.audit(odd, least_docs, top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == divergence_by_hand(corpus(), least_docs, top)


def test_divergence_does_not_depend_on_steps(odd, monkeypatch):
    for name, value in (("STEP_BYTES", 300), ("HELD_ROWS", 50), ("SHARD_ROWS", 20), ("BLOCK_CELLS", 6)):
        monkeypatch.setattr(divergence, name, value)
    kept, groups = divergence.kept_terms(odd, 1)
    pairs = divergence.pair_divergences(kept, groups, 20).collect()
    want = {(x[0], x[1], x[3]): x[4] for x in divergence_by_hand(corpus(), 1, 200) if x[2] == "pair"}
    assert {(r.lang, r.source, r["item"]): r.value for r in pairs} == want and len(pairs) == len(want)


def test_arithmetic_passes_64_bits(spark):
    n, total, terms = 7_000_000_000_000_000, 90_000_000_000_000_001, 12_345
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"),
                                collocations._score(F.lit(n), F.lit(total), F.lit(10 ** 16 + 7), F.lit(10 ** 16 + 1)).alias("s")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + terms)
    assert row.s == 1000 * n * total // ((10 ** 16 + 7) * (10 ** 16 + 1))


def test_empty_tables(spark, empty):
    assert collocations.collocations(empty).count() == 0
    assert divergence.audit(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_documents(empty, labels).count() == 0


def test_trees_against_a_walk_by_hand():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 6)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    model = quality.boost(x, y, trees=20)
    fresh = np.round(rng.normal(size=(300, 6)), 1)
    want = []
    for row in fresh:
        total = model["base"]
        for node in model["roots"]:
            while model["child"][node] != node:
                node = model["child"][node] + int(row[model["feature"][node]] > model["limit"][node])
            total += model["value"][node]
        want.append(1 / (1 + np.exp(-total)))
    got = quality.scores(fresh, model)
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert ((got >= 0.5) == ((fresh[:, 1] > 0.3) ^ (fresh[:, 4] > 0))).mean() > 0.95


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(6)
    grad, hess, count = rng.normal(size=(3, 4, 8)), rng.uniform(1, 2, (3, 4, 8)), rng.integers(0, 20, (3, 4, 8))
    gain, feature, at = quality._best_split(grad, hess, count)
    for node in range(3):
        best = 0.0
        for f in range(4):
            for b in range(8):
                left, right = slice(0, b + 1), slice(b + 1, 8)
                if min(count[node, f, left].sum(), count[node, f, right].sum()) < quality.LEAST_ROWS:
                    continue
                part = lambda s: grad[node, f, s].sum() ** 2 / (hess[node, f, s].sum() + quality.RIDGE)  # noqa: B023, E731
                best = max(best, part(left) + part(right) - part(slice(0, 8)))
        assert abs(gain[node] - best) < 1e-9
        assert 0 <= feature[node] < 4 and 0 <= at[node] < 8


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Two lines here.\nTwo lines here.", "", "ÄÖ ab1 $$$", "a", "\n\n", "x " * 5000]
    flat = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = quality.statistics(np.concatenate(flat), np.cumsum([0, *map(len, flat)]))
    alone = np.vstack([quality.statistics(f, np.array([0, len(f)])) for f in flat])
    assert whole.shape[1] == len(quality.STATISTICS) and np.array_equal(whole, alone) and np.isfinite(whole).all()
    at = quality.STATISTICS.index
    assert whole[0, at("distinct_lines")] == 0.5 and whole[0, at("distinct_words")] == 0.5 and whole[1].sum() == 0


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (4, None), (5, 9)], "doc_id long, quality int")
    out = quality.score_documents(odd, labels).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert sum(r.doc_id is None for r in out) == 1
    one_kind = quality.score_documents(odd, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(one_kind) == 1 and one_kind[0].score > 0.9


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) / len(out) >= 0.95
