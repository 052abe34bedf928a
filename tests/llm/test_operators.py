"""Operators against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.llm import (ann, langid, line_dedup, linked, packing, sharding, simhash, substring_dedup, suffix_dedup,
                            templates, toxicity)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, shard string"


def corpus(seed=3, n=60):
    """Documents with copies, shared passages, repeated lines, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, notice = line(40), [line(6), line(5), "", line(4)]
    texts = []
    for i in range(n):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        if i % 4 == 0:
            lines[1:1] = notice
        texts.append("\n".join(lines))
    texts += texts[:6] + [line(3) + " " + "a b " * 60, "", "   \n\t\n", "x", "É" * 70 + " y", None, ""]
    rows = [(i * 7 % 101, t, "en", "s", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(None, texts[0], None, None, None, None, None, None), rows[2], rows[2]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, odd, empty):
    out = packing.pack_documents(odd, capacity=64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in corpus():
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r[0], k, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.1 * sum(r.length for r in out) / 64 + 2
    assert packing.pack_documents(empty).count() == 0


def test_words_are_tokenised_like_texts():
    coder = packing.WordIds(packing.default_tokenizer())
    texts = ["Don't stop. NOW!! it's 3.14, o'clock... Éa. İx. ﬁn ΑΣ. a b\tc\n<|endoftext|>. <|startoftext|>x 'S 'll. 日本。", "", " . , "]
    for t in texts:
        want = np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.encode([t])[0] == want


def test_plan_holds_every_piece_and_fills_sequences():
    rng = np.random.default_rng(1)
    histogram = dict(zip(*map(lambda x: x.tolist(), np.unique(np.minimum(4096, rng.lognormal(6, 1.2, 30_000).astype(int) + 1), return_counts=True))))
    plan, held = packing.plan_sequences(histogram), {}
    for n, pieces in plan:
        assert sum(t * k for t, k in pieces.items()) <= 4096
        for t, k in pieces.items():
            held[t] = held.get(t, 0) + n * k
    assert held == histogram
    total = sum(t * n for t, n in histogram.items())
    assert sum(n for n, _ in plan) <= 1.01 * total / 4096 + 1


def brute_spans(rows, window, cut, by_start):
    """What each row keeps, as tuples; a null id sorts first, equal rows do not count."""
    seq = [(-1 if r[0] is None else r[0], cut((r[1] or "").encode())) for r in rows]
    starts = {}
    for doc, u in seq:
        for p in range(len(u) - window + 1):
            key = bytes(u[p:p + window]) if isinstance(u, bytes) else tuple(u[p:p + window])
            place = (doc, p) if by_start else (doc,)
            starts[key] = min(starts.get(key, place), place)
    out = []
    for doc, u in seq:
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - window + 1):
            key = bytes(u[p:p + window]) if isinstance(u, bytes) else tuple(u[p:p + window])
            if starts[key] < ((doc, p) if by_start else (doc,)):
                gone[p:p + window] = True
        keep = [x for x, g in zip(u, gone) if not g]
        out.append((doc, bytes(keep) if isinstance(u, bytes) else b" ".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("part", [10_000_000, 700])
def test_repeated_bytes(odd, empty, monkeypatch, part):
    from canopyflow.llm import repeats

    monkeypatch.setattr(repeats, "PART_BYTES", part)
    monkeypatch.setattr(repeats, "STEP", 1000)
    out = suffix_dedup.remove_repeated_bytes(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept)) for r in out) == brute_spans(corpus(), 50, bytes, False)
    assert all(len(r.kept) == r.n_symbols - sum(s.end - s.start for s in r.spans) for r in out)
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("part", [10_000_000, 700])
def test_repeated_words(odd, empty, monkeypatch, part):
    from canopyflow.llm import repeats

    monkeypatch.setattr(repeats, "PART_BYTES", part)
    out = substring_dedup.remove_repeated_words(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept)) for r in out) == brute_spans(corpus(), 20, bytes.split, True)
    assert substring_dedup.remove_repeated_words(empty).count() == 0


def test_suffix_automaton_finds_first_occurrences():
    rng = random.Random(5)
    for _ in range(50):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        begins = []
        for t in texts:
            begins.append(automaton.read)
            automaton.add(t)
        first = {}
        for t, b in zip(texts, begins):
            for p in range(len(t) - 3):
                first.setdefault(t[p:p + 4], b + p + 3)
        for t in [*texts, "abbaabab"]:
            assert automaton.earliest(t, 4) == [first.get(t[p:p + 4], -1) for p in range(len(t) - 3)]


def test_lines(odd, empty):
    rows = corpus()
    seq = []
    for i, r in enumerate(rows):
        lines = None if r[1] is None else r[1].split("\n")
        full = [k for k, x in enumerate(lines or []) if x.strip(" \t\r")]
        seq.append(((-1 if r[0] is None else r[0]), lines, full))
    first = {}
    for doc, lines, full in seq:
        for p in range(len(full) - 1):
            key = lines[full[p]], lines[full[p + 1]]
            first[key] = min(first.get(key, (doc, p)), (doc, p))
    want = []
    for doc, lines, full in seq:
        gone = set()
        for p in range(len(full) - 1):
            if first[lines[full[p]], lines[full[p + 1]]] < (doc, p):
                gone |= {full[p], full[p + 1]}
        want.append((doc, None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    out = line_dedup.remove_repeated_lines(odd)
    assert out.columns == [*odd.columns, "n_lines_removed"]
    key = lambda x: (x[0], x[1] or "", x[2])
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines_removed) for r in out.collect()), key=key) == sorted(want, key=key)
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    windows = line_dedup.named_windows(odd.where("text is not null"), 3)
    assert windows.count() == sum(max(0, len(f) - 2) for _, x, f in seq if x is not None)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 21), (21, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in linked.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3, 9)} == {1} and got[6] == 5 and got[21] == 20
    assert {got[100 + i] for i in range(41)} == {100}


def brute_components(fps, near=3):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(odd, empty):
    rows = corpus()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    fps = [simhash.fingerprint(lower(r[1]).encode()) for r in rows]
    label = brute_components(fps)
    least = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    want = sorted((-1 if r[0] is None else r[0], f"{f:016x}", least[x]) for r, f, x in zip(rows, fps, label))
    out = simhash.near_duplicates(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in out) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_dense_and_sparse_fingerprints_link_alike(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(12)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    links = simhash.links_of(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.label for r in linked.components(links).collect()}
    groups = {}
    for f, x in zip(signed, brute_components(fps)):
        groups.setdefault(x, set()).add(f)
    for members in groups.values():
        assert {got.get(f, f) for f in members} == {min(members)}
    near = simhash.bucket_links(np.array(fps, np.uint64))
    assert sum(len(a) for a, _ in near) >= sum(len(m) - 1 for m in groups.values())


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = [f"w{c}{d}" .replace("w", rng.choice("bdfg")) for c in "aeiou" for d in "klmn"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randint(0, 29)] = rng.choice(["idiot", "stupid", "moron"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000, "bak 1d10t dal"), (1001, "bak s t u p i d dal"), (1002, "bak mooooron!"), (1003, None), (1004, ""), (None, "bak"), (1005, "idiot " * 30_000), (1005, "bak dal")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    got = {(r.doc_id, r.predicted) for r in out}
    assert {(1000, 1), (1001, 1), (1002, 1), (1003, 0), (1004, 0), (None, 0), (1005, 1), (1005, 0)} <= got and len(out) == 408
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert toxicity.score_documents(empty, labels).count() == 0
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == 408 and len({r.score for r in none}) == 1


def test_lattice_prefers_seen_words():
    table = np.zeros((32, 32, 32))
    for w in ["idiot"] * 50 + ["trash"] * 20:
        codes = [0, 0, *map(toxicity.symbol, w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            table[a, b, c] += 1
    logs = toxicity.trigram_logs(table)
    assert [toxicity.restored(w, logs) for w in ("1d10t", "i.d-i_o.t", "iiidiot", "tr4$h")] == ["idiot", "idiot", "idiot", "trash"]


def test_decontamination(spark, empty):
    asked = "Today Tom buys 12 apples and 7 km of rope, then Tom gives 12 apples to Ann before the train leaves"
    items = [(1, asked), (2, "short but quite telling item text"), (3, None), (4, ""), (None, asked)]
    said = "Today Jim buys 31 apples and 9 km of rope, then {} gives {} apples to Eva before the train leaves"
    docs = [
        (10, f"So it goes. {asked} again."), (11, "x " + said.format("Jim", 31)), (12, "x " + said.format("Bob", 31)),
        (13, said.format("Jim", 8)), (14, asked.upper()), (15, "apples and rope"), (16, None), (17, ""),
        (18, "a short but quite telling item text b"), (None, asked), (19, asked), (19, asked), (20, "word " * 50_000 + asked)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("w", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, benchmark).collect()}
    assert got == {(10, 1), (11, 1), (19, 1), (20, 1)}
    kept = templates.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 8
    assert templates.leaks(empty, benchmark).count() == 0 and templates.leaks(docs, benchmark.limit(0)).count() == 0


def test_sharding(spark, odd, empty):
    out = sharding.shard_documents(odd, 5).collect()
    rows = corpus()
    counts = {}
    for r in out:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(out) == len(rows) and set(counts) == set(range(5))
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert sizes == {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    groups = {}
    for r in out:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(s) - 1 for s in groups.values()) <= 2
    assert sharding.shard_documents(empty).count() == 0
    hot = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(hot, 10).collect()
    assert {len([r for r in got if r.shard == s]) for s in range(10)} == {100}
    assert len({r.shard for r in got if r.size == 12}) <= 7


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    x = np.concatenate([centres[rng.integers(0, 12, 700)] + 0.4 * rng.standard_normal((700, 32)), np.tile(centres[0], (60, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    bad = [(900, None), (920, [0.0] * 32), (940, [float("nan")] * 32), (960, [None, *[1.0] * 31]), (980, []), (None, rows[0][1]), (1000, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    out = ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()
    got, found = {}, 0
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    xd = x.astype(float)
    queries = [i for i in range(len(x)) if i % 20 == 0]
    assert sorted(got) == queries
    for q in queries:
        score = (xd * xd[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(score[m[1]] == m[2] for m in mine)
        assert mine == [(k + 1, *m) for k, m in enumerate(sorted(((m[1], m[2]) for m in mine), key=lambda m: (-m[1], m[0])))]
        found += len(set(order) & {m[1] for m in mine})
    assert found >= 0.95 * 20 * len(queries)
    few = ann.nearest(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0, 20)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3, 4]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(table.where("vec_id = 900"), F.col("vec_id") % 20 == 0).count() == 0


def test_languages(spark, empty):
    rng = random.Random(1)
    say = {"en": ["the", "thing", "with", "shore", "that"], "fr": ["eau", "leçon", "été", "quoi", "dans"], "ru": ["это", "когда", "дом", "что"]}
    docs = [(i, " ".join(rng.choice(say[lang]) for _ in range(40)), lang) for i in range(120) for lang in [rng.choice(list(say))]]
    docs += [(500, "the thing that shore with " * 3 + "été dans eau quoi leçon " * 6, None), (501, "дом that", None), (502, None, "en"), (503, "12 34 !", "en"), (504, "", "fr"), (None, "the thing", "en"), (505, "漢字", None), (506, "the " * 60_000, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert len(out) == len(docs.collect())
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 500}
    assert all(out[d].lang_pred == x for d, x in truth.items())
    assert out[500].lang_pred == "fr" and [s.lang for s in out[500].spans] == ["en", "fr"]
    assert [s.lang for s in out[501].spans] == ["ru", "en"]
    assert all(out[d].lang_pred == "und" and out[d].score == 0 for d in (502, 503, 504)) and out[506].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values()) and out[505].lang_pred in ("en", "fr", "ru")
    assert langid.identify_languages(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {"langs": [], "score": None, "allowed": None}).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(40, 3)).astype(np.float32) * 4
    starts = np.array([0, 7, 7, 30, 40])
    label = langid.viterbi(scores, starts, 3.0)
    value = lambda a, b, path: sum(scores[a + i, p] for i, p in enumerate(path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:]))
    import itertools

    best = max(value(0, 7, p) for p in itertools.product(range(3), repeat=7))
    assert abs(value(0, 7, label[:7]) - best) < 1e-4
