"""Language of mixed-language texts.

Script ranges narrow down which learned languages a word can be in; character
trigrams score the word under those; a Viterbi pass over the words of a document
with a penalty for each switch labels spans.  The document's language is the one
with most letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import slices, worker_state

BINS = 1 << 16
#: Log-likelihood that a change of language inside a text costs.
SWITCH = 6.0
#: Share of a language's words in a script that makes it a candidate there.
LEAST_SHARE = 0.01
#: What a word costs in a language that its script rules out.
WRONG_SCRIPT = -50.0
UNKNOWN = "und"
STEP_BYTES = 4_000_000
#: First code point of each script range (fixed values of the Unicode blocks).
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)], "Armenian": [(0x530, 0x58F)], "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x77F)], "Devanagari": [(0x900, 0x97F)], "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)], "Thai": [(0xE00, 0xE7F)], "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "Kana": [(0x3040, 0x30FF)], "Han": [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 1


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning; a null id is, though it counts as no held-out row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script."""
    if "code_tables" not in worker_state():
        worker_state()["code_tables"] = _code_tables()
    return worker_state()["code_tables"]


def _code_tables():
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    script = np.zeros(n, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a:b + 1] = k
    return letter, lower, script


def word_features(texts: list[str]):
    """Row, start, end and script of each word (run of letters), and for all
    letters the bin of their trigram and the place of their word's first letter."""
    letter, lower, script = code_tables()
    ends = np.cumsum([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    inside = letter[chars]
    begins = np.r_[True, ~inside[:-1]] if len(chars) else np.zeros(0, bool)
    begins[ends[:-1][ends[:-1] < len(chars)]] = True
    at = np.flatnonzero(inside)
    c = lower[chars[at]].astype(np.uint64)
    first = begins[at]
    last = np.r_[first[1:], True] if len(at) else first
    before = np.where(first, 0, np.r_[0, c[:-1]]) if len(at) else c
    after = np.where(last, 0, np.r_[c[1:], 0]) if len(at) else c
    h = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (c * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) ^ (after.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    place = np.flatnonzero(first)
    start = at[place]
    length = np.diff(np.r_[place, len(at)])
    row = np.searchsorted(ends, start, "right")
    base = np.r_[0, ends[:-1]]
    return row, start - base[row], start - base[row] + length, script[chars[start]], (h >> np.uint64(48)).astype(np.int64), place


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def text_steps(texts: list[str], limit: int):
    return slices(np.cumsum([0, *map(len, texts)]), limit)


def learn(docs: DataFrame, lang: str = "lang") -> dict:
    """Trigram log-probabilities and script shares of each language over all of
    ``docs(text, lang)``; sums are taken by Spark, the model's size is fixed."""
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("text", F.col(lang).alias("lang"))

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = texts_of(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for a, b in text_steps(texts, STEP_BYTES):
                row, _, _, script, bins, place = word_features(texts[a:b])
                word_lang = langs[a:b][row]
                letter_lang = np.repeat(word_lang, np.diff(np.r_[place, len(bins)]))
                for name in set(langs[a:b]):
                    total = sums.setdefault(name, np.zeros(BINS + N_SCRIPTS, np.int64))
                    total[:BINS] += np.bincount(bins[letter_lang == name], minlength=BINS)
                    total[BINS:] += np.bincount(script[word_lang == name], minlength=N_SCRIPTS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], ["lang", "bin", "n"])

    rows = known.mapInArrow(counted, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows["lang"]))
    table = np.zeros((len(langs), BINS + N_SCRIPTS))
    table[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["bin"].to_numpy(int)] = rows["n"]
    grams, scripts = table[:, :BINS], table[:, BINS:]
    return {"langs": langs,
            "score": np.ascontiguousarray(np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BINS)).T.astype(np.float32)) if langs else None,
            "allowed": (scripts >= LEAST_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T if langs else None}


def viterbi(scores: np.ndarray, row_start: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; documents are rows ``row_start[i]`` to ``row_start[i + 1]``.

    One step handles the t-th word of all documents that have one.
    """
    n = np.diff(row_start)
    order = np.argsort(-n, kind="stable")
    n, first = n[order], row_start[:-1][order]
    best = np.zeros((len(n), scores.shape[1]), np.float32)
    stays = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.uint16)
    alive = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    for t, k in enumerate(alive):
        at = first[:k] + t
        own = best[:k]
        source[at] = own.argmax(1)
        moved = own.max(1, keepdims=True) - np.float32(switch)
        stays[at] = own >= moved
        best[:k] = np.maximum(own, moved) + scores[at]
    label = np.zeros(len(scores), np.uint16)
    current = best.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        at = first[:alive[t]] + t
        now = current[:alive[t]]
        label[at] = now
        current[:alive[t]] = np.where(stays[at, now], now, source[at])
    return label


def label_texts(texts: list[str], model: dict, switch: float = SWITCH):
    """Language, score and labelled spans of each text."""
    langs, out = model["langs"], []
    parts = [word_features(texts[a:b]) + (a,) for a, b in text_steps(texts, STEP_BYTES)]
    if not langs or not parts:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    row = np.concatenate([p[0] + p[6] for p in parts])
    start, end, script = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    if not len(row):
        return [(UNKNOWN, 0.0, []) for _ in texts]
    scores = np.concatenate([np.add.reduceat(model["score"][p[4]], p[5]) for p in parts if len(p[5])])
    allowed = model["allowed"][script]
    scores = np.where(allowed, scores, np.where(allowed.any(1, keepdims=True), scores + np.float32(WRONG_SCRIPT), 0)).astype(np.float32)
    label = viterbi(scores, np.searchsorted(row, np.arange(len(texts) + 1)), switch)
    letters = np.zeros((len(texts), len(langs)))
    np.add.at(letters, (row, label), end - start)
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])])
    tail = np.r_[head[1:], len(row)] - 1
    span_row = np.searchsorted(row[head], np.arange(len(texts) + 1))
    for i, own in enumerate(letters):
        total = own.sum()
        spans = [{"start": int(start[head[k]]), "end": int(end[tail[k]]), "lang": langs[label[head[k]]]} for k in range(span_row[i], span_row[i + 1])]
        k = int(own.argmax())
        out.append((langs[k], float(own[k] / total), spans) if total else (UNKNOWN, 0.0, []))
    return out


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row: the language with most
    letters, its share of them, and the labelled spans in characters.

    Texts that are null or have no letter, or a model without languages, give
    ``und`` and 0; ties go to the language first by name; a null doc_id stays
    null; repeated rows are all returned; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches):
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            limit = max(2_000_000, 64_000_000 // max(1, len(shared.value["langs"])))
            for a, b in text_steps(texts, limit):
                lang, score, spans = zip(*label_texts(texts[a:b], shared.value, switch))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                    ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        labelled, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from the rows of ``docs`` that are not held out and labels all; adds ``held_out``."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
