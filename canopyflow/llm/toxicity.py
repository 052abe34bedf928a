"""Toxicity scores of deobfuscated text.

A noisy channel turns letters into look-alikes, repeats them or puts marks and
spaces between them.  Words that show such signs become lattices of the letters
they may stand for, and a Viterbi pass under a character trigram model of the
corpus restores the likeliest spelling.  Words and word beginnings that labelled
documents tie to toxicity then score the restored text.

The trigram model counts all documents that are not held out.  Word evidence is
fitted on at most ``SAMPLE_ROWS`` labelled ones, those with the smallest hash.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import stored, worker_cache
from canopyflow.llm.langid import code_tables, held_out, text_steps, texts_of

SAMPLE_ROWS = 20_000
#: Fewest toxic sample documents with a word, and least log-odds for it to count.
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
#: Lengths of word beginnings that are evidence beside whole words.
BEGINNINGS = (4, 5, 6, 8)
STEP_CHARS = 4_000_000
KNOWN_WORDS = 200_000
SYMBOLS = 32
#: What a look-alike may stand for; nothing for a mark put between letters (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
MARKS = set(".-_*~'·")
#: Log-probability of a look-alike, of a mark between letters, of one repeat more.
SUBSTITUTE, INSERT, REPEAT = math.log(0.3), math.log(0.3), math.log(0.5)
_core = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$|+€£]+$")
_spaced = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_thrice = re.compile(r"(.)\1\1")


def symbol(c: str) -> int:
    """0: word edge; 1-26: a-z; others share what is left."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 5


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigrams of letters inside words over all of ``docs(text)``; sums are taken by Spark."""

    def counted(batches):
        letter, lower, _ = code_tables()
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in text_steps(texts, STEP_CHARS):
                chars = np.frombuffer(("\n".join(texts[a:b]) + "\n").encode("utf-32-le", "replace"), np.uint32)
                small = lower[chars]
                code = np.where((small >= 97) & (small <= 122), small.astype(np.int64) - 96, 27 + small.astype(np.int64) % 5)
                code[~letter[chars]] = 0
                code = np.r_[0, 0, code]
                total += np.bincount(code[:-2] << 10 | code[1:-1] << 5 | code[2:], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SYMBOLS ** 3)
    table[rows["gram"].to_numpy(int)] = rows["n"]
    return table


def trigram_logs(counts: np.ndarray) -> list[float]:
    """Log-probability of the third symbol after two; a word starts after an edge."""
    table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).copy()
    pairs = table.sum(0)  # what follows one symbol, wherever it stands
    backed = (pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * SYMBOLS)
    return np.log((table + 2 * backed[None]) / (table.sum(2, keepdims=True) + 2)).ravel().tolist()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case word, the letters it may stand for, with log-probabilities."""
    out, at = [], 0
    while at < len(word):
        c, run = word[at], 1
        while at + run < len(word) and word[at + run] == c:
            run += 1
        if c.isalpha():
            kept = min(run, 2)
            out.append([(c * k, (run - k) * REPEAT) for k in range(1, kept + 1)])
        elif c in LOOKALIKES:
            options = [(x, SUBSTITUTE) for x in LOOKALIKES[c]] + ([("", INSERT)] if not c.isdigit() else [])
            out += [options] * run if run < 3 else [options]
        else:
            out.append([("", INSERT)])
        at += run
    return out


def restored(word: str, logs: list[float]) -> str:
    """The likeliest letters of a lattice under the character model."""
    states = {(0, 0): (0.0, "")}
    for options in [*lattice(word), [(None, 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letters, log in options:
                x, y, s = a, b, score + log
                for code in [0] if letters is None else map(symbol, letters):
                    s += logs[x << 10 | y << 5 | code]
                    x, y = y, code
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, text + (letters or ""))
        states = after
    return max(states.values())[1]


def suspicious(word: str) -> bool:
    """Whether a word has look-alikes or marks among its letters, or letters three times."""
    if word.isalpha():
        return _thrice.search(word) is not None
    letters = sum(map(str.isalpha, word))
    return len(word) <= 64 and letters >= 1 and 2 * len([c for c in word if c in LOOKALIKES or c in MARKS or c.isalpha()]) > len(word) and len(word) >= 3


def features(token: str, logs: list[float]) -> tuple[str, ...]:
    """The restored word and its beginnings."""
    word = _core.sub("", token)
    if not word:
        return ()
    if suspicious(word):
        word = restored(word, logs)
    elif not word.isalpha():
        word = "".join(filter(str.isalpha, word))
    if not word:
        return ()
    return (word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n))


def tokens(text: str) -> list[str]:
    """Lower-case words; a run of single characters gives one word more, also
    without a one-letter word before or after it."""
    low = text.lower()
    out = low.split()
    for run in _spaced.findall(low):
        run = run.replace(" ", "")
        out += [run, run[1:], run[:-1], run[1:-1]]
    return out


class Reader:
    """Looks words up in the evidence; words met before are known."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def hits(self, text: str) -> tuple[int, dict[str, float]]:
        """Number of words, and evidence by word (its strongest feature's weight)."""
        words = tokens(text)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        weights, logs, known = self.model["weights"], self.model["logs"], self.known
        found = {}
        for w in set(words):
            weight = known.get(w)
            if weight is None:
                weight = known[w] = max((weights.get(f, 0.0) for f in features(w, logs)), default=0.0)
            if weight:
                found[w] = weight
        return len(words), found

    def measures(self, text: str) -> list[float]:
        n, found = self.hits(text)
        top = sorted(found.values(), reverse=True)[:5]
        return [1.0, top[0] if top else 0.0, sum(top), math.log1p(1000 * len(found) / n) if n else 0.0]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


def learn(docs: DataFrame, labels: DataFrame, learn_from) -> dict:
    """The model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` where ``learn_from`` holds."""
    logs = trigram_logs(count_trigrams(docs.where(learn_from)))
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").where(learn_from).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = stored(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                    .join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "sample")
    share = sample.sparkSession.sparkContext.broadcast(logs)

    def counted(wanted):
        def count(batches):
            total, known = Counter(), {}
            for batch in batches:
                for text in texts_of(batch.column(0)):
                    own = set()
                    for w in set(tokens(text)):
                        if w not in known:
                            known[w] = [f for f in features(w, share.value) if wanted is None or f in wanted.value]
                        own.update(known[w])
                    total.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["feature", "n"])

        return count

    def documents_with(label: int, wanted=None) -> DataFrame:
        return (sample.where(F.col("toxic") == label).repartition(8).select("text")
                .mapInArrow(counted(wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")))

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = {r["feature"]: r["n"] for r in documents_with(1).where(F.col("n") >= LEAST_DOCS).collect()}
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = {r["feature"]: r["n"] for r in documents_with(0, wanted).collect()}
    weights = {}
    for f, t in toxic.items():
        c = clean.get(f, 0)
        weight = math.log((t + 0.5) / (n.get(1, 0) + 1)) - math.log((c + 0.5) / (n.get(0, 0) + 1))
        expected = (t + c) * n.get(1, 0) / (n.get(1, 0) + n.get(0, 0))
        if weight >= LEAST_WEIGHT and t - expected >= 3 * math.sqrt(expected + 0.25):
            weights[f] = weight
    model = {"logs": logs, "weights": weights, "fit": None, "base": (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)}
    if n.get(0) and n.get(1):
        rows = measured(sample, model, ["toxic"]).toPandas()
        x = np.array(rows["measures"].tolist())
        model["fit"] = logistic(x, rows["toxic"].to_numpy(float))
    return model


def _reading(docs: DataFrame, model: dict, kept: list[str], result: str, kind, value) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col("text").alias("_read"), *(F.col(f"`{c}`") for c in kept))
    own = uuid.uuid4().hex

    def read(batches):
        reader = worker_cache(("reader", own), lambda: Reader(shared.value))
        for batch in batches:
            found = [value(reader, t) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind[0])], [*kept, result])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[1:])
    return plain.mapInArrow(read, f"{schema}, {result} {kind[1]}" if kept else f"{result} {kind[1]}")


def measured(docs: DataFrame, model: dict, kept: list[str]) -> DataFrame:
    return _reading(docs, model, kept, "measures", (pa.list_(pa.float64()), "array<double>"), lambda reader, t: reader.measures(t))


def scored(docs: DataFrame, model: dict, kept: list[str], name: str = "score") -> DataFrame:
    """Columns ``kept`` of every row with its score (0 to 1) as ``name``.  Null and empty
    texts score as texts without evidence; a model without both labels scores
    every text as its share of toxic documents."""
    fit, base = model["fit"], model["base"]

    def score(reader, text):
        if fit is None:
            return float(base)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(reader.measures(text), fit)))))))

    return _reading(docs, model, kept, name, (pa.float64(), "double"), score)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from the rows of ``labels`` whose ids are not held out.  A null doc_id
    stays null, is not held out and is not learned from; repeated rows are all
    returned; extra columns are not read.
    """
    model = learn(docs, labels, ~held_out())
    return scored(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
