"""Phrase collocations by stripes.

A stripe is the counter of the words that follow one prefix.  Tasks build stripes
of the texts they read, Spark merges stripes elementwise, and the merged stripes
give everything: each cell is the frequency of a phrase, a stripe's prefix is the
left part of a cut, and the largest cell over a phrase tells whether a longer one
subsumes it.

A phrase cannot be more frequent than any part of it, nor than its hash bucket.
Rounds of growing size therefore first sum phrases by bucket, of those whose parts
lie in buckets that reach the least frequency; stripes then take the phrases that
pass at every size.  Phrases in a full bucket are counted in vain, none is missed.
Buckets grow with the text, up to ``MOST_BUCKETS`` (128 MB of bits); beyond some
130 GB of text they fill up, which costs time and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.llm.common import slices, stored, utf8
from canopyflow.llm.words import LOWER_AZ, byte_set, coded, runs, strings

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
STEP_BYTES = 8_000_000
#: Cells of a partial stripe; a longer one is sent in parts.
STRIPE_CELLS = 4096
#: Cells that a task adds up before it sends them on.
HELD_CELLS = 1_000_000
#: Tasks that build stripes: so many for each core, or more, of so many bytes of text.
TASKS_PER_CORE, TASK_BYTES = 2, 512_000_000
CELL = ["size", "lang", "prefix", "word", "n"]
#: Buckets by bytes of text, as powers of two; they are summed in ``SEGMENTS`` parts.
BYTES_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 128, 1 << 16, 1 << 30
SEGMENTS = 1024
_STOP = byte_set((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD = ~(_STOP | byte_set((0x20, 0x20), (0x09, 0x09)))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hashes(names) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x or "") for x in names), np.uint64, len(names))


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that word's."""
    h = (prefix * _STEP) ^ word
    return (h ^ (h >> np.uint64(31))) * _MIX


def _first_of_run(columns: list[np.ndarray]) -> np.ndarray:
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return changed


def _has(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


class _Step:
    """The words of some texts, and their phrases size by size."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, lang: pa.Array):
        flat = LOWER_AZ[flat]
        inside = _WORD[flat]
        start, end, row = runs(inside, offsets)
        self.code, self.words = coded(strings(flat, inside, start, end))
        stops = np.cumsum(_STOP[flat], dtype=np.int64)[start] if len(start) else start
        self.piece = np.cumsum(_first_of_run([row, stops])) if len(start) else start
        langs = lang.dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    def phrases(self, longest: int, buckets: int, filters: dict[int, np.ndarray]):
        """For each size, the bucket of the phrase at each place, and which are
        inside a piece and pass the filters with all their parts."""
        word = _hashes(self.words.to_pylist())[self.code]
        h, fits = _hashes(self.langs.to_pylist())[self.lang], np.ones(len(word) + 1, bool)
        for size in range(1, min(longest, len(word)) + 1):
            n = len(word) - size + 1
            h = _longer(h[:n], word[size - 1:])
            fits = fits[:n] & fits[1:n + 1] & (self.piece[:n] == self.piece[size - 1:])
            bucket = (h >> np.uint64(12)).astype(np.int64) & (buckets - 1)
            if size in filters:
                fits &= _has(filters[size], bucket)
            yield size, bucket, fits

    def cells(self, size: int, fits: np.ndarray) -> pa.Table:
        """Cells of the stripes of the phrases of ``size`` words that start where ``fits``."""
        at = np.flatnonzero(fits)
        keys = ["lang", *map(str, range(size))]
        grams = pa.table([self.lang[at], *(self.code[at + k] for k in range(size))], keys).group_by(keys, use_threads=False).aggregate([([], "count_all")])
        words = [self.words.take(grams[k].combine_chunks()) for k in keys[1:]]
        prefix = pc.binary_join_element_wise(*words[:-1], " ") if size > 1 else pa.array([""] * len(grams), pa.string())
        return pa.table([pa.array(np.full(len(grams), size, np.int32)), self.langs.take(grams["lang"].combine_chunks()), prefix, words[-1],
                         grams["count_all"]], CELL)

    def totals(self) -> pa.Table:
        """Cells of size 0: the number of words of each language."""
        n, none = np.bincount(self.lang, minlength=len(self.langs)), pa.array([""] * len(self.langs), pa.string())
        return pa.table([pa.array(np.zeros(len(n), np.int32)), self.langs, none, none, pa.array(n)], CELL)


def _summed(cells: list[pa.Table]) -> pa.Table:
    """Equal cells of several stripes as one."""
    return pa.concat_tables(cells).group_by(CELL[:-1], use_threads=False).aggregate([("n", "sum")]).rename_columns(CELL)


def _stripes(cells: pa.Table) -> pa.RecordBatch:
    """Cells by prefix, at most ``STRIPE_CELLS`` in a row."""
    cells = cells.sort_by([(k, "ascending") for k in CELL[:3]]).combine_chunks()
    size, lang, prefix, word, n = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells.columns)
    codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (size, lang, prefix)]
    place, head = np.arange(len(cells)), _first_of_run(codes)
    heads = np.flatnonzero(head | ((place - place[head][np.cumsum(head) - 1]) % STRIPE_CELLS == 0))
    where = pa.array(np.r_[heads, len(cells)].astype(np.int32))
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(heads)) for c in (size, lang, prefix)),
                                       pa.ListArray.from_arrays(where, word), pa.ListArray.from_arrays(where, n)], [*CELL[:3], "words", "counts"])


def _mapped(docs: DataFrame, schema: str, of_steps) -> DataFrame:
    def steps(batches):
        for batch in batches:
            flat, offsets = utf8(batch.column(0))
            lang = pc.fill_null(batch.column(1).cast(pa.string()), UNKNOWN)
            for a, b in slices(offsets, STEP_BYTES):
                yield _Step(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lang[a:b])

    return docs.select("text", F.col("lang").cast("string")).mapInArrow(lambda batches: of_steps(steps(batches)), schema)


def full_buckets(docs: DataFrame, sizes: range, buckets: int, filters: dict[int, np.ndarray], least: int) -> np.ndarray:
    """Bits of the buckets where phrases of ``sizes`` that pass ``filters`` occur ``least`` times."""
    known = docs.sparkSession.sparkContext.broadcast(filters)
    part = max(1, buckets // SEGMENTS)

    def counted(steps):
        for step in steps:
            found = [bucket[fits] for size, bucket, fits in step.phrases(sizes[-1], buckets, known.value) if size in sizes]
            bucket, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            cut = np.r_[np.flatnonzero(_first_of_run([bucket // part])), len(bucket)]
            pieces = list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays([
                pa.array([bucket[a] // part for a, _ in pieces], pa.int64()),
                pa.array([(bucket[a:b] % part).astype("<u4").tobytes() for a, b in pieces], pa.binary()),
                pa.array([n[a:b].astype("<u4").tobytes() for a, b in pieces], pa.binary())], ["segment", "bucket", "n"])

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for batch in batches:
            for bucket, n in zip(batch["bucket"], batch["n"]):
                total[np.frombuffer(bucket.as_buffer(), "<u4")] += np.frombuffer(n.as_buffer(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])],
                                         ["segment", "bits"])

    sums = _mapped(docs, "segment long, bucket binary, n binary", counted).groupBy("segment").applyInArrow(summed, "segment long, bits binary")
    out = np.zeros((buckets // part, part // 8), np.uint8)
    for segment, bits in zip(*sums.toArrow().to_pydict().values()):
        out[segment] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def partial_stripes(docs: DataFrame, longest: int, buckets: int, filters: dict[int, np.ndarray], size: int = 0) -> DataFrame:
    """Stripes ``size, lang, prefix, words, counts`` of each task over ``docs(text, lang)``,
    in several parts if it has over ``HELD_CELLS`` cells; size 0 has the number of words.

    Most tasks meet most of the frequent phrases, and a longer text has more of both:
    a task for each input split would send their product.  So tasks follow the cores,
    and add up several splits each."""
    spark = docs.sparkSession.sparkContext
    known, docs = spark.broadcast(filters), docs.coalesce(max(TASKS_PER_CORE * spark.defaultParallelism, -(-size // TASK_BYTES)))

    def striped(steps):
        held = []
        for step in steps:
            held += [step.totals(), *(step.cells(size, fits) for size, _, fits in step.phrases(longest, buckets, known.value))]
            if sum(map(len, held)) > HELD_CELLS:
                held = [_summed(held)]
                if 2 * len(held[0]) > HELD_CELLS:
                    yield _stripes(held[0])
                    held = []
        if held:
            yield _stripes(_summed(held))

    return _mapped(docs, "size int, lang string, prefix string, words array<string>, counts array<long>", striped)


def merged(stripes: DataFrame) -> DataFrame:
    """``size, lang, prefix, word, n``: the cells of the elementwise sum of all stripes.
    A hot prefix is not gathered in one place: sums are taken cell by cell."""
    cells = stripes.select("size", "lang", "prefix", F.inline(F.arrays_zip("words", "counts")).alias("word", "n"))
    return cells.groupBy("size", "lang", "prefix", "word").agg(F.sum("n").alias("n"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(size: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BYTES_PER_BUCKET).bit_length()))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``cells(lang, phrase, size, a)`` of all phrases of one to ``longest`` words with
    ``a >= least``, and ``totals(lang, n)``, the words of each language."""
    size, filters = text_bytes(docs), {}
    buckets = buckets_for(size)
    for sizes in (range(1, 3), *(range(k, k + 1) for k in range(3, longest + 1))):
        bits = full_buckets(docs, sizes, buckets, filters, least)
        filters = filters | dict.fromkeys(sizes, bits)
    cells = stored(merged(partial_stripes(docs, longest, buckets, filters, size)).where((F.col("n") >= least) | (F.col("size") == 0)), "stripes")
    phrase = F.when(F.col("size") == 1, F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    return (cells.where("size > 0").select("lang", phrase.alias("phrase"), "size", F.col("n").alias("a")),
            cells.where("size = 0").select("lang", "n"))


def _subsumed(cells: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the largest cell that extends a phrase by one word on
    either side.  A phrase in any longer one is as frequent as an extension in
    between, so one word tells for all lengths."""
    longer = cells.where("size > 1").withColumn("words", F.split("phrase", " "))
    parts = [longer.select("lang", F.array_join(F.slice("words", start, F.col("size") - 1), " ").alias("phrase"), "a") for start in (1, 2)]
    return parts[0].unionByName(parts[1]).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def _score(a, n, left, right):
    """``floor(1000 * a * n / (left * right))`` in up to 38 digits."""
    wide = lambda c, digits: (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")
    return F.call_function("div", wide(a, 16) * F.lit(1000).cast("decimal(4,0)") * wide(n, 17), wide(left, 18) * wide(right, 18))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of
    two to ``longest`` words, by score, then frequency, then phrase.

    Null texts are empty and null languages ``und``; phrases do not cross stops,
    lines or rows; repeated rows count each; languages without a frequent phrase
    give no rows, as do empty tables; extra columns are not read.  Products are
    taken in 38 digits.
    """
    cells, totals = frequent_phrases(docs, least, longest)
    kept = (cells.where("size > 1").join(_subsumed(cells), ["lang", "phrase"], "left")
            .where("longer is null or 100 * longer < 100 * a").drop("longer"))
    part = lambda name: cells.select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("a").alias(name))
    words = F.split("phrase", " ")
    cuts = (kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .withColumn("l_phrase", F.array_join(F.slice(words, 1, F.col("k")), " "))
            .withColumn("r_phrase", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "))
            .join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(totals, "lang"))
    best = (cuts.withColumn("cut", F.struct(_score("a", "n", "l", "r").alias("score"), "k", "l", "r"))
            .groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
