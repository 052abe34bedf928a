"""Divergence of each source's vocabulary from the other sources of its language.

Tasks count terms in Arrow compute functions alone: lower case, a split at what
is no letter, dictionary codes, and a hashed grouping.  Spark merges the partial
counts; shards of terms by sources, as columns, give the sums over all pairs of
sources, and the terms that stand out come from joins and a window.

A group is a (lang, source) with at least one row; all arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.llm.common import slices, stored

SCALE = 1_000_000_000
LEAST_DOCS = 3
LEAST_SURPRISING = 200
#: Bytes of text that are split at once, and partial rows that a task holds.
STEP_BYTES, HELD_ROWS = 8_000_000, 400_000
#: Rows of a shard, and cells of a block in one.
SHARD_ROWS, BLOCK_CELLS = 200_000, 1_000_000
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_KEYS = ["lang", "source", "term"]


def _partial(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """``lang, source, term, n, docs``: occurrences of each term, and rows with it."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), _BETWEEN)
    row, term = pc.list_parent_indices(lists), pc.list_flatten(lists).dictionary_encode()
    seen = pa.table({"row": row, "code": term.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    group = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    names = pc.binary_join_element_wise(lang, source, "\0" * 3).dictionary_encode()
    first = pc.index_in(pa.array(range(len(names.dictionary)), names.indices.type), names.indices)
    by_group = pa.table({"group": names.indices.take(seen["row"]), "code": seen["code"], "n": seen["count_all"]})
    sums = by_group.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    of = group.take(first.take(sums["group"].combine_chunks()))
    return pa.table({"lang": of.field(0), "source": of.field(1), "term": term.dictionary.take(sums["code"].combine_chunks()),
                     "n": sums["n_sum"], "docs": sums["count_all"]})


def partial_counts(docs: DataFrame) -> DataFrame:
    """Partial rows ``lang, source, term, n, docs`` of each task; every null is ''."""

    def counted(batches):
        held, rows = [], 0

        def merged() -> pa.Table:
            sums = pa.concat_tables(held).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return sums.rename_columns([*_KEYS, "n", "docs"])

        for batch in batches:
            text, lang, source = (pc.fill_null(c.cast(pa.string()), "") for c in batch.columns)
            ends = np.r_[0, np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))]
            for a, b in slices(ends, STEP_BYTES):
                part = _partial(text[a:b], lang[a:b], source[a:b])
                part = part.filter(pc.not_equal(part["term"], ""))
                held.append(part)
                rows += len(part)
                if rows > HELD_ROWS:
                    held = [merged()]
                    rows = len(held[0])
                    if 2 * rows > HELD_ROWS:
                        yield from held[0].combine_chunks().to_batches()
                        held, rows = [], 0
        if held:
            yield from merged().combine_chunks().to_batches()

    plain = docs.select("text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return plain.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def _share(n, total, terms) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + terms))``, exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1).cast("long") + F.call_function(
        "div", wide(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms))


def _gain(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """``kept(lang, source, term, n, n_lang, p, q)``, one row for each term a group has
    among those its language keeps, and ``groups(lang, source, p0)`` with the
    share of a term that the group lacks (null if the language keeps none)."""
    term = Window.partitionBy("lang", "term")
    counts = (partial_counts(docs).repartition("lang", "term").groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
              .withColumn("docs", F.sum("docs").over(term)).where(F.col("docs") >= least_docs).drop("docs")
              .withColumn("n_lang", F.sum("n").over(term))
              .withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long")))
    counts = stored(counts, "terms")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.sum("first").alias("terms"))
    groups = (every.join(sizes.drop("first"), ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "total_lang", "terms"]))
    groups = stored(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))), "groups")
    kept = (counts.drop("first").join(groups.drop("p0"), ["lang", "source"])
            .withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
            .withColumn("q", _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))))
    return kept.select("lang", "source", "term", "n", "n_lang", "p", "q"), groups.select("lang", "source", "p0")


def _gains(p, q):
    """``floor((p - q)**2 / q)`` elementwise; at most 1e18, so 64 bits hold it."""
    return (p - q) * (p - q) // q


def pair_sums(term: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray, first: int, last: int,
              block_cells: int = BLOCK_CELLS) -> np.ndarray:
    """Sums of gains over a shard's terms, of sources ``first`` to ``last`` from each source.

    ``term`` (sorted), ``source`` and ``p`` list the cells that are present;
    ``base[s]`` is the share of an absent one.  Only present cells are visited:
    what two sources both lack is one product.
    """
    out = np.zeros((last - first, len(base)), np.int64)
    block = max(1, block_cells // max(1, len(base)))
    edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else np.zeros(1, np.int64)
    for at in range(0, len(edges) - 1, block):
        a, b = edges[at], edges[min(at + block, len(edges) - 1)]
        row = np.searchsorted(edges, np.arange(a, b), "right") - 1 - at
        n = min(block, len(edges) - 1 - at)
        order = np.argsort(source[a:b], kind="stable")
        t, s, own = row[order], source[a:b][order], p[a:b][order]
        table, has = np.tile(base, (n, 1)), np.zeros((n, len(base)), bool)
        table[t, s], has[t, s] = own, True
        cut = np.searchsorted(s, np.arange(len(base) + 1))
        size = np.diff(cut)
        for k in range(last - first):
            i = first + k
            mine = slice(cut[i], cut[i + 1])
            beside, there = table[t[mine]], has[t[mine]]
            lone = np.zeros(len(own) + 1, np.int64)
            np.cumsum(_gains(base[i], own), out=lone[1:])
            out[k] += _gains(own[mine][:, None], beside).sum(0)
            out[k] += lone[cut[1:]] - lone[cut[:-1]] - (_gains(base[i], beside) * there).sum(0)
            out[k] += (n - size[i] - size + there.sum(0)) * _gains(base[i], base)
    return out


def pair_divergences(kept: DataFrame, groups: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language.

    A language's terms are dealt over shards of about ``shard_rows`` rows (more
    only if one term has more sources); each shard also gets all sources' bases.
    """
    shards = kept.groupBy("lang").agg((F.floor(F.count(F.lit(1)) / shard_rows) + 1).alias("shards"))
    of = stored(groups.select("lang").distinct().join(shards, "lang", "left").na.fill(1, ["shards"]), "shards")
    cells = kept.join(of, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "shards").cast("long").alias("shard"), "source", "term", "p")
    bases = groups.join(of, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "source",
        F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        base = table.filter(pc.is_null(table["term"])).sort_by("source")
        cells = table.filter(pc.is_valid(table["term"])).sort_by("term")
        names = base["source"].combine_chunks()
        zero = pc.fill_null(base["p"], 1).to_numpy()
        term = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        source, p = pc.index_in(cells["source"], names).to_numpy().astype(np.int64), cells["p"].to_numpy()
        step = max(1, BLOCK_CELLS // len(names))
        for first in range(0, len(names), step):
            sums = pair_sums(term, source, p, zero, first, min(first + step, len(names)))
            one, two = np.nonzero(np.arange(len(sums))[:, None] + first != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0].as_py()] * len(one), pa.string()), names.take(pa.array(one + first)), names.take(pa.array(two)),
                pa.array(sums[one, two])], ["lang", "source", "item", "value"])

    parts = cells.unionByName(bases).groupBy("lang", "shard").applyInArrow(summed, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = LEAST_SURPRISING) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    Part ``pair`` has the divergence of a group from every other source of its
    language; part ``term`` the ``top`` terms that a group uses more than its
    language does.  Null text, lang and source are ''; a text without letters has
    no terms but its group takes part, with 0 where a language keeps no term;
    repeated rows count each; ties go to the smaller item; a language with one
    source has no pairs; an empty table gives no rows; extra columns are not read.
    """
    kept, groups = kept_terms(docs, least_docs)
    pairs = pair_divergences(kept, groups)
    terms = kept.where("p > q").withColumn("value", _gain("p", "q"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms.withColumnRenamed("term", "item"), "term").where(F.col("rank") <= top))
