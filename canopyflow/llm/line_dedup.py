"""Removal of repeated runs of lines.

Every document is a sequence of line ids.  Prefix doubling names its suffixes:
the name of 2n lines is made from the names of the n lines at the place and n
lines further on, and of the lengths in between by overlapping two names.
Doubling stops at the shortest run that counts, since a line lies in a repeated
run of at least that length exactly if a window of that length around it repeats.
Suffixes with equal names form the longest-common-prefix intervals; all but the
first of an interval are later copies, and neighbouring ones join to maximal runs.

Names are pairs of 64-bit hashes.  Blank lines are no part of the sequence and
always stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import text_key, with_array

MIN_LINES = 2


def _doubled(names: str, step: int) -> str:
    """Names of ``step`` more lines than the names in column ``names`` stand for."""
    return f"""transform(if(size({names}) > {step}, sequence(1, size({names}) - {step}), cast(array() as array<int>)),
        i -> named_struct(
            'x', xxhash64({names}[i - 1].x, {names}[i - 1].y, {names}[i - 1 + {step}].x),
            'y', xxhash64({names}[i - 1].y, {names}[i - 1 + {step}].y, {names}[i - 1].x, {step})))"""


def named_windows(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``doc_id, tag, at, last`` (numbers of the window's first and last line among the
    lines that are not blank) and ``name`` of every window of ``min_lines`` lines,
    and of every single line of at least ``long_words`` words (None: of no such line)."""
    rows = docs.select(F.col("doc_id"), text_key().alias("tag"),
                       F.expr("filter(split(text, '\\n', -1), x -> btrim(x, ' \\t\\r') <> '')").alias("lines"))
    rows = with_array(rows, "names", F.expr(
        "transform(lines, x -> named_struct('x', xxhash64(x), 'y', xxhash64(x, 1)))"))
    long = None if long_words is None else (
        rows.select("doc_id", "tag", F.posexplode(F.arrays_zip("lines", "names")).alias("at", "z"))
        .where(f"size(filter(split(z.lines, '\\\\s+'), x -> x <> '')) >= {long_words}")
        .select("doc_id", "tag", "at", F.col("at").alias("last"), F.col("z.names").alias("name")))
    rows = rows.select("doc_id", "tag", "names")
    known = 1
    while known < min_lines:
        step = min(known, min_lines - known)
        rows = with_array(rows.withColumnRenamed("names", "half"), "names", F.expr(_doubled("half", step))).drop("half")
        known += step
    windows = (rows.select("doc_id", "tag", F.posexplode("names").alias("at", "name"))
               .select("doc_id", "tag", "at", (F.col("at") + (min_lines - 1)).alias("last"), "name"))
    return windows if long is None else windows.union(long)


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``doc_id, tag, runs``: the maximal runs (first and last number among the
    lines that are not blank) of lines in windows that start earlier as well."""
    windows = named_windows(docs, min_lines, long_words).select(
        F.col("name.x").alias("x"), F.col("name.y").alias("y"), "tag", "last", F.struct("doc_id", "at").alias("place"))
    first = windows.groupBy("x", "y").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    repeated = first.where("first <> last").select("x", "y", "first")
    later = windows.join(repeated, ["x", "y"]).where("place > first").select("place.doc_id", "tag", "place.at", "last")
    per = later.distinct().groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("at"))
    # windows that start no later than one line past the run before join it
    return per.select("doc_id", "tag", F.expr("""aggregate(at, cast(array() as array<struct<a:int,b:int>>),
        (runs, w) -> if(size(runs) > 0 and w.at <= element_at(runs, -1).b + 1,
            concat(slice(runs, 1, size(runs) - 1), array(named_struct('a', element_at(runs, -1).a, 'b', greatest(element_at(runs, -1).b, w.last)))),
            concat(runs, array(named_struct('a', w.at, 'b', w.last)))))""").alias("runs"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, count: str | None = "n_lines_removed",
                          long_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, and the
    number of lines cut as ``count`` (None: left out).

    A line goes if it lies in a window of ``min_lines`` lines (blank ones apart)
    that starts earlier too, in a document with a smaller doc_id or further up in
    the same one, or if it has ``long_words`` words itself and stands further up
    (None: single lines stay); windows are judged on the input.  What stays is joined by line
    feeds; a text that loses every line becomes empty, and no row is dropped.
    Null texts stay null.  A null doc_id counts as the smallest.  Rows with equal
    doc_id are one document: equal rows do not remove each other.  Extra columns
    pass through.
    """
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns), text_key().alias("_tag"))
    runs = later_runs(docs, min_lines, long_words).select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_of"), F.col("runs").alias("_runs"))
    joined = own.join(runs, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tag") == F.col("_of")), "left")
    return _kept(joined, count)


def _kept(joined: DataFrame, count: str | None) -> DataFrame:
    """Cuts the runs; lines between two runs are taken as one slice."""
    lines = with_array(joined, "_lines", F.when(F.col("_runs").isNotNull(), F.split("text", "\n", -1)))
    # places of the lines that are not blank, so that runs become line ranges
    lines = with_array(lines, "_full", F.expr(
        "filter(transform(_lines, (x, i) -> if(btrim(x, ' \\t\\r') <> '', i, null)), i -> i is not null)"))
    lines = with_array(lines, "_gone", F.expr("flatten(transform(_runs, r -> slice(_full, r.a + 1, r.b - r.a + 1)))"))
    lines = with_array(lines, "_rest", F.expr("array_except(sequence(0, size(_lines) - 1), _gone)"))
    text = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(
        F.expr("array_join(transform(_rest, i -> _lines[i]), '\\n')"))
    names = [c for c in joined.columns if c not in ("_tag", "_doc", "_of", "_runs")]
    return lines.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names),
                        *([F.coalesce(F.size("_gone"), F.lit(0)).alias(count)] if count else []))
