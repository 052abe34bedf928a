"""Benchmark decontamination on question templates, in SQL functions only.

Numbers, names and units become typed placeholders; windows of template words of
benchmark items are hash-joined with those of all documents.  Where a window
matches, the values behind the placeholders must map one to one between item and
document, so that a question with other numbers or names is found and a mere
likeness of frame is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import stored, with_array

WINDOW = 8
#: Consecutive matching windows that make a leak (13 words), or all of a shorter item.
NEEDED = 6
#: Literal words a window must hold beside its placeholders.
LITERALS = 4
#: Benchmark windows up to which their hashes are broadcast (16 bytes each).
MAX_BROADCAST = 2_000_000

#: Words that count as units after a number (fixed values).
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|s|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inches|usd|eur|dollars?|euros?|cents?|percent"
NAME = r"([\p{Ll}\p{N},;:][ \t])(\p{Lu}\p{Ll}+)"
UNIT = r"(\p{N})[ \t]?(" + UNITS + r")([^\p{L}\p{N}]|$)"
NUMBER = r"(^|[^\p{L}\p{N}µ])(\p{N}+(?:[.,]\p{N}+)*)"


def words(text, values: bool = False):
    """Template words: lower case, letters and digits only.  The placeholders are
    ``µn`` for a name (a capitalised word inside a sentence), ``µd`` for a number
    and ``µu`` for a unit after one, with ``values`` followed by what they stand for."""
    out = text
    for _ in range(2):  # the second time for names right after a name
        out = F.regexp_replace(out, NAME, f"$1µn{'$2' if values else ''}")
    out = F.regexp_replace(out, UNIT, f"$1 µu{'$2' if values else ''}$3")
    out = F.regexp_replace(out, NUMBER, f"$1µd{'$2' if values else ''}")
    return F.filter(F.split(F.lower(out), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(column: str) -> F.Column:
    """Hash of each window of the template words; one of fewer words for short texts, none for empty ones."""
    return F.expr(f"""if(size({column}) = 0, cast(array() as array<bigint>),
        transform(sequence(1, greatest(1, size({column}) - {WINDOW - 1})), i -> xxhash64(slice({column}, i, {WINDOW}))))""")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, j, hash, n_windows`` of the items' windows with enough literal words."""
    literal = F.expr(f"""transform(sequence(1, greatest(1, size(w) - {WINDOW - 1})),
        i -> size(filter(slice(w, i, {WINDOW}), x -> substring(x, 1, 1) <> 'µ')) >= least({LITERALS}, size(w)))""")
    items = with_array(benchmark.where("text is not null and item_id is not null").select("item_id", "text"), "w", words(F.col("text")))
    return (items.where("size(w) > 0")
            .select("item_id", F.posexplode(F.arrays_zip(_windows("w").alias("hash"), literal.alias("literal"))).alias("j", "z"),
                    F.expr(f"greatest(1, size(w) - {WINDOW - 1})").alias("n_windows"))
            .where("z.literal").select("item_id", "j", F.col("z.hash").alias("hash"), "n_windows"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, shift, n_windows, places``: item windows found in a document along one shift."""
    items = stored(item_windows(benchmark), "items")
    wanted = items.select("hash").distinct()
    wanted = F.broadcast(wanted) if items.count() <= MAX_BROADCAST else wanted
    found = (with_array(docs.select("doc_id", "text"), "w", words(F.col("text"))).select("doc_id", F.posexplode(_windows("w")).alias("i", "hash"))
             .join(wanted, "hash"))
    met = found.join(items, "hash").groupBy("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift"), "n_windows")
    return met.agg(F.array_sort(F.collect_set("j")).alias("places"))


def _longest_run(places: str) -> str:
    return f"""aggregate({places}, named_struct('last', -9, 'n', 0, 'most', 0), (s, j) -> named_struct('last', j,
        'n', if(j = s.last + 1, s.n + 1, 1), 'most', greatest(s.most, if(j = s.last + 1, s.n + 1, 1))), s -> s.most)"""


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, matched``: the items a document leaks and the longest run of matching windows.

    Rows with a null doc_id or text leak nothing, nor do items with null id or
    text; repeated rows count as one document; extra columns are not read.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    runs = stored(matches(docs, benchmark).withColumn("matched", F.expr(_longest_run("places")))
                  .where(f"matched >= least({NEEDED}, n_windows)"), "matches")
    return _one_to_one(docs, benchmark, runs)


def _one_to_one(docs: DataFrame, benchmark: DataFrame, runs: DataFrame) -> DataFrame:
    """The ``runs`` whose values behind placeholders map one to one, by document and item."""
    keys = ["doc_id", "item_id", "shift"]
    item = benchmark.select("item_id", words(F.col("text"), True).alias("q"))
    # one row for each placeholder inside a matching window
    # only texts with a match are split again, and each once
    held = stored(docs.join(runs.select("doc_id").distinct(), "doc_id", "left_semi"), "matched")
    slots = (runs.join(held.select("doc_id", words(F.col("text"), True).alias("w")), "doc_id").join(item, "item_id")
             .select(*keys, F.explode(F.expr(f"array_distinct(flatten(transform(places, j -> sequence(j, least(j + {WINDOW - 1}, size(q) - 1)))))")).alias("j"), "q", "w")
             .select(*keys, F.expr("q[j]").alias("asked"), F.expr("w[j + shift]").alias("said")).where("asked like 'µ%'"))
    slots = stored(slots, "slots")
    torn = slots.groupBy(*keys, "asked").agg(F.count_distinct("said").alias("n")).where("n > 1").select(*keys).union(
        slots.groupBy(*keys, "said").agg(F.count_distinct("asked").alias("n")).where("n > 1").select(*keys)).distinct()
    return (runs.join(torn, keys, "left_anti").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched")))


def plain_words(text):
    """Literal words: lower case, letters and digits only, nothing replaced."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pieces(column: str, lengths: list[int]) -> F.Column:
    """``at, hash`` of every run of each of ``lengths`` words."""
    return F.expr("concat(cast(array() as array<struct<at:int,hash:bigint>>)" + "".join(f""",
        transform(if(size({column}) >= {n}, sequence(1, size({column}) - {n - 1}), cast(array() as array<int>)),
            i -> struct(cast(i - 1 as int) as at, xxhash64(slice({column}, i, {n})) as hash))""" for n in lengths) + ")")


def _usable(items: DataFrame, literals: int) -> DataFrame:
    """``item_id, j, rank, hash, n_windows, n_words`` of the windows of ``items(item_id, w)``
    with enough literal words; ``rank`` and ``n_windows`` count these alone."""
    starts = f"""filter(sequence(1, greatest(1, size(w) - {WINDOW - 1})),
        i -> size(filter(slice(w, i, {WINDOW}), x -> substring(x, 1, 1) <> 'µ')) >= least({literals}, size(w)))"""
    used = with_array(items.where("size(w) > 0"), "s", F.expr(starts))
    return (used.select("item_id", "w", F.size("s").alias("n_windows"), F.posexplode("s").alias("rank", "i"))
            .select("item_id", F.expr("i - 1").alias("j"), "rank", F.expr(f"xxhash64(slice(w, i, {WINDOW}))").alias("hash"),
                    "n_windows", F.expr(f"least({WINDOW}, size(w))").alias("n_words")))


def whole_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, matched`` of ``leaks`` without its gaps.

    An item of fewer than 8 words is found anywhere in a text, windows with too few
    literal words neither count nor part a run, and a second pass on the words
    themselves finds items word for word whatever share of them are numbers or
    names: 13 words in a row, or a whole shorter item.  Nulls and repeated rows as
    in ``leaks``.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    alike = _one_to_one(docs, items, _runs_of(docs, items, words(F.col("text")), LITERALS))
    same = _runs_of(docs, items, plain_words(F.col("text")), 0).select("doc_id", "item_id", "matched")
    return alike.union(same).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def _runs_of(docs: DataFrame, items: DataFrame, split, literals: int) -> DataFrame:
    """``doc_id, item_id, shift, places, matched``: long enough runs of windows of ``items`` in ``docs``."""
    items = stored(_usable(with_array(items, "w", split), literals), "usable")
    lengths = sorted(r.n_words for r in items.select("n_words").distinct().collect())
    wanted = items.select("hash").distinct()
    wanted = F.broadcast(wanted) if items.count() <= MAX_BROADCAST else wanted
    found = (with_array(docs, "w", split).select("doc_id", F.explode(_pieces("w", lengths)).alias("p"))
             .select("doc_id", F.col("p.at").alias("i"), F.col("p.hash").alias("hash")).join(wanted, "hash"))
    met = (found.join(items, "hash").groupBy("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift"), "n_windows")
           .agg(F.array_sort(F.collect_set(F.struct("rank", "j"))).alias("met")))
    runs = (with_array(met, "ranks", F.col("met.rank")).withColumn("matched", F.expr(_longest_run("ranks")))
            .where(f"matched >= least({NEEDED}, n_windows)"))
    return stored(runs.select("doc_id", "item_id", "shift", F.col("met.j").alias("places"), "matched"), "runs")


def decontaminated(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` without the rows that leak an item, with ``whole`` by ``whole_leaks``;
    rows with a null doc_id stay."""
    found = whole_leaks(docs, benchmark) if whole else leaks(docs, benchmark)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
