"""Shards of equal document counts that keep linked documents together.

Balanced label propagation: documents start in hashed shards; in each round every
linked document asks for the shard with room that holds most of its group, and
shards accept as many as their quota allows.  Groups link through their key, so
a round moves one row a document and never pairs.  At the end shards above quota
hand over documents, unlinked ones first, to shards below it, which makes the
counts differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import ranked, stored

SHARDS = 24
MAX_ROUNDS = 6


def _numbers(values) -> F.Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def _loads(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, keys: list[str], order: list[str], quota: int, shards: int,
              max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``linked`` with ``shard`` moved towards its group's shards under the quota."""
    for _ in range(max_rounds):
        room = [quota - n for n in _loads(linked, shards)]
        held = linked.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("n"))
        favourites = stored(held.groupBy(*keys).agg(F.sort_array(F.collect_list(
            F.struct(F.col("n"), (-F.col("shard")).alias("s"))), asc=False).alias("held")), "favourites")
        # the first shard of the group that is the document's own or has room
        wish = F.get(F.filter("held", lambda x: (-x["s"] == F.col("shard")) | (F.get(_numbers(room), -x["s"]) > 0)), F.lit(0))
        asked = stored(linked.join(favourites, keys).withColumn("wish", (-wish["s"]).cast("int")).drop("held"), "wishes")
        movers = ranked(asked.where("wish <> shard"), "wish", order, "place")
        moved = movers.withColumn("to", F.when(F.col("place") < F.get(_numbers(room), F.col("wish")), F.col("wish")).otherwise(F.col("shard")))
        linked_next = asked.where("wish = shard").drop("wish").unionByName(moved.withColumn("shard", F.col("to")).drop("to", "place", "wish"))
        n_moved = moved.where("to <> shard").limit(1).count()
        if not n_moved:
            return linked
        linked = stored(linked_next, "linked")
    return linked


def balanced_shards(rows: DataFrame, keys: list[str], order: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Rows with equal ``keys`` are linked; ``order`` names columns that identify a
    row.  Shard counts differ by one at most.
    """
    total = rows.count()
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    groups = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), "groups")
    linked = stored(rows.join(groups, keys), "linked").select(*rows.columns)
    alone = rows.join(groups, keys, "left_anti")
    linked = propagate(linked, keys, order, total // shards, shards)
    both = stored(alone.withColumn("linked", F.lit(0)).unionByName(linked.withColumn("linked", F.lit(1))), "labelled")
    loads = {(r["shard"], r["linked"]): r["n"] for r in both.groupBy("shard", "linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    load = [loads.get((s, 0), 0) + loads.get((s, 1), 0) for s in range(shards)]
    largest = sorted(range(shards), key=lambda s: -load[s])[:total % shards]
    quota = [total // shards + (s in largest) for s in range(shards)]
    surplus = [max(0, n - q) for n, q in zip(load, quota)]
    beyond = [max(0, s - loads.get((k, 0), 0)) for k, s in enumerate(surplus)]
    numbered = ranked(both.withColumn("_half", F.col("shard") * 2 + F.col("linked")), "_half", order, "_rank")
    leaves = F.col("_rank") < F.when(F.col("linked") == 0, F.get(_numbers(surplus), F.col("shard"))).otherwise(F.get(_numbers(beyond), F.col("shard")))
    numbered = stored(numbered.withColumn("_leaves", leaves).drop("_half", "_rank", "linked"), "numbered")
    filled, upto = [], 0
    for s in range(shards):
        upto += max(0, quota[s] - load[s])
        filled.append(upto)
    pool = ranked(numbered.where("_leaves").withColumn("_all", F.lit(0)), "_all", order, "_rank")
    pool = pool.withColumn("shard", F.size(F.filter(_numbers(filled), lambda x: x <= F.col("_rank"))).cast("int"))
    placed = stored(numbered.where("not _leaves").unionByName(pool.drop("_all", "_rank")).drop("_leaves"), "placed")
    return ranked(placed, "shard", order, "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Law ``rows``.  Documents with equal texts are linked (null and empty texts
    count as equal); a group larger than a shard spreads over few.  A null doc_id
    stays null; repeated rows each take a slot; extra columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("link")), "rows")
    placed = balanced_shards(rows, ["link", "text_crc32", "size"], ["doc_id", "link"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
