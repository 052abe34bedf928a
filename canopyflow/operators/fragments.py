"""Connected segments: fragments cut off from their segment join a neighbour.

A segment's largest connected fragment keeps its id.  Every other fragment is an
orphan and goes to the neighbour with which it shares the longest border; orphans
that choose each other become one and choose again.  Only borders between
fragments take part in the rounds, never cells, and each round at least halves
the number of orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.operators.regions import label_regions, row_runs, run_cells
from canopyflow.session import cut_lineage, rounds

PARCEL = ["parcel_id"]
BLOCK = 64
#: Ids of segments that only consist of orphans start here, above all grid ids.
ISLANDS = 1 << 41


def shared_borders(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``parcel_id, a, b, n``: cell sides that fragments ``a < b`` share.

    ``runs(parcel_id, py, x0, x1, fragment)`` do not overlap.  Rows meet by blocks
    of columns, and a pair counts the sides inside each block.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    listed = (runs.withColumn("block", F.explode(F.sequence(at("x0"), at("x1"))))
              .withColumns({"x0": F.greatest("x0", F.col("block") * block), "x1": F.least("x1", F.col("block") * block + block - 1)}))
    upper = listed.select("parcel_id", "py", "block", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("fragment").alias("u"))
    below = (listed.withColumn("py", F.col("py") - 1).join(upper, ["parcel_id", "py", "block"])
             .withColumn("n", F.least("x1", "u1") - F.greatest("x0", "u0") + 1).where("n > 0"))
    left = runs.select("parcel_id", "py", (F.col("x1") + 1).alias("x0"), F.col("fragment").alias("u"))
    beside = runs.join(left, ["parcel_id", "py", "x0"]).withColumn("n", F.lit(1).cast("bigint"))
    sides = below.select("parcel_id", "u", "fragment", "n").unionByName(beside.select("parcel_id", "u", "fragment", "n"))
    return _summed(sides.withColumnsRenamed({"u": "a", "fragment": "b"}))


def _summed(edges: DataFrame) -> DataFrame:
    return (edges.where("a <> b").groupBy("parcel_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.sum("n").alias("n")))


def _open(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Borders with an orphan on at least one side."""
    settled = nodes.where("settled").select("parcel_id", F.col("node").alias("b"), F.lit(True).alias("known_b"))
    known = edges.join(settled, ["parcel_id", "b"], "left").join(
        settled.withColumnsRenamed({"b": "a", "known_b": "known_a"}), ["parcel_id", "a"], "left")
    return _summed(known.where("known_a IS NULL OR known_b IS NULL"))


def _choices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``parcel_id, node, target``: each orphan's longest border; equal ones go by the
    pair of ids, so that only two orphans can choose each other, and then the
    smaller one stays."""
    both = edges.select("parcel_id", "a", "b", "n", F.explode(F.array("a", "b")).alias("node"))
    orphans = nodes.where(~F.col("settled")).select("parcel_id", "node")
    pick = F.max(F.struct("n", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("top")
    chosen = (both.join(orphans, ["parcel_id", "node"], "left_semi").groupBy("parcel_id", "node").agg(pick)
              .select("parcel_id", "node", (-F.col("top.a") - F.col("top.b") - F.col("node")).alias("target")))
    back = chosen.select("parcel_id", F.col("node").alias("target"), F.col("target").alias("back"))
    stays = (F.col("back") == F.col("node")) & (F.col("node") < F.col("target"))
    kept = chosen.join(back, ["parcel_id", "target"], "left").withColumn(
        "target", F.when(F.coalesce(stays, F.lit(False)), F.col("node")).otherwise(F.col("target")))
    return kept.select("parcel_id", "node", "target")


def _followed(choices: DataFrame, written) -> DataFrame:
    """Choices with the last node of each chain; every round doubles the distance."""
    current = written(choices)
    while True:
        ahead = current.select("parcel_id", F.col("node").alias("target"), F.col("target").alias("next"))
        joined = current.join(ahead, ["parcel_id", "target"], "left").select(
            "parcel_id", "node", F.coalesce("next", "target").alias("target"),
            (F.coalesce("next", "target") != F.col("target")).alias("moved"))
        longer = written(joined)
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        current = longer.drop("moved")


def _relabelled(df: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    to = moves.withColumnsRenamed({"node": column, "target": "_to"})
    return df.join(to, ["parcel_id", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def connected_segments(segments: DataFrame) -> DataFrame:
    """``segments(parcel_id, px, py, segment_id)`` with ids whose cells are 4-connected.

    Orphans without any neighbour become segments of their own, numbered from
    ``ISLANDS``.  No cell is lost or added; repeated cells count once.
    """
    labelled = label_regions(row_runs(segments.select("parcel_id", "segment_id", "px", "py").distinct(), ["parcel_id", "segment_id"]),
                             ["parcel_id", "segment_id"])
    runs = cut_lineage(labelled.withColumnRenamed("region_id", "fragment"))
    sizes = runs.groupBy("parcel_id", "segment_id", "fragment").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    main = sizes.groupBy("parcel_id", "segment_id").agg((-F.max(F.struct("n", (-F.col("fragment")).alias("f")))["f"]).alias("fragment"))
    nodes = cut_lineage(sizes.select("parcel_id", "segment_id", "fragment").join(
        main.withColumn("settled", F.lit(True)), ["parcel_id", "segment_id", "fragment"], "left").select(
        "parcel_id", F.col("fragment").alias("node"), "segment_id", F.coalesce("settled", F.lit(False)).alias("settled")))
    placed = nodes.select("parcel_id", F.col("node").alias("fragment"), "node")
    state = nodes.select("parcel_id", "node", "settled")
    with rounds(segments.sparkSession) as written:
        edges = written(_open(shared_borders(runs), state))
        while not edges.isEmpty():
            moves = _followed(_choices(edges, state), written)
            placed = written(_relabelled(placed, "node", moves))
            state = written(_relabelled(state, "node", moves).groupBy("parcel_id", "node").agg(F.bool_or("settled").alias("settled")))
            edges = written(_open(_relabelled(_relabelled(edges, "a", moves), "b", moves), state))
        ids = nodes.select("parcel_id", "node", F.when(F.col("settled"), F.col("segment_id")).otherwise(F.col("node") + ISLANDS).alias("to"))
        final = cut_lineage(placed.join(ids, ["parcel_id", "node"]).select("parcel_id", "fragment", "to"))
    done = runs.join(final, ["parcel_id", "fragment"]).select("parcel_id", F.col("to").alias("segment_id"), "py", "x0", "x1")
    return run_cells(done, ["parcel_id", "segment_id"]).select("parcel_id", "px", "py", "segment_id")


def components_per_segment(segments: DataFrame) -> DataFrame:
    """``parcel_id, segment_id, n_px, components``."""
    keys = ["parcel_id", "segment_id"]
    runs = label_regions(row_runs(segments, keys), keys)
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n_px"), F.count_distinct("region_id").alias("components"))
