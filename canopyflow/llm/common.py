"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: it sorts before every id.
NO_ID = -(2 ** 63)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: it is
    computed once, and its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text="text"):
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def with_array(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with column ``name`` computed once for each row; as a plain column it
    would be put into every lambda that uses it and computed for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next; functions of this
    package travel by value, so their own globals start anew each time."""
    return sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__


def worker_cache(owner, make):
    """What ``owner`` keeps in a worker; another owner's things go, to save memory."""
    state = worker_state()
    if state.get("owner") != owner:
        state["owner"], state["held"] = owner, None
        state["held"] = make()
    return state["held"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[where[0]:where[-1]], where - where[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, limit: int):
    """Row ranges (from, to) of at most ``limit`` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with its 0-based, gapless rank within ``group`` as ``name``.

    A group may hold a third of all rows: it is dealt over buckets, ranked in
    each, and moved up by what the buckets before it hold.  The hash of a bucket is
    salted: groups are often hashes of the same columns, and would fill few buckets.
    """
    buckets = max(64, df.count() // 50_000)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("bucket"), *order), F.lit(buckets)))
    per = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = per.withColumn("_before", F.sum("_n").over(
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (dealt.withColumn("_at", F.row_number().over(inside) - 1)
            .join(before.select(group, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), [group, "_bucket"])
            .withColumn(name, (F.col("_at") + F.col("_before")).cast("long"))
            .drop("_at", "_before", "_bucket"))
