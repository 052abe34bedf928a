"""Current state of a keyed stream as files: changed parts are written anew, the rest stays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_PART = "_part"


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _batches(spark: SparkSession, out: str, before: int | None = None) -> list[int]:
    """Batches whose manifest is complete, in order."""
    fs, path = _path(spark, f"{out}/manifest/batch=*/_SUCCESS")
    done = [int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(path) or []]
    return sorted(b for b in done if before is None or b < before)


def _manifest(spark: SparkSession, out: str, batch: int | None) -> dict[str, int]:
    """The batch that wrote each part, as of ``batch``."""
    if batch is None:
        return {}
    rows = spark.read.schema("part string, written long").json(f"{out}/manifest/batch={batch}").collect()
    return {r.part: r.written for r in rows}


def _parts(spark: SparkSession, out: str, schema: StructType, written: Mapping[str, int]) -> DataFrame:
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{out}/data/batch={b}/{_PART}={p}" for p, b in sorted(written.items())))


def read_snapshot(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All rows as of the last complete batch; none before the first."""
    done = _batches(spark, out)
    return _parts(spark, out, schema, _manifest(spark, out, done[-1] if done else None))


def _sweep(spark: SparkSession, out: str, batch: int, used: set[tuple[str, int]]) -> None:
    """Delete what neither the manifest of ``batch`` nor the one before it names."""
    keep = set(_batches(spark, out, batch + 1)[-2:])
    fs, found = _path(spark, f"{out}/manifest/batch=*")
    for s in fs.globStatus(found) or []:
        if int(s.getPath().getName().split("=")[1]) < min(keep):
            fs.delete(s.getPath(), True)
    _, found = _path(spark, f"{out}/data/batch=*/{_PART}=*")
    for s in fs.globStatus(found) or []:
        part, written = s.getPath().getName().split("=", 1)[1], int(s.getPath().getParent().getName().split("=")[1])
        if written <= batch and (part, written) not in used:
            fs.delete(s.getPath(), True)
    _, found = _path(spark, f"{out}/data/batch=*")
    for s in fs.globStatus(found) or []:
        if not (fs.globStatus(_path(spark, f"{s.getPath()}/{_PART}=*")[1]) or []):
            fs.delete(s.getPath(), True)


def merge_batch(changes: DataFrame, batch: int, keys: Sequence[str], part: Column, out: str) -> None:
    """Put the newest row of each key into the snapshot.

    ``changes`` has one row a key.  ``part`` is a text computed from the keys, in
    plain letters, digits, dots and dashes; only parts with a change are read and
    written.  Their number is held by the driver, so it should follow the
    calendar, not the rows.  A batch becomes visible with its manifest, which is
    written last; one that is repeated starts from the manifest before it and
    overwrites its own files.  Files that the last two manifests do not name are
    deleted, so their number follows the parts, not the batches.
    """
    spark = changes.sparkSession
    done = _batches(spark, out, batch)
    before = _manifest(spark, out, done[-1] if done else None)
    # the batch is read twice, and each reading would run the stream's own plan again
    changes = changes.persist()
    try:
        touched = {r[0] for r in changes.select(part).distinct().collect()}
        if not touched:
            return
        old = _parts(spark, out, changes.schema, {p: b for p, b in before.items() if p in touched})
        merged = old.join(changes.select(*keys), list(keys), "left_anti").select(*changes.columns).unionByName(changes)
        (merged.withColumn(_PART, part).repartition(_PART).write.mode("overwrite").partitionBy(_PART)
         .parquet(f"{out}/data/batch={batch}"))
    finally:
        changes.unpersist()
    now = before | dict.fromkeys(touched, batch)
    (spark.createDataFrame(sorted(now.items()), "part string, written long").coalesce(1)
     .write.mode("overwrite").json(f"{out}/manifest/batch={batch}"))
    _sweep(spark, out, batch, {*now.items(), *before.items()})


def publish_updates(changes: DataFrame, keys: Sequence[str], part: Column, out: str, checkpoint: str,
                    trigger: Mapping) -> StreamingQuery:
    """Keep ``read_snapshot(out)`` at the state of a stream in update mode."""
    return (changes.writeStream.outputMode("update")
            .foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, keys, part, out))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
