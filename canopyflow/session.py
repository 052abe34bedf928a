"""Session helpers: a local builder for tests and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("canopyflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when driver and executors are one
    process, so the fallback is refused on a cluster.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="canopyflow-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used between the rounds of iterative operators."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Writes the state of an iteration as tables in the shared folder, which go at the end.

    Unlike a checkpoint, a table that is read again has the size of its files: a
    checkpoint keeps the estimate of its plan, and joins multiply estimates, so
    their digits would double in every round.  Results must be cut or collected
    before the iteration ends.
    """
    folder = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield written
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lay_out(df: DataFrame, *keys: str) -> DataFrame:
    """Partition and sort by ``keys`` and checkpoint, so that later joins and
    aggregations on exactly these keys find the rows in place."""
    return keep_layout(df.repartition(*keys).sortWithinPartitions(*keys))


def keep_layout(df: DataFrame) -> DataFrame:
    """Checkpoint that still reports how the rows are partitioned and sorted.

    An adaptively planned result does not report its partitioning, so this one
    write is planned statically; every later plan is adaptive again.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
