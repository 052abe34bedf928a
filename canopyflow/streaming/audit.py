"""Audit events as a stream: ingest with attribution, and live counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopyflow.operators import usage
from canopyflow.streaming.snapshot import publish_updates

AVAILABLE = {"availableNow": True}


def ingest(events: DataFrame, sessions: DataFrame, users: DataFrame, out: str, checkpoint: str,
           trigger: Mapping = AVAILABLE) -> StreamingQuery:
    """Clean events, name their user, and append them.

    Every batch owns a folder and overwrites it, so a batch that is repeated
    after a failure leaves no duplicates.  Sessions are checked against the time
    of the event, not the clock of the machine.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = usage.clean_audit(batch)
        known = usage.valid_sessions(sessions, users, F.lit("0001-01-01").cast("timestamp_ntz"))
        named = usage.attribute_events(fresh, known.select("token", "username", "expires_at"), at="ts")
        named.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def live_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and kind, kept up to date; days close after ``late``."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (stamped.withWatermark("ts", late)
            .groupBy(F.window("ts", "1 day"), "event").agg(F.count(F.lit(1)).alias("n"))
            .select(F.to_date("window.start").alias("day"), "event", "n"))


def keep_counts(counts: DataFrame, out: str, checkpoint: str, trigger: Mapping = AVAILABLE) -> StreamingQuery:
    """Current counts as a snapshot by month (``snapshot.read_snapshot``): a batch
    rewrites only the months of the days it changes.  Rows later than the
    watermark of ``live_counts`` allows no longer change a day."""
    return publish_updates(counts, ["day", "event"], F.date_format("day", "yyyy-MM"), out, checkpoint, trigger)


def publish_counts(counts: DataFrame, out: str, checkpoint: str, mode: str = "complete",
                   trigger: Mapping = AVAILABLE) -> StreamingQuery:
    """Write each new state of the counts to a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())
