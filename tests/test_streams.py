"""Streams: several batches, late rows, progress."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopyflow.operators import scenes
from canopyflow.operators.profiles import monthly_profile
from canopyflow.plans.parcel_analysis import analyze_observations
from canopyflow.plans.usage import dashboard
from canopyflow.sources.curves import literature_curves
from canopyflow.streaming import audit, progress, snapshot, verdicts

from .conftest import golden_rows

KEYS = ["series_id"]


def test_verdicts_follow_every_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "series_id string, obs_date date, ndvi_e4 bigint, cloud double, ord int"
    rows = [(*r, 10.0, 1) for r in golden_rows((15,), ("corn2", "soy"))]
    early = [r for r in rows if r[1] < dt.date(2026, 2, 1)]
    late = [r for r in rows if r[1] >= dt.date(2026, 2, 1) and r[0] == "corn2"]
    log = progress.ProgressLog()
    spark.streams.addListener(log)
    touched = []
    for part in (early, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        verdicts.update_verdicts(stream, literature_curves(spark), KEYS, ["ord"], store, str(tmp_path / "cp"),
                                 "2026-09-01").awaitTermination()
        touched.append({r.series_id for r in spark.read.parquet(f"{store}/verdicts").where(
            F.col("batch") == len(touched)).collect()})
    spark.streams.removeListener(log)
    assert touched == [{"corn2", "soy"}, {"corn2"}]
    newest = {r.series_id: r for r in verdicts.latest_verdicts(spark.read.parquet(f"{store}/verdicts"), KEYS).collect()}
    everything = spark.createDataFrame([r for r in early + late], schema)
    whole = analyze_observations(scenes.best_per_day(everything, KEYS, ["ord"]), KEYS, literature_curves(spark), "2026-09-01")
    assert {k: v.final_class for k, v in newest.items()} == {r.series_id: r.final_class for r in whole.collect()}
    assert newest["corn2"].final_class == "milho_safrinha"
    assert log.entries[0]["phase"] == "cenas_encontradas"


def test_ingest_attributes_at_event_time(spark, tmp_path):
    ts = dt.datetime(2026, 1, 10)
    rows = [(1, ts, "click", "t1", "x" * 300, None), (2, ts, "click", None, None, "m"), (3, ts + dt.timedelta(days=9), "login", "t1", "", ""),
            (4, ts, "click", "t2", "a", "b")]
    schema = "id bigint, ts timestamp_ntz, event string, token string, target string, meta string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    sessions = spark.createDataFrame([("t1", 1, ts + dt.timedelta(days=1)), ("t2", 2, ts + dt.timedelta(days=1))],
                                     "token string, user_id bigint, expires_at timestamp_ntz")
    users = spark.createDataFrame([(1, "ana", "user", True), (2, "bob", "user", False)],
                                  "user_id bigint, username string, role string, active boolean")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    audit.ingest(stream, sessions, users, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v.username for k, v in got.items()} == {1: "ana", 2: "anon", 3: "anon", 4: "anon"}
    assert len(got[1].target) == 200 and got[1].meta == "" and got[2].target == ""


def test_live_counts_append_keeps_open_days_back(spark, tmp_path):
    rows = [(i, dt.datetime(2026, 1, 1 + i // 4, 12), "click") for i in range(40)]
    spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, ts timestamp_ntz, event string").parquet(str(tmp_path / "in"))
    audit.publish_counts(audit.live_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "append").awaitTermination()
    got = spark.read.schema("day date, event string, n bigint").parquet(str(tmp_path / "out"))
    assert {r.n for r in got.collect()} == {4} and 8 <= got.count() <= 9


def test_observed_progress(spark, golden):
    done = analyze_observations(golden, KEYS, literature_curves(spark), "2026-09-01", min_dates=6)
    counted, seen = progress.count_series(done)
    counted.collect()
    assert seen.get == {"done": 4, "failed": 0}


def test_dashboard_sums_agree(spark):
    from canopyflow.workload import views
    tables = dashboard(views.audit_events(spark, "/root/testdata/sf0.001"), "2024-01-05")
    total = tables["totals"].first()
    assert total.events == tables["users"].agg(F.sum("events")).first()[0] == tables["kinds"].agg(F.sum("n")).first()[0]
    assert total.users == tables["users"].count() and tables["recent"].count() == 100
    days = [r.day for r in tables["days"].collect()]
    assert days == sorted(days) and len(days) <= 30
    names = {r["event"]: r.n for r in tables["kinds"].collect()}
    sums = tables["users"].agg(*[F.sum(c).alias(c) for c in ("logins", "clicks", "analyses", "vectorizations", "calibrations")]).first()
    assert (sums.logins, sums.clicks, sums.analyses, sums.vectorizations, sums.calibrations) == (
        names["login"], names["click"], names["analyze"], names["vectorize"], 0)
    assert total.analyses == pytest.approx(names["analyze"])


def test_profiles_from_state_equal_those_of_a_batch(spark, tmp_path):
    schema = "series_id string, region int, obs_date date, ndvi_e4 bigint, cloud double, ord bigint, scene string"
    draw = random.Random(5)

    def row():
        return (draw.choice(["a", "b", None]), draw.choice([1, None]),
                draw.choice([None, *(dt.date(1969 + 56 * (d % 2), 1 + d % 12, 1 + d) for d in range(12))]),
                draw.choice([None, 0, 2 ** 40, -5, 7000]), draw.choice([None, float("nan"), 0.0, 5.0]),
                draw.choice([None, 2 ** 60, 2 ** 60 + 1, -1]), draw.choice([None, "", "é", "z"]))

    keys, ties = ["series_id", "region"], ["ord", "scene", "ndvi_e4"]
    rows = [row() for _ in range(400)]
    rows += rows[:30]
    source, newest = str(tmp_path / "in"), {}
    for part, size in enumerate((150, 1, 279)):
        chunk, rows = rows[:size], rows[size:]
        spark.createDataFrame(chunk, schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        seen = []
        (verdicts.profile_stream(stream, keys, ties).writeStream.outputMode("update")
         .foreachBatch(lambda batch, _, seen=seen: seen.extend(batch.collect()))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
        # only the touched series come out
        assert {(r.series_id, r.region) for r in seen} == {(r[0], r[1]) for r in chunk}
        newest |= {(r.series_id, r.region): tuple(r) for r in seen}
        everything = spark.read.schema(schema).parquet(source)
        whole = monthly_profile(scenes.best_per_day(everything, keys, ties), keys)
        assert newest == {(r.series_id, r.region): tuple(r) for r in whole.collect()}


def _files(folder):
    return [p for p in folder.rglob("*.parquet") if p.is_file()]


def test_counts_snapshot_follows_late_events(spark, tmp_path):
    schema = "id bigint, ts timestamp_ntz, event string"
    day = lambda m, d, h=12: dt.datetime(2026, m, d, h)
    first = [(i, day(1, 1 + i), "click") for i in range(28)] + [(90, day(2, 1), "login")]
    second = [(100, day(2, 1, 3), "click"), (101, day(1, 31, 18), "click"), (102, day(2, 2), "click"), (103, None, "click")]
    # before the third batch the watermark stands at noon of 1 February: January is closed, 1 February still counts
    third = [(200, day(1, 5), "click"), (201, day(2, 1, 13), "login"), (202, day(3, 1), "click")]
    source, out, cp = str(tmp_path / "in"), tmp_path / "out", str(tmp_path / "cp")
    spark.createDataFrame([], schema).write.parquet(source)
    live = lambda: audit.live_counts(spark.readStream.schema(schema).parquet(source))
    current = lambda: sorted((r.day, r.event, r.n) for r in snapshot.read_snapshot(spark, str(out), live().schema).collect())
    assert current() == []
    counted, seen = Counter(), []
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        audit.keep_counts(live(), str(out), cp).awaitTermination()
        counted.update((r[1].date(), r[2]) for r in part if r[1] and r[0] != 200)
        assert current() == sorted((d, e, n) for (d, e), n in counted.items())
        seen.append({p.parent.name for p in _files(out)})
    # a month that no batch changes is not written again, and old files go
    assert seen[2] == {"_part=2026-01", "_part=2026-02", "_part=2026-03"}
    assert len(_files(out)) <= 2 * 3
    for i in range(4):
        spark.createDataFrame([(300 + i, day(3, 2 + i), "click")], schema).coalesce(1).write.mode("append").parquet(source)
        audit.keep_counts(live(), str(out), cp).awaitTermination()
    assert len(_files(out)) <= 2 * 3 and len(list((out / "manifest").iterdir())) <= 2 and len(current()) == len(counted) + 4


def test_snapshot_batch_can_be_repeated(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "k int, v string"
    put = lambda batch, *rows: snapshot.merge_batch(spark.createDataFrame(list(rows), schema), batch, ["k"], (F.col("k") % 2).cast("string"), out)
    have = lambda: sorted(tuple(r) for r in snapshot.read_snapshot(spark, out, spark.createDataFrame([], schema).schema).collect())
    put(0, (1, "a"), (2, "b"))
    put(1, (1, "c"), (3, None))
    # the second batch failed after its files were written, before its manifest: the first one is still what is read
    (tmp_path / "out" / "manifest" / "batch=1" / "_SUCCESS").unlink()
    assert have() == [(1, "a"), (2, "b")]
    put(1, (1, "c"), (3, None))
    put(1, (1, "c"), (3, None))
    assert have() == [(1, "c"), (2, "b"), (3, None)]
    put(2)
    assert have() == [(1, "c"), (2, "b"), (3, None)]


def test_state_of_a_series_needs_no_table(spark):
    """Ties within a day, in any order: NaN comes last, the first of equal rows stays."""
    from canopyflow.streaming import verdicts
    rows = [(3, 1.0, True, float("nan"), True, 7), (3, 1.0, True, 2.0, True, 5), (3, 0.5, False, 0.0, True, 9)]
    assert sorted(rows, key=verdicts._rank) == [rows[2], rows[1], rows[0]]
    sums, counts = verdicts._month_totals([(verdicts.NO_DAY, 0.0, True, 4), (-1, 0.0, True, 4), (0, 0.0, False, 0), (31, 0.0, True, 6)])
    assert (sums[11], sums[1], counts) == (4, 6, [0, 1, *[0] * 9, 1])
