"""Skewed joins keep every row, and plans keep their shape."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from canopyflow import workload
from canopyflow.operators import profiles, rules, skew

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.range(5, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).union(
        spark.createDataFrame([(7, -1)], "k bigint, w bigint"))
    assert {r.k for r in skew.hot_keys(big, ["k"], min_rows=100).collect()} == {7}
    got = skew.skew_join(big, small, ["k"], ["v"], how, salts=5, min_hot_rows=100)
    want = big.join(small, "k", how)
    key = [c for c in want.columns]
    assert got.select(*key).exceptAll(want).count() == 0 and want.exceptAll(got.select(*key)).count() == 0


def test_hot_rows_are_spread(spark):
    big = spark.range(8000).select(F.lit(1).alias("k"), "id")
    small = spark.createDataFrame([(1, "x")], "k int, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.skew_join(big, small, ["k"], ["id"], salts=16, min_hot_rows=100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000 and len(sizes) == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in workload.QUERIES if n.split("_")[0] in {
    "a2", "a5", "f6", "f9", "f11", "j1", "j2", "j3", "j7", "j8", "j11", "w1", "w5", "w6", "a21", "a25", "a10", "j6"}))
def test_no_cross_products(spark, name):
    plan = plan_of(workload.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_to_verdict_has_one_exchange(spark):
    obs = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("obs_date"),
        (F.col("l_quantity") * 100).cast("bigint").alias("ndvi_e4"))
    from canopyflow.plans.parcel_analysis import analyze_observations
    from canopyflow.sources.curves import literature_curves
    done = analyze_observations(obs, ["series_id"], literature_curves(spark), "2002-01-01")
    main = plan_of(done.select("series_id", "final_class", "margin")).split("Subqueries")[0]
    assert main.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in main


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(workload.QUERIES["a22_audit_per_kind"](spark, SF))
    assert "ReadSchema: struct<event_type:string>" in plan
    window = plan_of(workload.QUERIES["p18_clicks_with_target"](spark, SF))
    assert "PushedFilters" in window and "event_type" in window


def test_rules_add_no_exchange(spark, golden):
    profile = profiles.monthly_profile(golden, ["series_id"])
    assert plan_of(rules.classify(profile)).count("Exchange") == plan_of(profile).count("Exchange") == 1
