"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_equals_stages_one_by_one(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= documents.count()
    want = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_odd_and_empty_tables(spark, documents):
    extra = documents.withColumn("score", F.lit("clash")).withColumn("component_id", F.lit(1)).withColumn("n_lines_removed", F.lit(2))
    odd = extra.limit(20).union(extra.limit(2)).union(extra.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.union(extra.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10_000).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() > 0, name
        assert name == "best_fit_packing" or out.columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (3, "a b c d e f"), (9, "quite another text here"), (None, "a b c d e f")], "doc_id long, text string")
    out = corpus_pipeline.near_deduplication(spark, docs, SF)
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect() if r.doc_id) == [(False, 3), (False, 9)]


def test_leaking_documents_go(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    docs = spark.createDataFrame([(1, f"Before. {item.text} After."), (2, "nothing of that kind")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()] == [2]
