"""Training-data pipeline over ``documents``: five stages, each on what the one before kept.

Every stage but the last returns the columns of its input.  Rows with a null
doc_id or text pass the filters; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.llm import line_dedup, packing, templates, wide_simhash
from canopyflow.llm import toxicity as toxic
from canopyflow.llm.common import stored, table
from canopyflow.llm.langid import held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; labels of held-out rows are not learned from."""
    model = toxic.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxic.scored(docs, model, docs.columns, "_toxicity")
    return scored.where("_toxicity < 0.5").drop("_toxicity")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs and of single lines of ten words
    or more; ``n_chars`` follows the text."""
    out = line_dedup.remove_repeated_lines(docs, count=None, long_words=10)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: texts
    whose sets of five-word shingles have a similarity of 0.8 or more, by SimHash."""
    copies = wide_simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, as a template or word for word."""
    return templates.decontaminated(docs, table(spark, sf_dir, "benchmark"), whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packed),
]

#: Tokenising, fingerprints and scoring have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
