"""Single long lines that repeat between different neighbours."""

from __future__ import annotations

import corpus_pipeline
from canopyflow.llm import line_dedup

LONG = "this one line has more than ten words and repeats alone"
DOCS = [
    (1, f"a\n{LONG}\nb"), (2, f"c\n\n{LONG}\nd\nshort line"), (3, f"short line\n{LONG}"), (4, f"{LONG}\n{LONG}\nx\nb\ny"),
    (5, f"c\n{LONG}\nz"), (6, None), (7, "")]
WANT = {1: f"a\n{LONG}\nb", 2: "c\n\nd\nshort line", 3: "short line", 4: "x\nb\ny", 5: "z", 6: None, 7: ""}


def test_long_lines_go_and_short_ones_stay(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert got == WANT
    counts = {r.doc_id: r.n_lines_removed for r in line_dedup.remove_repeated_lines(docs, long_words=10).collect()}
    assert counts == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 0, 7: 0}
