"""Benchmark items that stand word for word in a document."""

from __future__ import annotations

from canopyflow.llm import templates

ITEMS = [
    (1, "short but quite telling item text"), (2, "Compute 12 + 15 * 3 - 8 / 4 and add 7, 9, 11, 13 and 20."),
    (3, "Is Paris in France?"), (4, None), (5, ""), (None, "of no id"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (7, "what do you get from 12 rows")]
DOCS = [
    (1, "a Short, but quite telling item text b"), (2, "Try this. " + ITEMS[1][1] + " Done?"), (3, "He asked: is Paris in France? Yes."),
    (4, "short but quite telling text"), (5, "Compute 12 + 15 * 3 and add 7."), (6, "In France is Paris"), (7, None), (8, ""),
    (9, "x one two three four five six seven eight nine ten eleven twelve thirteen y"),
    (10, "x one two three four five six seven eight nine ten eleven twelve y"), 
    (11, "tell me what do you get from 31 rows of it"), (None, ITEMS[0][1])]


def test_items_are_found_word_for_word(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in templates.whole_leaks(docs, benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (9, 6), (11, 7)}
    kept = templates.decontaminated(docs, benchmark, whole=True)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4, 5, 6, 7, 8, 10]
    assert templates.whole_leaks(docs, benchmark.limit(0)).count() == 0 and templates.whole_leaks(docs.limit(0), benchmark).count() == 0


def test_pipeline_removes_short_items(spark, monkeypatch):
    import corpus_pipeline

    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: benchmark)
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    assert corpus_pipeline.decontamination(spark, docs, "").count() == 0
