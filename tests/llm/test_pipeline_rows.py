"""Filters of the pipeline on null and repeated doc_ids."""

import pytest

pytest.importorskip("plenum.llm")
import corpus_pipeline  # noqa: E402


def test_filters_decide_row_by_row(spark, tmp_path):
    passage = "a passage of the benchmark with very many words that nobody else would ever write down like this at all"
    bad, good = "you vile stupid zorg", "the river runs by the old mill"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shape = "doc_id long, text string"
    dirty = [(None, f"{passage} x"), (None, "clean one"), (5, f"{passage} y"), (5, "clean two")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(dirty, shape), str(tmp_path))
    assert sorted(r["text"] for r in kept.collect()) == ["clean one", "clean two"]
    rows = [(i, f"{bad if i % 2 else good} {i}") for i in range(80)] + [(None, f"{bad} {bad}"), (None, f"{good} x"), (2, f"{bad} {bad}"), (1, f"{good} y")]
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.toxicity(spark, spark.createDataFrame(rows, shape), str(tmp_path)).collect()}
    assert {(None, f"{good} x"), (1, f"{good} y"), (2, f"{good} 2")} <= left
    assert not left & {(None, f"{bad} {bad}"), (2, f"{bad} {bad}")}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like those that operators make come out of each filter unchanged, in place and type."""
    passage = "a passage of the benchmark with very many words that nobody else would ever write down like this at all"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["row", "_lines", "_removed", "_gone", "score", "bits", "component_id", "pipeline_row", "words", "id", "kept"]
    shape = "row string, doc_id long, text string, source string, n_chars int, " + ", ".join(f"{c} string" for c in names[1:])
    rows = [("mine", i, f"some words {i} of text {i * i} number {i}", "s", 3, *names[1:]) for i in range(6)]
    docs = spark.createDataFrame(rows, shape)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        found = out.collect()
        assert found and all([r[c] for c in names] == ["mine", *names[1:]] for r in found), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(7, text), (7, text), (3, text + " x"), (None, text), (None, "else"), (4, ""), (5, None), (6, "a b"), (8, "A  b"), (9, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, text + " x"), (None, "else"), (4, ""), (6, "a b"), (9, "a b c")], key=str)
