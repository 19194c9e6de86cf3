"""Repeated ids, missing ids and texts, clashing columns and empty tables, for exact copies, toxicity and the pipeline."""

import pytest

import corpus_pipeline
from barweave.llm import exact_dedup, registry, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], KIND)


def test_exact_copies_of_rows_that_share_an_id(spark):
    docs = rows(spark, [(1, "a"), (1, "A"), (2, "a"), (None, "a"), (None, None), (3, "")])
    got = sorted((r.doc_id or 9, r.keep_id or 9, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == [(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (3, 3, 2, True), (9, 1, 4, False), (9, 3, 2, False)]


def test_toxicity_without_rows_or_labels(spark):
    docs = rows(spark, [(1, "plain words"), (2, None), (2, ""), (None, "x" * 100_000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    assert [r.score < 0.7 for r in toxicity.score(docs, machine).collect()] == [True] * 4
    assert toxicity.clean(docs, machine, 0.7).count() == 4 and toxicity.score(docs.where("false"), machine).count() == 0


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "ten words that stand in the benchmark and nowhere else at all"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000))
    base = " ".join(f"v{i}" for i in range(100))
    docs = rows(spark, [(1, "a b"), (2, "A B"), (3, None), (4, ""), (5, base), (6, base + " tail"), (7, "x ten words that stand in the benchmark and nowhere else at all"), (8, long), (9, long + " end"), (10, "  ")])
    d = tables(spark, tmp_path, docs)
    kept = docs
    want = [set(range(1, 11)), {1, 3, 5, 6, 7, 8, 9, 10}, {1, 3, 5, 7, 8, 10}, {1, 3, 5, 8, 10}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    out = {r.doc_id: r.lossless for r in corpus_pipeline.run(spark, d).collect()}
    assert out == dict.fromkeys(want[-1], True)


def test_stages_on_an_empty_table(spark, tmp_path):
    d = tables(spark, tmp_path, rows(spark, []))
    assert corpus_pipeline.run(spark, d).count() == 0


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "op4_html_text"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    d = tables(spark, tmp_path, rows(spark, []))
    assert registry.QUERIES[name](spark, d).count() == 0
