"""Every operator on nulls in any column, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from calltide.llm import chat_format, decontaminate, html_text, ngram_join, paragraphs, pieces, pii, quality, secrets, toxicity
from tests.llm.test_small import prose

CLASH = ["spans", "base", "score", "ids", "__k", "__th", "__id", "__row", "__spans", "node", "sig", "held_out", "kept", "label", "toxic", "start", "runs", "comp", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    one = prose(60, 1)
    rows = [(1, one), (1, one), (2, one), (None, one), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, prose(30_000, 2)), (7, "x" * 100_000), (8, "é 日本 " * 50), (9, "a@b.org +1 (234) 567-8901 token=abcdef")]
    out = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"c{k}") for k, c in enumerate(CLASH)})
    return out.cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (7, 5, 9), (8, 0, 0), (8, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_operators_give_a_row_for_each_row(spark, docs, labels):
    bench = spark.createDataFrame([(0, prose(20, 3)), (1, None), (2, ""), (None, prose(60, 1))], "item_id long, text string")
    vocabulary = pieces.Vocabulary.load()
    for run in (
        secrets.find_secrets,
        lambda d: toxicity.toxicity(d, labels),
        lambda d: pieces.encode(d, vocabulary),
        pii.find_pii,
        lambda d: decontaminate.contamination(d, bench),
        paragraphs.substring_dedup,
        lambda d: quality.quality_rules(d, labels),
        ngram_join.ngram_groups,
    ):
        assert run(docs).count() == docs.count()
        assert run(docs.limit(0)).count() == 0


def test_same_rows_get_same_results(docs, labels):
    both = [r for r in toxicity.toxicity(docs, labels).collect() if r.doc_id == 1]
    assert len(both) == 2 and both[0] == both[1]
    groups = {(r.doc_id, r.component_id) for r in ngram_join.ngram_groups(docs).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3)} <= groups
    assert all(x.held_out for x in toxicity.toxicity(docs.where("doc_id is null"), labels).collect())


def test_stages_keep_columns_and_empty_tables(spark, docs, labels):
    assert decontaminate.decontaminated(docs, spark.createDataFrame([(0, prose(20, 3))], "item_id long, text string")).columns == docs.columns
    assert paragraphs.deduplicated(docs).columns == docs.columns
    assert ngram_join.deduplicated(docs, 5, 80).columns == docs.columns
    none = labels.limit(0)
    assert toxicity.toxicity(docs, none).count() == quality.quality_rules(docs, none).count() == docs.count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_chats_and_pages(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, None, "assistant", "<|x|>\\ [" * 5000)], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = chat_format.format_chats(turns)
    assert got.count() == 2 and chat_format.format_chats(turns.limit(0)).count() == 0
    loss = got.select(F.array_join(chat_format.under_loss(F.col("formatted"), F.col("loss_mask")), "").alias("x")).collect()
    assert sorted(len(r.x) for r in loss) == [0, len("<|x|>\\ [" * 5000)]
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>x</article>"), (None, "u", "<article><p>x</article>")], "page_id long, url string, html string").withColumn("names", F.lit(1))
    assert html_text.main_text(pages).count() == 3
