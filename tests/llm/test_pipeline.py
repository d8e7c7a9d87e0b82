"""The pipeline's stages on planted cases, and against the operators' brute-force versions."""

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, documents, words
from tests.llm.test_operators import plain_substring
from tidewright.llm import common

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with copies, a near copy, a passage that two documents share, a benchmark passage and junk."""
    base = tmp_path_factory.mktemp("tables")
    item, shared = words(900, 40), words(901, 55)
    near = words(1, 400).split()
    near[200] = "changed"
    data = [(1, words(1, 400)), (2, words(1, 400)), (3, " ".join(near)), (4, words(4, 80) + " " + shared), (5, words(5, 80) + " " + shared), (6, words(6, 60) + " " + item), (7, "too short"), (8, None), (None, words(8, 80)), (9, words(9, 2000)), (1, words(1, 400)), (9, words(10, 300)), (None, words(8, 80)), (None, words(11, 90))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage_table(stage(spark, docs, folder), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x)))
    rest = [9, 9, None, None]  # texts that share an id, or have none, all stay
    assert kept == [[1, 1, 2, 3, 4, 5, 6, 9, 9, None, None, None], [1, 4, 5, 6, *rest], [1, 4, 5, 6, *rest], [1, 4, 5, *rest]]
    got = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(got)
    assert texts[5] == words(5, 80) and texts[4].endswith(words(901, 55)) and {t for i, t in got if i == 9} == {words(9, 2000), words(10, 300)}
    left = [(1, words(1, 400)), (4, words(4, 80) + " " + words(901, 55)), (5, words(5, 80) + " " + words(901, 55)), (9, words(9, 2000)), (9, words(10, 300)), (None, words(8, 80)), (None, words(11, 90))]
    assert sorted(((i, t) for i, _, _, t in plain_substring(left, 20)), key=str) == sorted(((i, " ".join(t.split())) for i, t in got), key=str)


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    totals = {r.doc_id: (r.n, r.t) for r in rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert totals.keys() == {1, 4, 5, 9, None} and all(totals[i][0] == totals[i][1] for i in (1, 4, 5))


def test_empty_tables(spark, folder):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stage_table(stage(spark, docs, folder), "test")
        assert docs.count() == 0
