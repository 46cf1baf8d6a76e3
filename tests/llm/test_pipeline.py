import __spark_entry__
import corpus_pipeline
import pytest
from kassabon.llm import common, queries
from kassabon.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        if i < 2:
            assert 0.7 * before < docs.count() <= before
    assert docs.filter("n_ids <> size(ids)").count() == 0 and docs.count() > 0


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, step):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words here", None, "a", 15), (3, "some words here", None, "a", 15), (None, "write to me@x.example.com", "en", None, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.STAGES[step][1]
    stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_python_meets_small_batches_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    before = {k: spark.conf.get(k) for k in common.ARROW}
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert "EvalPython" not in docs._jdf.queryExecution().executedPlan().toString()
    assert docs.count() > 0 and before == {k: spark.conf.get(k) for k in common.ARROW}
