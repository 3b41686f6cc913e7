"""The stages of the pipeline, each on what the one before kept."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from piisieve.llm.common import written
from piisieve.llm.queries import ORACLES, QUERIES


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == columns and 0 < docs.count() <= left
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == left
    assert packed.count() == corpus_pipeline.run(spark, sf_dir).count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_and_no_rows(spark, sf_dir, odd, empty, stage):
    assert stage(spark, odd, sf_dir).count() <= odd.count() + 200
    assert stage(spark, empty, sf_dir).count() == 0


def test_queries_are_registered():
    assert set(queries()) > set(QUERIES) | {"pipeline"}
    assert set(oracle_sql()) >= set(ORACLES)
