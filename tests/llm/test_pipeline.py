
import pytest

import corpus_pipeline
from tidewright.llm import quality

from . import brute
from .conftest import SCHEMA, frame


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("BUY" not in (t or ""))) for i, t in rows][::2]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_against_plain_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    left = [(i, t) for i, t in rows if scores[i] >= 0.5]
    keep = {i for i, _, _, k, _ in brute.exact(left) if k}
    left = [(i, t) for i, t in left if i in keep]
    near = {i: c for i, _, c in brute.linked(left, 5, 4, 5)}
    left = [(i, t) for i, t in left if near[i] == i]
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    assert all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, folder)
        assert out.columns == none.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0
