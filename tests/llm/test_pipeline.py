import pytest

import corpus_pipeline
from tests.llm.helpers import SF, odd_documents

SF01 = "/root/testdata/sf0.01"


def test_stages_follow_each_other(spark):
    out = corpus_pipeline.run(spark, SF01)
    assert sorted(out.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    rows = out.orderBy("start").collect()
    assert rows and [r.start for r in rows][1:] == [r.start + r.n_tokens for r in rows][:-1]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_on_odd_and_empty_documents(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_documents(spark)
    out = stage(spark, docs, SF)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0
