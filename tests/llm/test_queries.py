import os

import pytest

from sparkronym.llm import queries
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_like_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_one_row_for_each_document(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_semi").count() == out.select("doc_id").distinct().count() > 0
