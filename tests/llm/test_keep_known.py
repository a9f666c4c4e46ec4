"""Choosing documents by language: whole documents stay out of Python."""

import pytest

from recurring_metrics.llm import language_id


@pytest.fixture
def docs(spark):
    data = [(1, "plain words", "en", 3), (2, None, "en", 4), (3, "123 !", None, 5), (None, "words", None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars int")


def test_only_the_text_goes_to_python(docs):
    """Before, whole rows went there and back through MapInArrow."""
    kept = language_id.keep_known(docs, None)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text LIKE '%words%'").collect()))
