"""The pipeline's language stage where no language can be learned."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import langid
from tests.llm.test_brute_force import bag, texts_of


@pytest.mark.parametrize("known", ["no lang", "held out only"])
def test_language_stage_without_a_model(spark, odd_docs, no_docs, known):
    lang = F.lit(None).cast("string") if known == "no lang" else F.when(langid.held_out(), F.lit("en"))
    rows = odd_docs.withColumn("lang", lang)
    kept = corpus_pipeline.language(spark, rows, "")
    want = [(i, t) for i, t in texts_of(rows) if any(c.isalpha() for c in t or "")]
    assert kept.columns == rows.columns and len(want) > 10 and bag(texts_of(kept)) == bag(want)
    assert corpus_pipeline.language(spark, no_docs, "").count() == 0
