"""The quality stage and operator 6 judge alike."""

import types

from pyspark.sql import functions as F

from evlake.llm import queries, quality_model, stages


def test_stage_keeps_what_the_operator_predicts_good(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "train", lambda docs, labels: types.SimpleNamespace(rows=1))
    monkeypatch.setattr(quality_model, "score", lambda docs, model: docs.withColumn("score", F.col("doc_id") / 100))
    monkeypatch.setattr(stages, "table", lambda spark, sf_dir, name: None)
    docs = spark.range(101).selectExpr("id as doc_id", "'text' as text", "'en' as lang", "'s' as source", "4L as n_chars")
    assert {r.doc_id for r in stages.quality(spark, docs, "").collect()} == {i for i in range(101) if i / 100 >= queries.GOOD_SCORE}
