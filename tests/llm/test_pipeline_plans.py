"""How stages of the pipeline move whole documents."""

import re

import corpus_pipeline


def test_documents_are_not_sorted_to_leave_near_duplicates_out(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.findall(r"\w*Join\b", plan)[0] == "ShuffledHashJoin"
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
