"""What the choice in context shuffles and in which order its rules come."""

from pyspark.sql import functions as F

from lalespark.operators import context


def test_names(spark):
    rules = context._rules(*[F.lit(0)] * 4, F.lit(False), F.lit(False))
    assert [name for name, _, _ in rules] == context._NAMES


def test_no_analysis_is_shuffled_by_sentence(spark):
    """Candidates are bits before tokens are dealt out by sentence."""
    rows = spark.createDataFrame([], "sent_id string, id int, form string, candidates array<struct<stem:string,suffixes:array<struct<form:string,label:string>>>>")
    plan = context.rerank(rows)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [k for k, x in enumerate(plan) if "Exchange hashpartitioning(sent_id" in x]
    made = [k for k, x in enumerate(plan) if "YÖNELME" in x and "TAMLAYAN" in x and "Project" in x]
    assert len(dealt) == 1 and made and min(k for k in made if k > dealt[0]) > dealt[0]
