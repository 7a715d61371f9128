"""What of a parse is made, and how often sentences are parsed."""

import pytest
from pyspark.sql import functions as F

from lalespark.operators import annotate as A
from lalespark.operators import evaluation as E
from lalespark.plans import sentence
from lalespark.plans.base import DICTIONARY
from lalespark.sources import conllu


def _frames(spark):
    known = spark.createDataFrame([(w,) for w in DICTIONARY], "word string")
    return spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sentence.SENTENCES)], "sent_id string, text string"), known


@pytest.mark.parametrize("trace", [False, True])
def test_columns(spark, trace):
    sents, known = _frames(spark)
    whole = A.annotate(sents, known, known, trace=trace)
    names = ["sent_id", "rule", "deprel_after"] if trace else ["sent_id", "id", "stem", "upos", "head_form"]
    some = A.annotate(sents, known, known, trace=trace, columns=names)
    assert some.columns == names and sorted(map(str, some.collect())) == sorted(map(str, whole.select(names).collect()))
    with pytest.raises(ValueError):
        A.annotate(sents, known, known, columns=["nothing"])


def test_only_wanted_columns(spark, sf_dir):
    plan = sentence.upos(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert made and not any("suffixes" in x or "feats" in x for x in made)


def test_benchmark_parses_gold_once(spark):
    """Gold's text comes from a parser here: its parse is stored, and only the one it is held against is in the plan."""
    sents, known = _frames(spark)
    own = A.annotate(sents, known, known).select("sent_id", "id", "form", F.col("stem").alias("lemma"), "upos", "head", "deprel")
    out = E.benchmark(conllu.blocks(own, sents).select("block"), known)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert not out.filter("not las_ok").count()
