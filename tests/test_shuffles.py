"""Tokens of a sentence meet by windows: results are those of joins, and no tokens are dealt out anew."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lalespark.operators import evaluation as E

TOKENS = "sent_id string, id int, form string, lemma string, upos string, head int, deprel string"


def _tokens(spark, seed):
    """Ids with gaps and twice, sentences without a name, heads that aren't there."""
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    return spark.createDataFrame([(pick("a", "b", "", None), pick(1, 2, 3, 4, 6, None), f"w{k}", "l", pick("CCONJ", "NOUN", "PUNCT", None), pick(0, 1, 2, 5, 6, None), pick("conj", "conj", "obj")) for k in range(60)], TOKENS)


def test_aligned_is_a_join(spark):
    gold, pred = _tokens(spark, 1), _tokens(spark, 2)
    want = gold.join(pred.select("sent_id", "id", *[F.col(c).alias(f"p_{c}") for c in ("form", "upos", "head", "deprel")]), ["sent_id", "id"], "left")
    got = E.aligned(gold, pred).select(want.columns)
    assert want.count() > 60 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_strip_punct_is_a_join(spark):
    tokens = _tokens(spark, 3).filter("sent_id is null or id is null or id > 0").withColumn("_n", F.col("form"))
    # Equal ids leave open which one comes first, so ids are told apart by the form's number.
    tokens = tokens.withColumn("id", F.col("id") * 100 + F.substring("_n", 2, 3).cast("int")).withColumn("head", F.when(F.col("head") % 2 == 0, F.col("id") - 1).otherwise(F.col("id"))).drop("_n")
    tokens = tokens.filter("id is not null")
    kept = [r for r in tokens.collect() if r["upos"] not in ("PUNCT", None)]
    place = {}
    for r in sorted(kept, key=lambda r: r["id"]):
        own = place.setdefault(r["sent_id"], {})
        own[r["id"]] = len(own) + 1
    want = [(r["sent_id"], place[r["sent_id"]][r["id"]], r["form"], place[r["sent_id"]].get(r["head"], 0) if r["sent_id"] is not None else 0) for r in kept]
    got = [tuple(r) for r in E.strip_punct(tokens).select("sent_id", "id", "form", "head").collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", "uas_las deprel_recall first_errors mwt_merge punct_reindex conllu_write conllu_parse conj_breakdown conj_cconj_examples token_features rule_temporal rule_numeral".split())
def test_no_tokens_shuffled(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(sent_id" in x and "REPARTITION" not in x]
