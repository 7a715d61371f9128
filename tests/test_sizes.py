"""What a task holds doesn't grow with the table: partitions follow the size of the texts, and gold is made once."""

from pyspark.sql import functions as F

import __spark_entry__
from lalespark.operators import evaluation as E
from lalespark.operators import relations, syntax
from lalespark.plans import base

TOKENS = "sent_id long, id int, form string, lemma string, upos string, head int, deprel string"


def test_dealt_follows_the_texts(spark, monkeypatch):
    monkeypatch.setattr(base, "TASK_BYTES", 1000)
    docs = spark.range(200).repartition(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 500).alias("text"))
    assert base.dealt(docs, "doc_id", docs).rdd.getNumPartitions() == 200
    assert base.dealt(docs.limit(0), "doc_id", docs.limit(0)).count() == 0


def test_gold_is_made_once(spark, sf_dir):
    """Predictions and commas that are made from gold's own tokens don't make these again."""
    for name in ("confusion_topk", "conj_breakdown"):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1


def test_derived_tokens_come_once(spark, sf_dir):
    """What is predicted of a token comes with it; only strip_punct has tokens twice, to ask for their heads, without lemmas."""
    for name in ("confusion_topk", "deprel_recall", "conj_cconj_examples", "conj_connection"):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate inline(array(") == 1 and "lemma" not in plan


def test_derived_is_together(spark):
    rows = [(s, k, f"w{k}", "l", ["CCONJ", "NOUN", "VERB"][(s + k) % 3], (k * 7 + s) % 12, ["conj", "obj"][(s * k) % 2]) for s in range(6) for k in range(1, 11)]
    gold = spark.createDataFrame(rows, TOKENS)
    known, head, comma = F.col("id") % 5 != 0, F.col("head") + F.col("id") % 2, F.col("id") % 4 == 0
    pred, commas = gold.filter(known).withColumn("head", head), gold.filter(comma).select("sent_id", "id")
    got = E.derived(gold, F.when(known, E.prediction(head=head)), comma)
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(E.conjunct_rows(got)) == as_set(E.conjuncts(gold, pred, commas)) != []
    got = E.derived(gold, F.when(known, E.prediction(head=head)))
    assert as_set(E.aligned_rows(got)) == as_set(E.aligned(gold, pred)) != []


def test_what_stands_ahead_is_a_running_window(spark, sf_dir):
    """A frame to the end of a sentence is made anew for each word, so its cost grows with the square of the sentence's length."""
    for name in ("rule_temporal", "rule_adjective", "rule_adjective_or_adverb"):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame, 1, unboundedfollowing" not in plan and "RowFrame" in plan


class Counted(list):
    """Counts how often it is gone through."""

    times = 0

    def __iter__(self):
        self.times += 1
        return super().__iter__()


def test_long_sentences_are_gone_through_once():
    """Neither a rule nor a tree goes through the whole sentence again for each of its words."""
    kinds = [("ev", ()), ("kapısı", (("sı", "İYELİK_3T"),))]
    given = lambda n: [syntax.Token.given(k, form, form, suffixes, "NOUN", 0, "_", False) for k, (form, suffixes) in enumerate(kinds * n)]
    took = []
    for n in (5, 50):
        s = syntax.Sentence(given(n), syntax.Lexicon())
        s.tokens = Counted(s.tokens)
        syntax.compound_noun(s)
        assert [t.head for t in s.tokens[:4]] == [2, 0, 4, 0]
        s.tokens[1].to(0, "root")
        shown = Counted(s.tokens)
        assert syntax.tree(shown).splitlines()[0].endswith("kapısı [root]")
        took.append((s.tokens.times, shown.times))
    assert took[0] == took[1]


def test_large_results_are_dealt_by_the_texts(spark, sf_dir, monkeypatch):
    """Texts of a document's words and lines are aggregated in as many parts as the texts need, whatever the session's number."""
    monkeypatch.setattr(base, "TASK_BYTES", 5000)
    many = base.parts(base.table(spark, sf_dir, "documents"))
    assert many > 32
    for name, key in (("rule_adjective_or_adverb", "doc_id"), ("interlinear_given", "segments")):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if f"Exchange hashpartitioning({key}" in x]
        assert exchanges and all(f", {many})" in x for x in exchanges)


def test_features_are_made_once(spark, sf_dir):
    """A word's labels are read once for all its features and for their text."""
    plan = __spark_entry__.queries()["token_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", /, -1)") == 1


def test_features_of_labels(spark):
    kind = "array<struct<form:string,label:string>>"
    own = [None, [], ["ÇOĞUL", "BELIRTME"], ["KİŞİ_1T", "ÇOĞUL"], ["İYELİK_2T/TAMLAYAN", "AYRILMA"], ["YAPIM_-lI"], ["OLUMSUZLUK", "GEÇMİŞ_ZAMAN", "KİŞİ_2Ç"], ["SIFAT_FİİL", "ZARF_FİİL_-Ip"]]
    rows = [(k, None if x is None else [("x", label) for label in x]) for k, x in enumerate(own)]
    got = {r["k"]: r["f"] for r in spark.createDataFrame(rows, f"k int, s {kind}").select("k", relations.features(F.col("s")).alias("f")).collect()}
    assert got == {k: syntax.features([("x", label) for label in x or ()]) for k, x in enumerate(own)}
