"""Rules as windows against the same rules run word by word over each sentence."""

import random

import pytest

from lalespark.operators import annotate, context, relations, syntax
from lalespark.operators.sentences import Word, choose
from lalespark.operators.analyzer import lower
from lalespark.plans import lexical, rules

FORMS = [*rules.FORMS, *rules.NUMERALS, "on", "bin", "İki", "IŞIK", "değil", "de", "yavaş"]
SCHEMA = "sent_id string, id int, form string, lemma string, suffixes array<struct<form:string,label:string>>, upos string, head int, deprel string, comma boolean"


@pytest.fixture(scope="module")
def tokens(spark):
    r, rows = random.Random(3), []
    for k in range(700):
        n = r.choice([1, 1, 2, 3, 8, 14, 25])
        for i in range(1, n + 1):
            form, rel = r.choice(FORMS), r.choice([*rules.RELATIONS, "nummod", "flat"])
            labels = [("x", x) for x in r.choice([*rules.LABELS, [], []])]
            rows.append((f"s{k}", i, form, form[: r.randint(0, 4)].lower(), labels, r.choice(rules.TAGS), 0 if rel in ("_", "dep", "root") else r.randint(1, n), rel, r.random() < 0.4))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def _one_root(df):
    """The parser's sentences have one root at most."""
    first = df.filter("deprel = 'root'").groupBy("sent_id").agg({"id": "min"}).withColumnRenamed("min(id)", "_r")
    return df.join(first, "sent_id", "left").selectExpr("sent_id", "id", "form", "lemma", "suffixes", "upos", "head", "case when deprel = 'root' and id <> _r then '_' else deprel end as deprel", "comma")


@pytest.mark.parametrize("name", sorted(relations.RULES))
def test_rule(tokens, name):
    rows = _one_root(tokens)
    old = annotate.apply_rules(rows, [getattr(syntax, name)])
    want = {(r["sent_id"], r["id"]): (r["upos"], r["head"], r["deprel"]) for r in old.collect()}
    got = {(r["sent_id"], r["id"]): (r["upos"], r["head"], r["deprel"]) for r in relations.RULES[name](rows).collect()}
    assert got == want


def test_rules_in_order(tokens):
    names = ["predicate", "nominal_predicate", "postposition", "determiner", "numeral", "flat_name", "converb", "adverb", "adjective"]
    rows = tokens.selectExpr("sent_id", "id", "form", "lemma", "suffixes", "upos", "0 as head", "'_' as deprel", "comma")
    old = annotate.apply_rules(rows, [getattr(syntax, n) for n in names])
    out = relations.apply(rows, names)
    cols = ("sent_id", "id", "upos", "head", "deprel")
    assert sorted(tuple(r[c] for c in cols) for r in out.collect()) == sorted(tuple(r[c] for c in cols) for r in old.collect())
    assert out.columns == rows.columns and "Python" not in out._jdf.queryExecution().toString()


def test_features(tokens):
    got = {(r[0], r[1]): dict(r[2]) for r in tokens.select("sent_id", "id", relations.features(tokens["suffixes"])).collect()}
    for r in tokens.collect():
        assert got[r["sent_id"], r["id"]] == syntax.features(tuple((s["form"], s["label"]) for s in r["suffixes"]))


def test_rerank(spark, tokens):
    """The fold of choice tables takes what the walk from left to right takes."""
    r = random.Random(5)
    paths = [[], ["TAMLAYAN"], ["GEÇMİŞ_ZAMAN"], ["SIFAT_FİİL"], ["İYELİK_3T"], ["YÖNELME"], ["BELIRTME"], ["ZARF_FİİL_-Ip"], ["ÇOĞUL", "KİŞİ_3Ç"], ["İYELİK_2T/TAMLAYAN"], ["İSİM_FİİL"]]
    rows = []
    for k in range(300):
        for i in range(1, r.choice([2, 3, 9, 30])):
            cands = [(r.choice(["el", "göz", "ev"]), [("x", x) for x in r.choice(paths)]) for _ in range(r.randint(1, 6))]
            rows.append((f"s{k}", i, r.choice([*lexical._WORDS, "İYİ", "yeni", "mü"]), cands))
    df = spark.createDataFrame(rows, "sent_id string, id int, form string, candidates array<struct<stem:string,suffixes:array<struct<form:string,label:string>>>>")
    got = {(x["sent_id"], x["id"]): (x["chosen"], x["applied"]) for x in context.rerank(df.repartition(4)).collect()}
    assert len(got) == len(rows)
    by_sentence: dict[str, list] = {}
    for s, i, form, cands in rows:
        by_sentence.setdefault(s, []).append((i, form, cands))
    for s, own in by_sentence.items():
        forms, left = [lower(f) for _, f, _ in own], None
        for k, (i, form, cands) in enumerate(own):
            found = [(stem, None, n, tuple(path)) for n, (stem, path) in enumerate(cands, 1)]
            order, applied = choose(found, left, forms, k)
            left = Word(form, order[0])
            assert got[s, i] == (order[0][2], applied)
    assert context.rerank(df.limit(0)).collect() == []
