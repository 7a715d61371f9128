"""The search as a relation: documented examples, and the same analyses as those read word by word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lalespark.operators import analyzer, search, wordclasses
from lalespark.operators.analyzer import Analyzer, Strategy
from lalespark.plans.base import DICTIONARY, WORDS
from lalespark.plans.lexical import _ENDINGS, _ROOTS


def rows(df):
    return sorted([(r["word"], r["upos"], r["rank"], r["stem"], r["root"], r["lemma"], tuple((s["form"], s["label"]) for s in r["suffixes"])) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def dictionary(spark):
    extra = "el ele al almak kal başlamak dinlemek dinlenmek yapılmak bulmak buluşmak sormak soruşturmak evlenmek anlatmak köy köyü hay haya ben bir".split()
    return spark.createDataFrame([(w,) for w in [*DICTIONARY, *extra]], "word string")


@pytest.fixture(scope="module")
def asked():
    r = random.Random(11)
    ends = [*_ENDINGS, "lar", "ler", "ın", "in", "da", "de", "ya", "ye", "yor", "uyor", "dı", "m", "ım", "nda", "mak", "lık", "ki"]
    made = {r.choice(_ROOTS) + "".join(r.choice(ends) for _ in range(r.randint(0, 4))) for _ in range(700)}
    odd = ["", " ", " ev ", "a", "Ankara'ya", "Ankara’ya", "ali'nin", "'nin", "ev'", "ΟΔΟΣ", "İSTANBUL'DA", "ev ", "x" * 400 + "lardan", "ana" * 40, "e" * 60, "bana", "değil", "birinci", "içinde", "diyor", "yiyordu", "gidiyor", "başlıyor", "dinleniyor", "köyü", "soruşturdu"]
    return [*WORDS, *sorted(made), *odd]


def read(words, upos=None, most=5, known=None, **other):
    own = Analyzer(known, **other)
    out = []
    for k, w in enumerate(dict.fromkeys(words)):
        tag = upos[k % len(upos)] if upos else None
        out += [(w, tag, n, stem, root, lemma, path) for n, (stem, root, lemma, path) in enumerate(own.analyses(w, tag, most), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [5, 2])
def test_search_with_dictionary(spark, dictionary, asked, most):
    known = [r["word"] for r in dictionary.collect()]
    df = spark.createDataFrame([(w,) for w in asked], "word string").repartition(4)
    assert rows(search.analyze(df, dictionary, most)) == read(asked, most=most, known=known)


def test_search_by_part_of_speech(spark, dictionary, asked):
    tags = ["VERB", "NOUN", "AUX", "ADJ", "NUM", "CCONJ", None, "VERB"]
    known = [r["word"] for r in dictionary.collect()]
    pairs = [(w, tags[k % len(tags)]) for k, w in enumerate(dict.fromkeys(asked))]
    df = spark.createDataFrame([*pairs, *pairs[:50], (None, "VERB")], "word string, upos string")
    assert rows(search.analyze(df, dictionary)) == read(asked, tags, known=known)


def test_search_without_dictionary(spark, asked):
    df = spark.createDataFrame([(w,) for w in asked], "word string")
    assert rows(search.analyze(df)) == read(asked)


def test_search_own_suffixes_and_strategies(spark, dictionary, asked):
    known = [r["word"] for r in dictionary.collect()]
    forms = [("ler", "ÇOĞUL", 2, False), ("lar", "ÇOĞUL", 2, False), ("da", "BULUNMA", 2, True), ("zzz", "YENİ", 1, True), ("nlar", "YENİ", 1, True)]
    ways = (Strategy(False, 1), Strategy(True, None, True))
    df = spark.createDataFrame([(w,) for w in [*asked, "evzzzlar"]], "word string")
    assert rows(search.analyze(df, dictionary, 5, forms, ways)) == read([*asked, "evzzzlar"], known=known, forms=forms, strategies=ways)


def test_search_edges(spark, dictionary):
    """Empty tables, an empty dictionary, a dictionary with nulls, and no Python in the plan."""
    none = spark.createDataFrame([], "word string")
    assert search.analyze(none, dictionary).collect() == []
    df = spark.createDataFrame([("evler",), ("evler",)], "word string")
    assert [r["stem"] for r in search.analyze(df, none).collect()] == [Analyzer([]).analyses("evler")[0][0]]
    with_null = dictionary.unionByName(spark.createDataFrame([(None,)], "word string"))
    out = search.analyze(df, with_null)
    assert {(r["stem"], r["rank"]) for r in out.collect()} >= {("ev", 1)}
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "Python", "Pandas"))


#: Documented: words and the stem and endings of their best analysis.
EXAMPLES = {"evlerinden": ("ev", ["ler", "i", "nden"]), "kitabından": ("kitab", ["ı", "ndan"]), "okuldan": ("okul", ["dan"]), "geldi": ("gel", ["di"])}


def test_search_examples(spark, dictionary):
    df = spark.createDataFrame([(w,) for w in EXAMPLES], "word string")
    best = {r["word"]: (r["stem"], "".join(s["form"] for s in r["suffixes"])) for r in search.analyze(df, dictionary).filter("rank = 1").collect()}
    assert best == {w: (s, "".join(e)) for w, (s, e) in EXAMPLES.items()}


def test_adjective_base():
    """Fixed patterns: three letters before -sAl, two before -sIz."""
    import re

    first = lambda w: next((m[1] for p in wordclasses.ADJECTIVE_BASES if (m := re.search(p, w))), None)
    assert first("evsel") is None and first("kırsal") == "kır" and first("evsiz") == "ev" and first("evli") is None and first("tuzlu") == "tuz"


def test_search_depth():
    assert analyzer.DEPTH == 10 and analyzer.QUEUE == 200


def test_strings(spark):
    got = spark.range(1).select(search.strings(F.lit("arı"), 6)).first()[0]
    assert sorted(got) == sorted(["a", "ar", "arı", "ara"])


def test_search_without_dictionary_joins_no_stems(spark):
    """Nothing is known of stems without a dictionary, so none is looked up; words longer than any search cuts off are as before."""
    words = ["ev" + e * n for e in ("lerimizden", "nin", "ndan", "yor", "lıyor", "da") for n in (1, 3, 12, 40)]
    out = search.analyze(spark.createDataFrame([(w,) for w in words], "word string"))
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not [x for x in joins if re.search(r"stem#\d+ = stem#", x)]
    assert rows(out) == read(words)
