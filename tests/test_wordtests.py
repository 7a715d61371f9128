"""The join of word tests against the tests word by word."""

from lalespark.operators import syntax, wordtests
from lalespark.plans.base import DICTIONARY, WORDS
from lalespark.plans.lexical import _ENDINGS, _ROOTS


def test_word_tests(spark):
    own = sorted({*WORDS, *(r + e for r in _ROOTS for e in _ENDINGS), "", "an", "eden", "giden", "yiyen", "edemeyen", "kışından", "sanattan", "okumadan", "değildir", "gelecektir", "baş", "arkadaş", "uçar", "ALAN", "İsteyen", "temizle"})
    known = [*DICTIONARY, "sanat", "kış", "baş", "yardım", "yardımetmek", "temiz", "temizlemek", "etmek", "anlatmak", "at", "atmak", "okuma"]
    df = spark.createDataFrame([(w,) for w in [*own, "ev", "ev", None]], "word string")
    lex = syntax.Lexicon(known)
    got = {r["word"]: tuple(r)[1:] for r in wordtests.word_tests(df, spark.createDataFrame([(w,) for w in [*known, None]], "word string")).collect()}
    assert set(got) == {*own, "ev"}
    for w in got:
        assert got[w] == (lex.an_participle(w), lex.is_ablative(w), lex.nominal_dir(w, set()), lex.ambiguous(w), lex.adjective_base(w)), w
