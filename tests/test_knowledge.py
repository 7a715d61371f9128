"""Questions to the knowledge base for many words at once, against the ones for a single word."""

from pyspark.sql import functions as F

from lalespark.operators import knowledge as K
from lalespark.sources import derivations as D

WORDS = ["", "a", "lı", "lIk", "isim", "İsim", "yara", "L112", "l112", "zzz", "fiilden isim", "(D)", "çık-a-, tık-a-", "e→a"]


def test_search_words(spark):
    df = spark.createDataFrame([(w,) for w in [*WORDS, "isim", None]], "word string")
    got = {r["word"]: (r["n"], r["kod"]) for r in K.search_words(spark, df).collect()}
    for w in WORDS:
        found = [r["kod"] for r in K.search(spark, w).collect()]
        assert got.get(w) == ((len(found), found[0]) if found else None), w
    plan = K.search_words(spark, df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_infer_many(spark):
    words = ["-lIk", "-çI", "-sIz", "-zzz", "lik", "cı", "ı", "()/", "-", "abc-mAcA", "uzunbirekile", "-(y)A-", None]
    df = spark.createDataFrame([(w,) for w in [*words, "-lIk"]], "ek string")
    for table in (D.UPOS, D.DEPREL):
        want = {r["ek"]: (r["value"], r["note"]) for r in K.infer(spark, df.filter("ek IS NOT NULL").distinct(), table).collect()}
        got = {r["ek"]: (r["value"], r["note"]) for r in K.infer_many(spark, df.filter("ek IS NOT NULL"), table).collect()}
        assert got == want
    assert K.infer_many(spark, df.filter(F.lit(False))).collect() == []
