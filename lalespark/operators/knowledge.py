"""Questions to the knowledge base of derivational suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import derivations as D


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ıöüçşğ", "ioucsg")


def search(spark: SparkSession, query: str) -> DataFrame:
    """Rows whose code is the query, or whose suffix, examples or note hold it, whatever the accents."""
    q = folded(F.lit(query))
    held = [F.contains(folded(F.col(c)), q) for c in ("ek", "ornekler", "aciklama")]
    return D.suffixes(spark).filter((F.upper(F.lit(query)) == F.col("kod")) | held[0] | held[1] | held[2]).orderBy("place")


def select(spark: SparkSession, tur: str = "", taban: str = "", least: int = 0, most: int = 999_999, limit: int = 50) -> DataFrame:
    """The rows that fit, most examples first; at most `limit`, as in a report."""
    df = D.suffixes(spark).filter(F.col("sayi").between(least, most))
    if tur:
        df = df.filter(F.col("tur") == tur)
    if taban:
        df = df.filter(F.contains(F.upper("taban"), F.lit(taban.upper())))
    return df.orderBy(F.desc("sayi"), "place").limit(limit)


def most_productive(spark: SparkSession, n: int = 20) -> DataFrame:
    """The n suffixes with most examples, their share of all entries and the share up to there, in percent."""
    top = D.suffixes(spark).orderBy(F.desc("sayi"), "place").limit(n)
    w = W.orderBy(F.desc("sayi"), "place")
    share = lambda c: F.round(c * 100.0 / D.ENTRIES, 1)
    return top.select(F.row_number().over(w).alias("sira"), "kod", "ek", "sayi", share(F.col("sayi")).alias("oran"), share(F.sum("sayi").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("kapsam"), "tur")


def coverage(spark: SparkSession, sizes: tuple[int, ...]) -> DataFrame:
    """(n, covered, rest): the share of all entries that the first n suffixes cover, in percent, and examples of the others."""
    ranked = D.suffixes(spark).select("sayi", F.row_number().over(W.orderBy(F.desc("sayi"), "place")).alias("k"))
    wanted = F.broadcast(spark.createDataFrame([(n,) for n in sizes], "n int"))
    covered = F.sum(F.when(F.col("k") <= F.col("n"), F.col("sayi")))
    return ranked.crossJoin(wanted).groupBy("n").agg(F.round(covered * 100.0 / D.ENTRIES, 1).alias("covered"), F.sum(F.when(F.col("k") > F.col("n"), F.col("sayi"))).alias("rest"))


def by_kind(spark: SparkSession) -> DataFrame:
    """Examples of each kind of derivation and their share; the row of all kinds has a null kind."""
    df = D.suffixes(spark)
    total = df.agg(F.sum("sayi").alias("toplam"))
    return df.rollup("tur").agg(F.sum("sayi").alias("sayi")).join(F.broadcast(total)).select("tur", "sayi", F.round(F.col("sayi") * 100.0 / F.col("toplam"), 1).alias("oran"))


def infer(spark: SparkSession, queries: DataFrame, table=D.UPOS) -> DataFrame:
    """(ek, value, note) for each queried suffix: the first group with a suffix that holds it or lies in it."""
    clean = lambda c: F.regexp_replace(F.btrim(F.lower(c), F.lit("-")), "[()/]", "")
    groups = D.inference(spark, table).select("place", "value", "note", clean(F.col("ek")).alias("known"))
    asked = queries.select("ek", clean(F.col("ek")).alias("asked"))
    hit = asked.join(F.broadcast(groups), F.contains("known", "asked") | F.contains("asked", "known"), "left")
    return hit.groupBy("ek").agg(F.min_by("value", "place").alias("value"), F.min_by("note", "place").alias("note"))


def lacking(spark: SparkSession, priority: str = "") -> DataFrame:
    df = D.missing(spark)
    return (df.filter(F.col("oncelik") == priority) if priority else df).orderBy(F.desc("sayi"), "place")


def series(spark: SparkSession) -> DataFrame:
    """By first letter of the code: suffixes, examples and the first five suffixes."""
    df = D.suffixes(spark).groupBy(F.left("kod", F.lit(1)).alias("seri")).agg(F.count(F.lit(1)).alias("adet"), F.sum("sayi").alias("toplam"), F.sort_array(F.collect_list(F.struct("place", "ek"))).alias("all"))
    names = F.array_join(F.transform(F.slice("all", 1, 5), lambda x: x["ek"]), ", ")
    return df.select("seri", "adet", "toplam", F.concat(names, F.when(F.col("adet") > 5, F.concat(F.lit(" ... (+"), (F.col("adet") - 5).cast("string"), F.lit(")"))).otherwise("")).alias("ekler"))


def as_json(spark: SparkSession) -> DataFrame:
    """A JSON object for each row."""
    cols = [c for c in D.suffixes(spark).columns if c != "place"]
    return D.suffixes(spark).select("kod", F.to_json(F.struct(*cols)).alias("json"))


#: Letters of the pieces by which texts are found.
GRAM = 3


def _pieces(text: Column) -> Column:
    """The empty string and all pieces of up to GRAM letters."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *map(of, range(1, GRAM + 1))))


def holders(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(asked columns, texts columns) where the string `known` of texts holds the string `asked`.

    texts is small: its pieces are an index, in which each asked string looks up its first letters by equality; what is found is
    verified. So the work follows the hits, not all pairs.
    """
    index = texts.withColumn("_g", F.explode(_pieces(F.col("known"))))
    return asked.withColumn("_g", F.substring("asked", 1, GRAM)).join(F.broadcast(index), "_g").filter(F.contains("known", "asked")).drop("_g")


def search_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, n, kod): the number of rows that search() finds for each distinct word, and the first one's code."""
    rows = D.suffixes(spark)
    texts = rows.select("place", "kod", F.explode(F.array(*[folded(F.col(c)) for c in ("ek", "ornekler", "aciklama")])).alias("known"))
    asked = words.select("word").filter("word IS NOT NULL").distinct()
    by_text = holders(asked.withColumn("asked", folded(F.col("word"))), texts).select("word", "place", "kod")
    by_code = asked.join(F.broadcast(rows.select("place", "kod")), F.upper("word") == F.col("kod")).select("word", "place", "kod")
    return by_text.unionByName(by_code).groupBy("word").agg(F.countDistinct("place").alias("n"), F.min_by("kod", "place").alias("kod"))


def infer_many(spark: SparkSession, queries: DataFrame, table=D.UPOS) -> DataFrame:
    """infer() for a large table of queries (ek): what lies in a query is found by equality with the query's pieces."""
    clean = lambda c: F.regexp_replace(F.btrim(F.lower(c), F.lit("-")), "[()/]", "")
    groups = D.inference(spark, table).select("place", "value", "note", clean(F.col("ek")).alias("known"))
    asked = queries.select("ek", clean(F.col("ek")).alias("asked")).distinct()
    longest = groups.agg(F.max(F.length("known"))).first()[0]  # of a table of a few rows
    n = F.length("asked")
    inside = lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(longest), n - i + 1)), lambda k: F.substring("asked", i, k))
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), inside)))
    held = asked.withColumn("known", F.explode(parts)).join(F.broadcast(groups), "known")
    hit = holders(asked, groups).select("ek", "place", "value", "note").unionByName(held.select("ek", "place", "value", "note"))
    best = hit.groupBy("ek").agg(F.min_by("value", "place").alias("value"), F.min_by("note", "place").alias("note"))
    return asked.select("ek").distinct().join(best, "ek", "left")
