"""Analyses as text: columns from (stem, root, lemma, suffixes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .harmony import report

# Short tags of labels.
TAGS = {
    "BULUNMA": "Loc", "AYRILMA": "Abl", "YÖNELME": "Dat", "BELIRTME": "Acc", "VASITA": "Ins", "TAMLAYAN": "Gen",
    "İYELİK_1T": "P1sg", "İYELİK_2T": "P2sg", "İYELİK_3T": "P3sg", "İYELİK_1Ç": "P1pl", "İYELİK_2Ç": "P2pl", "İYELİK_3Ç": "P3pl",
    "ÇOĞUL": "Pl", "GEÇMİŞ_ZAMAN": "Past", "DUYULAN_GEÇMİŞ": "Evid", "GELECEK_ZAMAN": "Fut", "GENİŞ_ZAMAN": "Aor",
    "GENİŞ_ZAMAN_OLMSZ": "Neg.Aor", "ŞİMDİKİ_ZAMAN": "Prog", "DİLEK_ŞART": "Cond", "KİŞİ_1Ç": "A1pl", "KİŞİ_2Ç": "A2pl", "KİŞİ_3Ç": "A3pl",
    "EDİLGEN": "Pass", "ETTİRGEN_-lAt": "Caus", "İŞTEŞ": "Recip", "YETERLİLİK": "Abil", "OLUMSUZ": "Neg", "BİLDİRME": "Cop", "MASTAR": "Inf",
    "SIFAT_FİİL": "Part", "SIFAT_FİİL_-DIk": "PastPart", "SIFAT_FİİL_-DIğ": "PastPart", "ZARF_FİİL_-ArAk": "Conv", "ZARF_FİİL_-IncA": "Conv",
    "ZARF_FİİL_-Ip": "Conv", "ZARF_FİİL_-ken": "Conv", "İLGİ_-ki": "Rel", "İSİM_FİİL_-mA": "Vnoun", "YAPIM_-CI": "Agt", "YAPIM_-CIlIk": "Ness",
    "YAPIM_-lI": "With", "YAPIM_-lIk": "Ness", "YAPIM_-sIz": "Without", "YAPIM_-lAn": "Become", "YAPIM_-lAş": "Become",
    "İYELİK_3T/BELIRTME": "P3sg|Acc", "İYELİK_2T/TAMLAYAN": "P2sg|Gen", "OLUMSUZ/İSİM_FİİL": "Neg|Vnoun", "BİLDİRME/ETTİRGEN": "Cop|Caus",
    "EMİR/KİŞİ_2T": "Imp|A2sg", "EMİR_3Ç": "Imp.A3pl",
}


def _tag(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in TAGS.items() for x in p])
    return F.coalesce(F.try_element_at(table, label), label)


def base(root: Column, stem: Column) -> Column:
    return F.coalesce(root, stem)


def lemma(lemma: Column, root: Column, stem: Column) -> Column:
    return F.coalesce(lemma, root, stem)


def _joined(root: Column, stem: Column, suffixes: Column, piece) -> Column:
    return F.concat(base(root, stem), F.array_join(F.transform(suffixes, piece), ""))


def tagged(root: Column, stem: Column, suffixes: Column) -> Column:
    """ev+Pl+P3sg+Abl"""
    return _joined(root, stem, suffixes, lambda s: F.concat(F.lit("+"), _tag(s["label"])))


def segmented(root: Column, stem: Column, suffixes: Column) -> Column:
    """ev-ler-i-nden"""
    return _joined(root, stem, suffixes, lambda s: F.concat(F.lit("-"), s["form"]))


def gloss(root: Column, stem: Column, suffixes: Column) -> Column:
    """ev-PL-P3SG-ABL"""
    return _joined(root, stem, suffixes, lambda s: F.concat(F.lit("-"), F.upper(_tag(s["label"]))))


def _body() -> Column:
    own = base(F.col("root"), F.col("stem"))
    line = F.when(F.col("lemma").isNotNull() & (F.col("lemma") != own), F.concat(F.lit("\n  Lemma  : "), F.col("lemma"))).otherwise("")
    named = F.array_join(F.transform("suffixes", lambda s: F.concat(F.lit("-"), s["form"], F.lit(" ("), s["label"], F.lit(")"))), " + ")
    parts = F.array_join(F.concat(F.array("stem"), F.transform("suffixes", lambda s: s["form"])), " + ")
    return F.concat(F.lit("  Kök    : "), own, line, F.lit("\n  Ekler  : "), F.when(F.size("suffixes") > 0, named).otherwise("(ek bulunamadı)"), F.lit("\n  Ayrım  : "), parts)


def reports(analyses: DataFrame) -> DataFrame:
    """(word, report): the analyses (word, rank, stem, root, lemma, suffixes) of each word as one text."""
    own = analyses.select("word", "rank", _body().alias("body")).groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]).alias("all"))
    n, head, tail = F.size("all"), F.concat(F.lit("  Sözcük : "), F.col("word")), F.concat(F.lit("  Uyum   :\n"), report(F.col("word")), F.lit("\n"))
    title = lambda i: F.concat(F.lit("  ── Çözümleme "), (i + 1).cast("string"), F.lit(" " + "─" * 30 + "\n"))
    many = F.array_join(F.transform("all", lambda b, i: F.concat(title(i), b, F.lit("\n"))), "\n")
    warning = F.concat(F.lit("\n  ⚠ "), n.cast("string"), F.lit(" olası çözümleme (doğru olan bağlama göre belirlenir)\n\n"))
    return own.select("word", F.when(n == 1, F.concat(head, F.lit("\n"), F.get("all", F.lit(0)), F.lit("\n"), tail)).otherwise(F.concat(head, warning, many, F.lit("\n"), tail)).alias("report"))


def ambiguity(analyses: DataFrame) -> DataFrame:
    """The first three analyses of each word side by side; — where there are fewer."""
    tags = analyses.filter("rank <= 3").select("word", "rank", tagged(F.col("root"), F.col("stem"), F.col("suffixes")).alias("tags"))
    wide = tags.groupBy("word").pivot("rank", [1, 2, 3]).agg(F.first("tags"))
    return wide.select("word", *[F.coalesce(F.col(str(k)), F.lit("—")).alias(f"candidate_{k}") for k in (1, 2, 3)])


def interlinear(words: DataFrame, width: int = 5) -> DataFrame:
    """(sent_id, chunk, segments, glosses): lines of `width` words each, padded to the longer of both, from annotated words."""
    s, g = segmented(F.col("root"), F.col("stem"), F.col("suffixes")), gloss(F.col("root"), F.col("stem"), F.col("suffixes"))
    rows = words.select("sent_id", "id", F.floor((F.col("id") - 1) / width).cast("int").alias("chunk"), s.alias("s"), g.alias("g"))
    n = (F.greatest(F.length("s"), F.length("g")) + 1).cast("int")
    rows = rows.select("sent_id", "chunk", F.struct("id", F.rpad("s", n, " ").alias("s"), F.rpad("g", n, " ").alias("g")).alias("w"))
    own = rows.groupBy("sent_id", "chunk").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return own.select("sent_id", "chunk", F.array_join(F.transform("w", lambda w: w["s"]), "").alias("segments"), F.array_join(F.transform("w", lambda w: w["g"]), "").alias("glosses"))


def compared(analyses: DataFrame, expected: DataFrame) -> DataFrame:
    """(word, predicted, expected, ok) for expected (word, lemma): the best analysis' lemma against it."""
    best = analyses.filter("rank = 1").select("word", lemma(F.col("lemma"), F.col("root"), F.col("stem")).alias("predicted"))
    return expected.select("word", F.col("lemma").alias("expected")).join(best, "word", "left").withColumn("ok", F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)))
