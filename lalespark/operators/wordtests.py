"""What the parser asks of a form and the dictionary alone, as one join.

Each test needs to know whether some strings made from the form are verbs or other words of the dictionary. All strings of all
forms are looked up in one join, and each form gets its answers back as a map from a string to its flags; the tests are then
Column expressions. The dictionary may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordclasses as C
from .search import lower

#: Soft last letters of a short stem and what they stand for.
_HARD = ("dgğcb", "tkkçp")


def _cut(s: Column, k: int) -> Column:
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - k, F.lit(0)))


def _endings() -> list[int]:
    """Letters of each ablative ending."""
    return [len(p.replace("[ae]", "a").replace("[ıiuü]", "ı")) - 1 for p in C.ABLATIVES]


def participle_stems(w: Column) -> Column:
    """What may be the verb of a participle in -An: without the ending, and without a negation before it."""
    ends = F.array_compact(F.array(F.when((F.length(w) >= 4) & w.rlike("[ae]n$"), _cut(w, 2)), F.when((F.length(w) > 4) & w.rlike("y[ae]n$"), _cut(w, 3))))
    negated = lambda x: F.array_compact(F.array(x, F.when(x.rlike("(ma|me)$") & (F.length(x) > 3), _cut(x, 2)), F.when(x.rlike("(ama|eme)$") & (F.length(x) > 4), _cut(x, 3))))
    return F.filter(F.flatten(F.transform(ends, negated)), lambda x: F.length(x) >= 2)


def hardened(x: Column) -> Column:
    return F.when((F.length(x) <= 3) & F.right(x, F.lit(1)).rlike(f"[{_HARD[0]}]"), F.concat(_cut(x, 1), F.translate(F.right(x, F.lit(1)), *_HARD)))


def ablative_stems(w: Column) -> Column:
    """Stems of a form in the ablative, longest ending first, with the ending's first letter."""
    fits = (F.length(w) >= 5) & ~w.rlike("m[ae]d[ae]n$")
    each = [F.when(fits & w.rlike(p) & (F.length(w) - n >= 2), F.struct(_cut(w, n).alias("x"), F.substring(w, F.length(w) - n + 1, F.lit(1)).alias("t"))) for p, n in zip(C.ABLATIVES, _endings(), strict=True)]
    return F.array_compact(F.array(*each))


def dir_stem(w: Column) -> Column:
    return F.nullif(F.regexp_extract(w, "^(.+?)([dt][ıiuü]r)$", 1), F.lit(""))


def flags(dictionary: DataFrame) -> DataFrame:
    """(s, is_word, verb, noun): whether s is a word, a verb without its ending, a word that is no verb."""
    words = dictionary.select("word").filter("word IS NOT NULL").distinct()
    verb, yes, no = F.col("word").rlike("m[ae]k$"), F.lit(True), F.lit(False)
    both = words.select(F.col("word").alias("s"), yes.alias("is_word"), no.alias("verb"), (~verb).alias("noun"))
    both = both.unionByName(words.filter(verb).select(_cut(F.col("word"), 3).alias("s"), no.alias("is_word"), yes.alias("verb"), no.alias("noun")))
    return both.groupBy("s").agg(*(F.bool_or(c).alias(c) for c in ("is_word", "verb", "noun")))


_VERB_ENDS = "mak mek lamak lemek etmek olmak".split()


def word_tests(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, participle, ablative, nominal_dir, ambiguous, adjective_base) of each distinct word. ambiguous is about the word
    as a base before -lar. Null words give no rows."""
    w, own = F.col("_w"), F.col("word")
    rows = words.select("word").filter(own.isNotNull()).distinct().withColumn("_w", lower(own))
    rows = rows.withColumns({"_part": participle_stems(w), "_abl": ablative_stems(w), "_dir": dir_stem(w)})
    short = lambda x: F.when(x.rlike("(ma|me)$") & (F.length(x) > 3), _cut(x, 2))
    stems = F.flatten(F.transform("_abl", lambda a: F.array(a["x"], F.concat(a["x"], F.lit("t")), short(a["x"]))))
    asked = F.concat(F.col("_part"), F.transform("_part", hardened), stems, F.array(F.col("_dir"), short(own), *(F.concat(own, F.lit(e)) for e in _VERB_ENDS)))
    each = rows.select("word", F.explode(F.array_distinct(F.array_compact(asked))).alias("s")).join(flags(dictionary), "s")
    known = each.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("is_word", "verb", "noun")))).alias("_k"))
    rows = rows.join(known, "word", "left")
    said = lambda s, what: F.coalesce(F.col("_k")[s][what], F.lit(False))
    participle = F.exists("_part", lambda x: said(x, "verb") | said(hardened(x), "verb"))
    noun = F.get(F.filter("_abl", lambda a: said(a["x"], "noun")), F.lit(0))
    x = noun["x"]
    of_verb = said(x, "verb") | ((noun["t"] == "t") & said(F.concat(x, F.lit("t")), "verb")) | said(short(x), "verb")
    d = F.col("_dir")
    nominal = (d != "değil") & said(d, "noun") & ~said(d, "verb") & ~d.rlike(C.SHAPES["future"])
    infinitive = lambda e: said(F.concat(own, F.lit(e)), "is_word")
    ambiguous = infinitive(_VERB_ENDS[0])
    for e in _VERB_ENDS[1:]:
        ambiguous = ambiguous | infinitive(e)
    ambiguous = ambiguous | said(short(own), "verb") | own.rlike("[ıiuü]ş$") | own.isin("değil", "uçar", "eder")
    base = F.coalesce(*[F.nullif(F.regexp_extract(w, p, 1), F.lit("")) for p in C.ADJECTIVE_BASES])
    return rows.select("word", participle.alias("participle"), F.coalesce(noun.isNotNull() & ~of_verb, F.lit(False)).alias("ablative"), F.coalesce(nominal, F.lit(False)).alias("nominal_dir"), ambiguous.alias("ambiguous"), base.alias("adjective_base"))
