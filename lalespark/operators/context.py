"""Analyses chosen in the context of their sentence, as a fold along it.

Which candidate a word takes depends on the forms beside it, which a window gives, and on the candidate that the word before
took, which the fold hands on. All that rules ask of a candidate or a form is a bit of a number made once for each distinct word. Rules are those of sentences.py: each adds to the scores of a word's candidates, one
amount to those that end as a finite verb, one to the rest, in a fixed order, so that sums are equal to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..lineage import stored
from . import sentences as S
from . import tables
from .search import analyze, let, lower

#: What rules ask of a candidate, a bit each.
_BITS = {n: 1 << k for k, n in enumerate("final poss gen participle converb infinitive dative accusative el".split())}
#: What rules ask of a form.
_FORM_BITS = {n: 1 << k for k, n in enumerate("det adj conj num post question ele al göz place".split())}


def _has(parts: Column, labels) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, sorted(labels))))


def _packed(flags: dict[str, Column], bits: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, flag in flags.items():
        out = out + F.when(F.coalesce(flag, F.lit(False)), F.lit(bits[name])).otherwise(F.lit(0))
    return out.cast("int")


def _is(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit((_BITS | _FORM_BITS)[name])) != 0


def facts(candidates: Column) -> Column:
    """What the rules ask of each candidate (stem, suffixes (form, label)), as bits."""
    def one(c: Column) -> Column:
        return let(F.transform(c["suffixes"], lambda s: s["label"]), lambda labels: let(F.flatten(F.transform(labels, lambda x: F.split(x, "/"))), lambda parts: said(c, labels, parts)))

    def said(c: Column, labels: Column, parts: Column) -> Column:
        near = F.flatten(F.transform(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), lambda x: F.split(x, "/")))
        tail = F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))
        dative = F.array_contains(parts, "YÖNELME")
        flags = {
            "final": _has(near, tables.VERB_FINAL), "poss": _has(parts, S._POSS), "gen": F.contains(tail, F.lit("TAMLAYAN")), "participle": F.contains(tail, F.lit("SIFAT_FİİL")),
            "converb": _has(parts, S._CONVERBS), "infinitive": F.array_contains(parts, "İSİM_FİİL"), "dative": dative, "accusative": F.array_contains(parts, "BELIRTME"), "el": (c["stem"] == "el") & dative,
        }
        return _packed(flags, _BITS)

    return F.transform(candidates, one)


def form_facts(form: Column) -> Column:
    """What the rules ask of a form in lower case, as bits."""
    among = lambda words: form.isin(*sorted(words))
    flags = {
        "det": among(S._DET), "adj": among(S._ADJ), "conj": among(S._CONJ), "num": among(S._NUM), "post": among(S._POST), "question": among(("mi", "mı", "mu", "mü")),
        "ele": form == "ele", "al": F.startswith(form, F.lit("al")), "göz": form == "göz", "place": F.startswith(form, F.lit("önün")) | F.startswith(form, F.lit("ardı")),
    }
    return F.when(form.isNotNull(), _packed(flags, _FORM_BITS))


def _rules(left: Column, before: Column, cur: Column, after: Column, first: Column, last: Column):
    """(name, whether it applies, what it adds to a candidate) of each rule, in order; all but first and last are bits."""
    amounts = lambda final, rest: lambda c: F.when(_is(c, "final"), F.lit(float(final))).otherwise(F.lit(float(rest)))
    those = lambda test, n: lambda c: F.when(test(c), F.lit(float(n))).otherwise(F.lit(0.0))
    had = lambda name: _is(left, name)
    det, adj = _is(before, "det"), _is(before, "adj")
    return [
        ("BELİRLEYİCİ→İSİM", det, amounts(-4, 3)),
        ("SIFAT→İSİM", ~det & adj, amounts(0, 0.5)),
        ("SIFATSAL→İSİM", ~det & ~adj & had("participle"), amounts(0, 0.3)),
        ("ARDIŞIK_FİİL↓", had("final") & ~_is(before, "conj"), amounts(-3, 0)),
        ("TAMLAYAN→İYELİK", had("gen"), those(lambda c: _is(c, "poss"), 3)),
        ("X→EDAT:İSİM", _is(after, "post"), amounts(-1.5, 2)),
        ("X→SORU:FİİL", _is(after, "question"), amounts(2, 0)),
        ("SAYI→İSİM", _is(before, "num"), amounts(-1.5, 2)),
        ("ZARF_FİİL→FİİL", had("converb"), amounts(2, 0)),
        ("İSİM_FİİL→İSİM", had("infinitive"), amounts(0, 1.5)),
        ("YÖNELME→FİİL", had("dative"), amounts(1, 0)),
        ("DEYİM:ele_al", _is(cur, "ele") & _is(after, "al"), those(lambda c: _is(c, "el"), 3)),
        ("DEYİM:göz_kalıp", _is(cur, "göz") & _is(after, "place"), amounts(0, 2)),
        ("BELİRTME→FİİL", had("accusative"), amounts(1.5, 0)),
        ("İYELİK_ZİNCİR", had("poss"), those(lambda c: _is(c, "poss") | _is(c, "gen"), 1)),
        ("CÜMLE_SONU→FİİL", last, amounts(1, 0)),
        ("CÜMLE_BAŞI→İSİM", first, amounts(0, 0.5)),
    ]


#: The rules' names, in order; which of them applied is a bit each until the result.
_NAMES = "BELİRLEYİCİ→İSİM SIFAT→İSİM SIFATSAL→İSİM ARDIŞIK_FİİL↓ TAMLAYAN→İYELİK X→EDAT:İSİM X→SORU:FİİL SAYI→İSİM ZARF_FİİL→FİİL İSİM_FİİL→İSİM YÖNELME→FİİL DEYİM:ele_al DEYİM:göz_kalıp BELİRTME→FİİL İYELİK_ZİNCİR CÜMLE_SONU→FİİL CÜMLE_BAŞI→İSİM".split()
#: A choice and the bits of its rules are one number: choice times this, and bits.
_ROOM = 1 << len(_NAMES)


def _choice(own: Column, *context: Column) -> Column:
    """The choice among own and the rules that applied, as one number."""
    rules = _rules(*context)

    def scored(on: Column) -> Column:
        def low(c: Column, j: Column) -> Column:
            total = F.lit(0.0) - j
            for k, (_, _, adds) in enumerate(rules):
                total = total + F.when(F.getbit(on, F.lit(k)) == 1, adds(c)).otherwise(F.lit(0.0))
            return F.struct((F.lit(0.0) - total).alias("low"), j.alias("j"))

        return F.array_min(F.transform(own, low))["j"].cast("long") * _ROOM + on

    on = _packed({n: on for n, on, _ in rules}, {n: 1 << k for k, n in enumerate(_NAMES)})
    return F.when(F.size(own) < 2, F.lit(0).cast("long")).otherwise(let(on, scored))


def _facts(candidates: Column) -> Column:
    none = F.raise_error(F.lit("a token has no candidates"))
    return facts(F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, candidates).otherwise(none))


def _chosen(rows: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    """(sent_id, id, what is kept, chosen, applied) for tokens (sent_id, id, bits, own). Candidates and forms come as bits, so no
    analysis is shuffled. A sentence is gathered to one row for the fold."""
    w = Window.partitionBy("sent_id").orderBy(*order)
    near = rows.withColumns({"before": F.lag("bits").over(w), "after": F.lead("bits").over(w)})
    near = near.withColumns({"first": F.col("before").isNull(), "last": F.col("after").isNull()})
    whole = near.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("id", "own", "bits", "before", "after", "first", "last", *kept))).alias("t"))
    step = lambda acc, x: let(_choice(x["own"], acc["left"], x["before"], x["bits"], x["after"], x["first"], x["last"]), lambda c: F.struct(F.get(x["own"], (c / _ROOM).cast("int")).alias("left"), F.concat(acc["out"], F.array(c)).alias("out")))
    walked = F.aggregate("t", F.struct(F.lit(0).alias("left"), F.array().cast("array<bigint>").alias("out")), step)["out"]
    said = lambda x, c: F.struct(x["id"].alias("id"), *[x[n].alias(n) for n in kept], ((c / _ROOM).cast("int") + 1).alias("chosen"), (c % _ROOM).cast("int").alias("applied"))
    out = whole.select("sent_id", F.inline(F.zip_with("t", walked, said)))
    return out.withColumn("applied", F.filter(F.array(*map(F.lit, _NAMES)), lambda x, k: F.getbit(F.col("applied"), k) == 1))


def rerank(rows: DataFrame) -> DataFrame:
    """(sent_id, id, chosen, applied): which of its candidates each token takes in context, from 1, and the rules that applied.

    rows: sent_id, id from 1 in each sentence, form, and candidates, an array of (stem, suffixes (form, label)) in their
    order. A token without candidates is an error. A sentence is gathered to one row for the fold.
    """
    cur = lower(F.col("form"))
    own = rows.select("sent_id", "id", cur.alias("cur"), form_facts(cur).alias("bits"), _facts(F.col("candidates")).alias("own"))
    return _chosen(own, ["id", "cur"], []).select("sent_id", "id", "chosen", "applied")


def read(sents: DataFrame, dictionary: DataFrame | None = None, most: int = 5, also: dict[str, Column] | None = None) -> DataFrame:
    """(sent_id, id, form, stem, root, lemma, suffixes, applied, alternatives) of each word of sentences (sent_id, text).

    Each distinct word is analysed once, twice as deep as `most`. Words of sentences meet what the rules ask of their
    candidates, and then the analysis that was chosen. also: more columns, made from the columns of an analysis, once for each
    analysis of a distinct word. Null text has no words.
    """
    also = also or {}
    rows = sents.select(F.col("sent_id").cast("string").alias("sent_id"), F.posexplode(tokens(F.col("text"))).alias("_k", "form"))
    rows = rows.select("sent_id", (F.col("_k") + 1).alias("id"), "form")
    found = analyze(rows.select(F.col("form").alias("word")), dictionary, 2 * most).withColumns(also)
    found = stored(found.select(F.col("word").alias("form"), F.col("rank").alias("chosen"), "stem", "root", "lemma", "suffixes", *also))
    per_word = found.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("chosen", "stem", "suffixes"))).alias("candidates"))
    coded = per_word.select("form", form_facts(lower(F.col("form"))).alias("bits"), _facts(F.col("candidates")).alias("own"))
    chosen = _chosen(rows.join(coded, "form").withColumn("others", F.least(F.size("own"), F.lit(most)) - 1), ["id"], ["form", "others"])
    out = chosen.join(found, ["form", "chosen"])
    return out.select("sent_id", "id", "form", "stem", "root", "lemma", "suffixes", "applied", F.col("others").alias("alternatives"), *also)
