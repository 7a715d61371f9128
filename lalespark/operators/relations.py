"""Rules of the parser as windows over the words of a sentence.

All rules here read a word's neighbours, the first word ahead that is wanted with none between that stops the search, the
nearest predicate, runs of words, or the sentence's root; so each is a few window aggregates over one partitioning by sentence,
without gathering sentences or running Python. A rule takes tokens (sent_id, id, form, lemma, suffixes, upos, head, deprel,
comma, and what else they hold) and gives them back with upos, head and deprel changed, so rules can follow each other: the
partitioning stays. Nulls in form or lemma count as empty, in upos and deprel as no value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import syntax as S
from . import wordclasses as C
from .search import let, lower

RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def _at():
    return Window.partitionBy("sent_id").orderBy("id")


def _all():
    return Window.partitionBy("sent_id")


def _past():
    return _at().rowsBetween(Window.unboundedPreceding, -1)


def _back():
    """From a sentence's end: what stands ahead is then a running aggregate. A frame up to the end of an ascending order is
    made anew for each word."""
    return Window.partitionBy("sent_id").orderBy(F.desc("id"))


def _ahead_of(far: int | None = None):
    return _back().rowsBetween(-far if far else Window.unboundedPreceding, -1)


def _next(c) -> Column:
    return F.lag(c).over(_back())


def _in(c: Column, values) -> Column:
    return F.coalesce(c.isin(*sorted(values)), F.lit(False))


def _has(labels) -> Column:
    return F.arrays_overlap("_labels", F.array(*map(F.lit, sorted(labels))))


def _label(name: str) -> Column:
    return F.array_contains("_labels", name)


def prepared(tokens: DataFrame) -> DataFrame:
    """Tokens with what rules ask of a word by itself; the columns begin with an underscore."""
    form = F.coalesce("form", F.lit(""))
    path = F.coalesce(F.transform("suffixes", lambda s: s["label"]), F.array().cast("array<string>"))
    out = tokens.withColumns({"_low": lower(form), "_plain": F.lower(form), "_stem": lower(F.coalesce("lemma", F.lit(""))), "_path": path, "_size": F.size(F.coalesce("suffixes", F.array().cast(tokens.schema["suffixes"].dataType))), "_labels": F.flatten(F.transform(path, lambda x: F.split(x, "/")))})
    free = F.coalesce("deprel", F.lit("_")).isin("_", "dep")
    nominal = _in(F.col("upos"), S.NOMINAL)
    predicative = _in(F.col("deprel"), ("root", "advcl", "acl", "ccomp")) | (_in(F.col("deprel"), ("conj",)) & _in(F.col("upos"), ("VERB",)))
    return out.withColumns({"_free": free, "_noun": nominal, "_nominal": nominal | (_in(F.col("upos"), ("VERB",)) & _label("BİLDİRME")), "_owned": _has(S.POSSESSIVES), "_pred": predicative})


def ahead(wanted: Column, through: Column, far: int | None = None, value: Column | None = None) -> Column:
    """The id (or value) of the first word after this one that is wanted, if all between may be passed through."""
    w = _ahead_of(far)
    at = F.struct(F.col("id").alias("id"), (F.col("id") if value is None else value).alias("v"))
    hit, stop = F.min(F.when(wanted, at)).over(w), F.min(F.when(~wanted & ~through, F.col("id"))).over(w)
    return F.when(hit["id"] < F.coalesce(stop, hit["id"] + 1), hit["v"])


def _rule(rule: Callable[[], tuple]):
    """Registers rule(): (whether a word changes, head, deprel, upos or None); columns of other words are windows."""

    def apply(tokens: DataFrame) -> DataFrame:
        on, head, rel, upos = rule()
        rows = prepared(tokens)
        # Windows are made first; a changed column mustn't be read by the others.
        rows = rows.withColumns({"_root": F.min(F.when(F.col("deprel") == "root", F.col("id"))).over(_all())})
        rows = rows.withColumns({"_on": F.coalesce(on, F.lit(False)), "_head": head, "_rel": rel, "_upos": F.col("upos") if upos is None else upos})
        changed = {c: F.when(F.col("_on"), F.coalesce(f"_{n}", c)).otherwise(F.col(c)) for c, n in (("head", "head"), ("deprel", "rel"), ("upos", "upos"))}
        changed["head"] = changed["head"].cast("int")
        return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in tokens.columns))

    RULES[rule.__name__] = apply
    return apply


def _rest() -> Column:
    """Free words but the root, where there is one."""
    return F.col("_free") & F.col("_root").isNotNull() & (F.col("id") != F.col("_root"))


def _predicate(value: str = "id") -> Column:
    """The nearest predicate to the right, or the root; or a column of it."""
    at = F.struct(F.col("id").alias("at"), F.col(value).alias("v"))
    after = F.min(F.when(F.col("_pred"), at)).over(_ahead_of())
    root = F.min(F.when(F.col("deprel") == "root", at)).over(_all())
    return F.coalesce(after, root)["v"]


@_rule
def predicate():
    final = _has(S.FINAL) | (_in(F.col("upos"), ("VERB",)) & _in(F.col("_low"), S._W["SPEECH"]))
    return F.col("id") == F.max(F.when(final, F.col("id"))).over(_all()), F.lit(0), F.lit("root"), None


@_rule
def nominal_predicate():
    return F.col("_root").isNull() & (F.col("id") == F.max("id").over(_all())), F.lit(0), F.lit("root"), None


@_rule
def postposition():
    ile = F.col("_low") == "ile"
    return F.col("_free") & (F.lag("id").over(_at()).isNotNull()) & (ile | _in(F.col("_low"), S._W["CASE_POSTPOSITIONS"])), F.lag("id").over(_at()), F.lit("case"), F.when(~ile, F.lit("ADP"))


@_rule
def possessive():
    skip = _in(F.col("upos"), "ADJ DET NUM NOUN PROPN ADV CCONJ PART PRON ADP".split())
    rel = F.when(_in(F.col("upos"), ("VERB",)), "nsubj").otherwise("nmod:poss")
    on = F.col("_free") & (_label("TAMLAYAN") | _in(F.col("_plain"), S._W["GENITIVE_PRONOUNS"]))
    head = ahead(F.col("_owned"), skip, 12)
    return on & head.isNotNull(), head, ahead(F.col("_owned"), skip, 12, rel), None


@_rule
def determiner():
    head = ahead(F.col("_nominal"), _in(F.col("upos"), S.MODIFIERS))
    return F.col("_free") & _in(F.col("upos"), ("DET",)) & head.isNotNull(), head, F.lit("det"), None


def numeral(tokens: DataFrame) -> DataFrame:
    """A numeral goes to the noun ahead, or to the numeral before it, whose chain a running last value follows."""
    rows = prepared(tokens)
    form, before = F.col("_plain"), F.lag
    counted = ~(form.rlike(S._S["ordinal"].pattern) | form.rlike(S._S["distributive"].pattern))
    mine = F.col("_free") & (_in(F.col("_low"), S._W["NUMERALS"]) | F.coalesce(F.col("form").rlike(r"^[0-9]+$"), F.lit(False)))
    rows = rows.withColumns({"_mine": mine, "_counted": counted, "_noun_at": ahead(F.col("_noun"), _in(F.col("upos"), ("ADJ", "NUM")))})
    was = _in(F.col("deprel"), ("nummod", "flat")) & _in(F.col("upos"), ("NUM",))
    # Whether a word leaves a numeral behind that the next may join; unknown where that hangs on the word before.
    leaves = F.when(~F.col("_mine"), was).when(~F.col("_counted"), F.lit(False)).when(F.col("_noun_at").isNotNull(), F.lit(True))
    rows = rows.withColumn("_leaves", leaves)
    rows = rows.withColumn("_flat", F.col("_mine") & F.col("_counted") & F.coalesce(F.last("_leaves", ignorenulls=True).over(_past()), F.lit(False)))
    start = F.when(~F.col("_flat"), F.when(~F.col("_mine") & (F.col("deprel") == "flat"), F.col("head")).otherwise(F.col("id")))
    rows = rows.withColumn("_first", start).withColumn("_chain", F.last("_first", ignorenulls=True).over(_past()))
    alone = F.col("_mine") & ~F.col("_flat") & F.col("_noun_at").isNotNull()
    on = F.col("_flat") | alone
    changed = {
        "head": F.when(F.col("_flat"), F.col("_chain")).when(alone, F.col("_noun_at")).otherwise(F.col("head")).cast("int"),
        "deprel": F.when(F.col("_flat"), "flat").when(alone, F.when(F.col("_counted"), "nummod").otherwise("amod")).otherwise(F.col("deprel")),
        "upos": F.when(on, "NUM").otherwise(F.col("upos")),
    }
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in tokens.columns))


RULES["numeral"] = numeral


def flat_name(tokens: DataFrame) -> DataFrame:
    """Runs of capitalised bare nouns, by the difference of two row numbers; all of a run but the first go to the first."""
    rows = prepared(tokens)
    name = F.coalesce(F.col("form").rlike(r"^\p{IsUppercase}"), F.lit(False)) & F.col("_free") & F.col("_noun") & (F.size("_path") == 0)
    rows = rows.withColumn("_name", name)
    rows = rows.withColumn("_run", F.row_number().over(_at()) - F.row_number().over(Window.partitionBy("sent_id", "_name").orderBy("id")))
    run = Window.partitionBy("sent_id", "_name", "_run")
    rows = rows.withColumns({"_first": F.min("id").over(run), "_size": F.count(F.lit(1)).over(run)})
    on = F.col("_name") & (F.col("_size") > 1)
    joined = on & (F.col("id") > F.col("_first"))
    changed = {"head": F.when(joined, F.col("_first")).otherwise(F.col("head")).cast("int"), "deprel": F.when(joined, "flat").otherwise(F.col("deprel")), "upos": F.when(on, "PROPN").otherwise(F.col("upos"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in tokens.columns))


RULES["flat_name"] = flat_name


@_rule
def reduplication():
    before = lambda c: F.lag(c).over(_at())
    key = F.when(F.col("_stem") != "", F.col("_stem")).otherwise(F.col("_low"))
    pair = F.concat_ws("-", F.lag(key).over(_at()), key)
    twice = (before("_low") == F.col("_low")) | ((F.lag(key).over(_at()) == key) & (F.length(key) >= 2)) | _in(pair, C.words(C.PAIRS))
    return F.col("_free") & before("id").isNotNull() & twice, before("id"), F.lit("compound:redup"), None


@_rule
def compound_noun():
    after = lambda c: F.lead(c).over(_at())
    taken = F.collect_set(F.when(F.col("deprel") == "nmod:poss", F.col("head"))).over(_all())
    on = F.col("_free") & F.col("_noun") & ~_has(C.CASE) & ~_label("TAMLAYAN") & F.coalesce(after("_noun") & after("_owned"), F.lit(False))
    return on & ~F.array_contains(taken, after("id").cast("int")), after("id"), F.lit("nmod:poss"), None


@_rule
def converb():
    clause = _in(F.col("upos"), ("VERB",)) & (_label("DİLEK_ŞART") | (_has(S.PARTICIPLES) & _has(("BULUNMA", "AYRILMA"))))
    return _rest() & (_has(S.CONVERBS) | F.col("_plain").rlike(C.SHAPES["converb"]) | clause), F.col("_root"), F.lit("advcl"), None


@_rule
def infinitive():
    rel = F.when(_predicate("_plain").rlike(C.SHAPES["wanting"]), "xcomp").otherwise("csubj")
    return _rest() & _in(F.col("upos"), ("VERB",)) & _label("MASTAR"), _predicate(), rel, None


@_rule
def temporal():
    return _rest() & _in(F.col("_low"), S._W["TIMES"]) & (F.col("_size") == 0), _predicate(), F.lit("obl"), None


@_rule
def emphasis():
    return F.col("_free") & F.lag("id").over(_at()).isNotNull() & _in(F.col("_low"), S._W["EMPHASIS"]), F.lag("id").over(_at()), F.lit("advmod:emph"), None


@_rule
def adjective_or_adverb():
    """To the first word ahead that is no determiner, numeral or adjective, if that is a noun or a verb."""
    wanted = ~_in(F.col("upos"), ("DET", "NUM", "ADJ"))
    kind = ahead(wanted, F.lit(True), value=F.col("upos"))
    plain = F.forall("_path", lambda x: F.startswith(x, F.lit("YAPIM_")))
    return F.col("_free") & _in(F.col("upos"), ("ADJ",)) & plain & _in(kind, ("NOUN", "PROPN", "VERB")), ahead(wanted, F.lit(True)), F.lit("amod"), None


@_rule
def adverb():
    right = F.when(_in(_next("upos"), ("ADJ", "ADV")), _next("id"))
    return _rest() & _in(F.col("upos"), ("ADV",)), F.coalesce(right, _predicate()), F.lit("advmod"), None


def adjective(tokens: DataFrame) -> DataFrame:
    rows = prepared(tokens)
    conj = _in(F.col("upos"), ("CCONJ",))
    rows = rows.withColumn("_joins", conj & _in(_next("upos"), ("ADJ", "ADV")))
    any_noun = ahead(F.col("_noun"), _in(F.col("upos"), S.MODIFIERS) | F.col("_joins"))
    inflected = ahead(F.col("_nominal") & ((F.col("_size") > 0) | _in(F.col("upos"), ("VERB",))), F.when(conj, F.col("_joins")).otherwise(~_in(F.col("upos"), ("VERB", "ADP"))))
    adj, located = _in(F.col("upos"), ("ADJ",)), _in(F.col("upos"), ("NOUN",)) & F.col("_plain").rlike(C.SHAPES["located"])
    rows = rows.withColumn("_to", F.when(F.col("_free"), F.when(located, any_noun).when(adj, F.coalesce(inflected, any_noun))))
    on = F.col("_to").isNotNull()
    changed = {"head": F.coalesce("_to", "head").cast("int"), "deprel": F.when(on, "amod").otherwise(F.col("deprel"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in tokens.columns))


RULES["adjective"] = adjective


@_rule
def more_predicates():
    return _rest() & _in(F.col("upos"), ("VERB",)) & _has(C.TENSE) & ~_has(S.CONVERBS | S.PARTICIPLES), F.col("_root"), F.lit("conj"), None


@_rule
def one_object():
    """Only the object nearest to each head stays one."""
    near = Window.partitionBy("sent_id", "head", F.col("deprel") == "obj").orderBy(F.abs(F.col("id") - F.col("head")), "id")
    return (F.col("deprel") == "obj") & (F.row_number().over(near) > 1), F.col("head"), F.when(F.col("_owned"), "nmod:poss").otherwise("obl"), None


@_rule
def first_root():
    """The first coordinated verb before a comma becomes the root; the old root and its conjuncts go to it."""
    root = F.col("_root")
    of_root = _in(F.col("deprel"), ("conj",)) & (F.col("head") == root)
    new = F.min(F.when(of_root & (F.col("id") < root) & _in(F.col("upos"), ("VERB",)) & F.coalesce("comma", F.lit(False)), F.col("id"))).over(_all())
    mine, old = F.col("id") == new, F.col("id") == root
    return new.isNotNull() & (mine | old | of_root), F.when(mine, 0).otherwise(new), F.when(mine, "root").when(old, "conj").otherwise(F.col("deprel")), None


def apply(tokens: DataFrame, rules: list[str]) -> DataFrame:
    """tokens after the named rules, one after the other."""
    return reduce(lambda rows, name: RULES[name](rows), rules, tokens)


def features(suffixes: Column) -> Column:
    """A map of features; of several labels of a kind the last one counts."""
    labels = F.flatten(F.transform(suffixes, lambda s: F.when(F.contains(s["label"], F.lit("/")), F.split(s["label"], "/")).otherwise(F.array(s["label"]))))
    numbers = {k: v[1] for k, v in C.PERSON.items()} | {"ÇOĞUL": "Plur"}
    kinds = [
        ("Case", C.CASE), ("Number", numbers), ("Person", {k: v[0] for k, v in C.PERSON.items()}), ("Tense", C.TENSE),
        ("Polarity", {"OLUMSUZLUK": "Neg"}), ("VerbForm", dict.fromkeys(S.PARTICIPLES, "Part") | dict.fromkeys(S.CONVERBS, "Conv")),
    ]

    # What each label gives, as one map; a fold along the labels keeps the last value of each kind.
    names = [name for name, _ in kinds]
    value = lambda label: F.struct(*[F.lit(kind.get(label)).cast("string").alias(name) for name, kind in kinds])
    known = sorted({x for _, kind in kinds for x in kind})
    gives = F.create_map(*[x for label in known for x in (F.lit(label), value(label))])
    step = lambda acc, x: let(gives[x], lambda v: F.struct(*[F.coalesce(v[n], acc[n]).alias(n) for n in names]))
    pairs = lambda found: F.array_compact(F.array(*[F.when(found[n].isNotNull(), F.struct(F.lit(n).alias("key"), found[n].alias("value"))) for n in names]))
    # Most words have no suffix.
    made = F.aggregate(labels, value(None), step, lambda found: F.map_from_entries(pairs(found)))
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return F.when(F.coalesce(F.size(suffixes), F.lit(0)) > 0, made).otherwise(none)
