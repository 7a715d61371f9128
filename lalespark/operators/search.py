"""Word analysis as a relation: suffix stripping as a bounded breadth-first search without Python.

What a search can reach from a word is known before it: ends of the word cut off, at most DEPTH times, and such strings with
their last vowel wide again. So all strings of all words are looked up once, in one join with the dictionary, and the
suffixes that each may lose are one equi-join with the table of forms. A word then carries the edges of its strings as a map,
and the search is a fold over levels: the frontier is an array in queue order, automaton states are a bit mask, the caps on
the queue and on what is found are running sums along the frontier. Ranking, label reading and roots are folds too.

Nothing here depends on the dictionary's size. A word carries at most DEPTH * (longest form + 1) strings, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import harmony as H
from ..functions.phonology import CLOSE, CONSONANTS, VOWELS, first_vowel, is_valid_stem, last_vowel
from ..lineage import cut
from . import analyzer as A
from . import suffixes, tables
from .lexicon import WIDENED, root_lookup
from .matching import LEAST_KNOWN

_PATH = "array<struct<form:string,label:string>>"
_STATE = f"array<struct<cur:string,path:{_PATH},states:int>>"
_FOUND = f"array<struct<stem:string,path:{_PATH}>>"
_VERBS = tables.inverted(tables.VERB_STEMS)


def let(value: Column, body) -> Column:
    """body(value), which is computed once: a lambda's variable is, an expression that is named twice isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower(text: Column) -> Column:
    """Each character in lower case by itself, so a final sigma is like any other."""
    return F.lower(F.translate(text, "İIΣ", "iıσ"))


def _any(label: Column, labels) -> Column:
    return F.coalesce(label.isin(*sorted(labels)), F.lit(False))


def _minus(s: Column, k: int = 1) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - k)


def _last(s: Column) -> Column:
    return F.right(s, F.lit(1))


def strings(word: Column, longest: int) -> Column:
    """All strings that a search from the word can reach, and a few more."""
    n = F.length(word)
    least = F.greatest(F.lit(1), n - A.DEPTH * (longest + 1))
    cut = F.when(n > 0, F.transform(F.sequence(least, F.greatest(n, F.lit(1))), lambda i: F.substring(word, F.lit(1), i))).otherwise(F.array(word))
    letters = sorted({v for vs in A._WIDER.values() for v in vs})
    wide = lambda p: F.transform(F.filter(F.array(*map(F.lit, letters)), lambda v: F.instr(F.element_at(_wider(), _last(p)), v) > 0), lambda v: F.concat(_minus(p), v))
    narrow = F.filter(cut, lambda p: (F.length(p) > 1) & _last(p).isin(*A._WIDER))
    return F.array_distinct(F.concat(cut, F.flatten(F.transform(narrow, wide))))


def _wider() -> Column:
    return F.create_map(*[F.lit(x) for p in A._WIDER.items() for x in p])


def facts(dictionary: DataFrame, derived: bool) -> DataFrame:
    """(surface, root, in_dict, is_verb) of root_lookup, and of each root: r_in, r_verb, r_inf (its infinitive), and with
    `derived` r_bare, the verb that it comes from."""
    lookup = root_lookup(dictionary)
    own = lookup.select(F.col("surface").alias("root"), F.col("in_dict").alias("r_in"), F.col("is_verb").alias("r_verb"))
    verbs = dictionary.filter(F.col("word").rlike("m[ae]k$") & (F.length("word") > 3))
    infinitive = verbs.groupBy(_minus(F.col("word"), 3).alias("root")).agg(F.min("word").alias("r_inf"))  # -mak comes before -mek
    out = lookup.join(own, "root", "left").join(infinitive, "root", "left")
    bare = _underived(out) if derived else None
    return out.withColumn("r_bare", F.lit(None).cast("string")) if bare is None else out.join(bare, "root", "left")


def _underived(known: DataFrame) -> DataFrame:
    """(root, r_bare): the verb that a derived verb comes from, through up to five endings."""
    verbs = known.filter("r_verb").select("root").distinct()
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(tables.VERB_ENDINGS)])
    cut = verbs.filter(~F.col("root").isin(*sorted(tables.OWN_VERBS))).select("root", F.inline(ends))
    cut = cut.filter(F.col("root").endswith(F.col("e")) & (F.length("root") - F.length("e") >= 2) & ~(F.col("e").endswith("ş") & F.col("root").isin(*sorted(tables.OWN_RECIPROCALS))))
    cut = cut.select("root", "k", F.expr("left(root, length(root) - length(e))").alias("surface"))
    step = cut.join(known.filter("r_verb").select("surface", F.col("root").alias("next")), "surface").groupBy("root").agg(F.min_by("next", "k").alias("next"))
    out = verbs.withColumn("cur", F.col("root"))
    for _ in range(5):
        out = out.join(step.select(F.col("root").alias("cur"), "next"), "cur", "left").select("root", F.coalesce("next", "cur").alias("cur"))
    return out.filter("cur <> root").select("root", F.col("cur").alias("r_bare"))


def _forms(spark, forms) -> DataFrame:
    """(form, label, least, exempt)"""
    by_form = {f: (f, label, least, exempt) for f, label, least, exempt in (suffixes.forms() if forms is None else forms)}
    return spark.createDataFrame(list(by_form.values()), "form string, label string, least int, exempt boolean")


def _bans() -> Column:
    """For each label those that never stand outside of it."""
    out: dict[str, list[str]] = {}
    for inner, outer in tables.FORBIDDEN:
        out.setdefault(inner, []).append(outer)
    return F.create_map(*[x for inner, outers in out.items() for x in (F.lit(inner), F.array(*map(F.lit, outers)))])


def _steps() -> Column:
    """For each label the automaton's moves: the states (bits) from which it may be stripped, and the one after."""
    pair = lambda s: F.struct(F.lit(suffixes.FROM[s]).alias("at"), F.lit(suffixes.BIT[s]).alias("bit"))
    return F.create_map(*[x for label, slots in suffixes.SLOTS_OF.items() for x in (F.lit(label), F.array(*map(pair, slots)))])


def looked_up(xs: DataFrame, known: DataFrame) -> DataFrame:
    """Strings x with what the dictionary says of them, and of the verb whose irregular stem they are."""
    spark = xs.sparkSession
    verbs = spark.createDataFrame(sorted(_VERBS.items()), "x string, base string")
    names = ["root", "in_dict", "is_verb", "r_in", "r_verb", "r_inf", "r_bare"]
    base = known.filter(F.col("surface").isin(*sorted(set(_VERBS.values())))).select(F.col("surface").alias("base"), F.col("in_dict").alias("b_in"), F.col("is_verb").alias("b_verb"), F.when(F.col("is_verb"), F.col("r_inf")).alias("b_inf"), F.when(F.col("is_verb"), F.col("r_bare")).alias("b_bare"))
    verbs = verbs.join(base, "base", "left")  # a few rows
    out = xs.join(known.select(F.col("surface").alias("_s"), *names), F.lower("x") == F.col("_s"), "left").drop("_s")
    return out.join(F.broadcast(verbs), "x", "left")


def _slim(tried: Column) -> Column:
    return F.transform(tried, lambda t: F.struct(t["gate"].alias("gate"), t["e"].alias("e")))


def _first(tried: DataFrame) -> DataFrame:
    """(x, first, rest), where all that is tried comes first."""
    return tried.select("x", _slim(F.col("tried")).alias("first"), _slim(F.slice("tried", 1, 0)).alias("rest"))


def _tried(hit: DataFrame, strategies, longest: int) -> DataFrame:
    """(x, tried): the edges of each string that has some, in the order tried."""
    s, f = F.col("stem"), F.col("form")
    before, last = _minus(s), _last(s)
    wide = F.when(F.col("_narrowed") & ~F.col("b_verb"), F.transform(F.split(F.element_at(_wider(), last), ""), lambda v: F.concat(before, v))).otherwise(F.array().cast("array<string>"))
    no_n = F.when(F.col("label").isin("BULUNMA", "AYRILMA") & (F.length(s) > 2) & (last == "n"), F.array(before)).otherwise(F.array().cast("array<string>"))
    main = F.struct(f.alias("form"), F.col("label").alias("label"), F.concat(F.array(s), no_n, wide).alias("variants"))
    n_stem = F.concat(s, F.lit("n"))
    n_cut = F.when(F.col("n_form.label").isin("BULUNMA", "AYRILMA") & (F.length(n_stem) > 2), F.array(s)).otherwise(F.array().cast("array<string>"))
    other = F.struct(F.expr("substring(form, 2)").alias("form"), F.col("n_form.label").alias("label"), F.concat(F.array(n_stem), n_cut).alias("variants"))
    rows = []
    for w, way in enumerate(strategies):
        least = F.lit(LEAST_KNOWN) if way.in_dictionary else F.greatest("least", F.lit(way.least_stem or 0))
        fits = (F.length(s) >= least) & (F.col("strict") if way.strict else F.lit(True))
        fits = fits & F.col("s_root") if way.in_dictionary else fits
        place = lambda last: F.lit(w * 1000) + (F.lit(longest) - F.col("k")) * 2 + last  # noqa: E731, B023
        edge = lambda order, e, is_in, verb, odd: F.struct(order.cast("int").alias("place"), F.lit(way.in_dictionary).alias("known"), is_in.alias("s_in"), (verb | odd).alias("s_verbal"), odd.alias("s_odd"), F.col("label").alias("gate"), e.alias("e"))  # noqa: E731, B023
        rows.append(F.when(fits & F.coalesce("n_in", F.lit(False)) & F.col("n_form").isNotNull(), edge(place(0), other, F.lit(True), F.coalesce("n_verb", F.lit(False)), F.coalesce("n_odd", F.lit(False)))))
        rows.append(F.when(fits, edge(place(1), main, F.col("s_in"), F.col("s_verb"), F.col("s_odd"))))
    return hit.select("x", F.explode(F.array_compact(F.array(*rows))).alias("t")).groupBy("x").agg(F.sort_array(F.collect_list("t")).alias("tried"))


def edges(xs: DataFrame, info: DataFrame | None, forms: DataFrame, strategies, longest: int, lexicon: bool) -> DataFrame:
    """(x, first, rest): the suffixes that each string may lose, in the order tried, and those to take if none of the first is open."""
    ends = xs.select("x", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("x") - 1))).alias("k")).filter("k > 0 AND k < length(x)")
    ends = ends.select("x", "k", F.expr("left(x, length(x) - k)").alias("stem"), F.expr("right(x, k)").alias("form"))
    s, f = F.col("stem"), F.col("form")
    a, b = last_vowel(s), first_vowel(f)
    hit = ends.join(F.broadcast(forms), "form").filter(is_valid_stem(s) & H.consonant_harmony(s, f))
    hit = hit.withColumns({"soft": F.col("exempt") | H.minor(a, b), "strict": F.col("exempt") | (H.minor(a, b) & H.major(a, b))}).filter("soft")
    with_n = F.lit(lexicon) & (F.col("k") > 1) & F.startswith(f, F.lit("n")) & F.col("label").isin(*sorted(tables.BUFFERED_BY_N))
    before, last = _minus(s), _last(s)
    narrowed = (F.col("label") == "ŞİMDİKİ_ZAMAN") & (F.length(s) >= 2) & last.isin(*A._WIDER)
    hit = hit.withColumns({"_narrowed": narrowed, "_n": F.when(with_n, F.concat(s, F.lit("n"))), "_f": F.when(with_n, F.expr("substring(form, 2)")), "_b": F.when(narrowed & (F.length(s) >= 3) & _last(before).rlike(f"[{CONSONANTS}]"), before)})
    if not lexicon:
        # Nothing is known of a string, and what is no string of the words is DEPTH suffixes away, where no edge is taken.
        no = {c: F.lit(False) for c in ("s_root", "s_in", "s_verb", "s_odd", "n_in", "n_verb", "n_odd", "b_verb")}
        return _first(_tried(hit.withColumns(no | {"n_form": F.lit(None).cast("struct<label:string>")}), strategies, longest))
    # The labels as they are in what gets an edge; of a string only the flags that edges need travel.
    flags = info.select(F.col("x").alias("stem"), F.col("root").isNotNull().alias("s_root"), F.coalesce("in_dict", F.lit(False)).alias("s_in"), F.coalesce("is_verb", F.lit(False)).alias("s_verb"), F.coalesce("b_verb", F.lit(False)).alias("s_odd"))
    hit = hit.join(flags, "stem")
    hit = hit.join(F.broadcast(forms.select(F.col("form").alias("_f"), F.struct("label").alias("n_form"))), "_f", "left").drop("_f")
    known = flags.filter("s_in OR s_verb").select("stem", "s_in", "s_verb", "s_odd")
    hit = hit.join(known.select(F.col("stem").alias("_n"), F.col("s_in").alias("n_in"), F.col("s_verb").alias("n_verb"), F.col("s_odd").alias("n_odd")), "_n", "left")
    hit = hit.join(known.filter("s_verb").select(F.col("stem").alias("_b"), F.lit(True).alias("b_verb")), "_b", "left")
    tried = _tried(hit.withColumn("b_verb", F.coalesce("b_verb", F.lit(False))), strategies, longest)
    all_ = info.join(tried, "x", "left").withColumn("tried", F.coalesce("tried", F.array().cast(dict(tried.dtypes)["tried"])))
    verbal = lambda t: _any(t["e"]["label"], tables.VERBAL)
    inside = F.coalesce("in_dict", F.lit(False)) | F.coalesce("is_verb", F.lit(False))
    first = F.when(F.col("root").isNull(), F.col("tried")).when(~inside, F.filter("tried", lambda t: t["known"])).otherwise(F.filter("tried", lambda t: t["known"] & (t["s_in"] | (verbal(t) & t["s_verbal"]))))
    rest = F.when(F.col("root").isNotNull() & inside, F.filter("tried", lambda t: ~t["known"] & verbal(t) & t["s_odd"])).otherwise(F.slice("tried", 1, 0))
    return all_.withColumns({"first": _slim(first), "rest": _slim(rest)}).drop("tried")


def paths(nodes: Column, word: Column, most: int, lexicon: bool) -> Column:
    """(stem, path) in the order found. nodes: a map from each string to its node."""
    none, bans, moves = F.array().cast(_STATE), _bans(), _steps()

    def opened(node: Column, outer: Column) -> Column:
        free = lambda arr: F.array_distinct(F.transform(F.filter(arr, lambda e: ~F.coalesce(F.array_contains(bans[e["gate"]], outer), F.lit(False))), lambda e: e["e"]))
        return let(free(node["first"]), lambda one: F.when(F.size(one) > 0, one).otherwise(free(node["rest"])))

    def move(states: Column, steps: Column) -> Column:
        return F.when(steps.isNull(), states).otherwise(F.aggregate(steps, F.lit(0), lambda acc, p: acc.bitwiseOR(F.when(states.bitwiseAND(p["at"]) != 0, p["bit"]).otherwise(F.lit(0)))))

    def children(s: Column, e: Column) -> Column:
        path = F.concat(F.array(F.struct(e["form"].alias("form"), e["label"].alias("label"))), s["path"])
        grown = lambda after: F.when(after == 0, none).otherwise(F.transform(e["variants"], lambda v: F.struct(v.alias("cur"), path.alias("path"), after.alias("states"))))
        return let(move(s["states"], moves[e["label"]]), grown)

    def expanded(s: Column, dup: Column) -> Column:
        def of(node: Column) -> Column:
            # Where nothing is known of a string it has no edges.
            own = F.when((F.size(s["path"]) >= A.DEPTH) | node.isNull() | dup, F.lit(None)).otherwise(opened(node, F.get(s["path"], F.lit(0))["label"]))
            known = F.coalesce(node["in_dict"], F.lit(False)) if lexicon else F.lit(False)
            return let(own, lambda e: F.struct(s.alias("s"), dup.alias("dup"), ((F.coalesce(F.size(e), F.lit(0)) <= 0) | (F.size(s["path"]) > 0) | known).alias("found"), F.coalesce(F.flatten(F.transform(e, lambda x: children(s, x))), none).alias("next")))

        return let(nodes[s["cur"]], of)

    def along(acc: Column, x: Column) -> Column:
        """One state leaves the queue, unless the search has ended."""
        ends = acc["stop"] | (F.size(acc["found"]) >= 5 * most) | (acc["queue"] > A.QUEUE)
        put = F.when(x["dup"] | ~x["found"], acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(x["s"]["cur"].alias("stem"), x["s"]["path"].alias("path")))))
        on = F.struct((acc["queue"] - 1 + F.size(x["next"])).alias("queue"), F.lit(False).alias("stop"), F.concat(acc["next"], x["next"]).alias("next"), put.alias("found"))
        off = F.struct(acc["queue"].alias("queue"), F.lit(True).alias("stop"), acc["next"].alias("next"), acc["found"].alias("found"))
        return F.when(ends, off).otherwise(on)

    def level(acc: Column, _: Column) -> Column:
        front = acc["next"]
        each = F.transform(front, lambda s, i: expanded(s, F.array_position(front, s) <= i))
        begin = F.struct(F.size(front).alias("queue"), acc["stop"].alias("stop"), none.alias("next"), acc["found"].alias("found"))
        done = F.aggregate(each, begin, along)
        return F.when(acc["stop"] | (F.size(front) == 0), acc).otherwise(let(done, lambda d: F.struct(F.lit(0).alias("queue"), d["stop"].alias("stop"), F.when(d["stop"], none).otherwise(d["next"]).alias("next"), d["found"].alias("found"))))

    first = F.array(F.struct(word.alias("cur"), F.array().cast(_PATH).alias("path"), F.lit(suffixes.START).alias("states")))
    begin = F.struct(F.lit(0).alias("queue"), F.lit(False).alias("stop"), first.cast(_STATE).alias("next"), F.array().cast(_FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(A.DEPTH)), begin, level)["found"]


def score(nodes: Column, stem: Column, path: Column, upos: Column, lexicon: bool) -> Column:
    """Terms are added in a fixed order, so equal analyses have equal scores to the last bit."""
    n = F.length(stem)
    total = F.lit(0.0)
    node = nodes[stem]
    if lexicon:
        word, verb = (F.coalesce(node[c], F.lit(False)) for c in ("in_dict", "is_verb"))
        final = F.exists(F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), F.lit(2)), lambda p: F.exists(F.split(p["label"], "/"), lambda x: x.isin(*sorted(tables.VERB_FINAL))))
        bonus = verb & (F.coalesce(upos == "VERB", F.lit(False)) | (~_any(upos, A._NO_VERB_BONUS) & final))
        total = total + F.when(word | verb, F.when(bonus, F.lit(10.0) + 15).otherwise(10.0)).when(node["root"].isNotNull(), F.when(F.coalesce(node["r_in"], F.lit(False)), 10.0).otherwise(8.0)).otherwise(0.0)
    total = total + n * F.lit(0.5) - F.when(n < 2, 10.0).otherwise(0.0) - F.size(path) * F.lit(0.3)
    if lexicon:
        is_in = lambda s: F.coalesce(nodes[s]["in_dict"], F.lit(False))
        total = total - F.when((n >= 3) & stem.rlike(f"[{VOWELS}]y$") & is_in(stem) & is_in(_minus(stem)), 2.0).otherwise(0.0)
    last = lambda acc, p: F.struct((acc["s"] - F.when((acc["inner"] == "EMİR/KİŞİ_2T") & p["label"].isin(*sorted(tables.CASES)), 3.0).otherwise(0.0)).alias("s"), p["label"].alias("inner"))
    return F.aggregate(path, F.struct(total.alias("s"), F.lit("").alias("inner")), last)["s"]


def ranked(nodes: Column, found: Column, upos: Column, most: int, lexicon: bool) -> Column:
    """The best `most` by score, ties in the order found; with a dictionary those with a root, else the best one."""
    def one(x: Column, i: Column) -> Column:
        good = nodes[x["stem"]]["root"].isNotNull() | F.coalesce(nodes[x["stem"]]["b_verb"], F.lit(False)) if lexicon else F.lit(True)
        return F.struct((F.lit(0.0) - score(nodes, x["stem"], x["path"], upos, lexicon)).alias("low"), i.alias("place"), (~good).alias("bad"), x["stem"].alias("stem"), x["path"].alias("path"))

    def chosen(order: Column) -> Column:
        return let(F.filter(order, lambda x: ~x["bad"]), lambda good: F.when(F.size(good) > 0, F.slice(good, 1, most)).otherwise(F.slice(order, 1, 1)))

    return F.transform(let(F.array_sort(F.transform(found, one)), chosen), lambda x: F.struct(x["stem"].alias("stem"), x["path"].alias("path")))


def connected(nodes: Column, stem: Column, path: Column) -> Column:
    """Moves the letter before -yor to where it belongs."""
    head, form, before, last = F.get(path, F.lit(0)), F.get(path, F.lit(0))["form"], _minus(stem), _last(stem)
    a = last_vowel(before)
    own = (form == "yor") & last.rlike(f"[{CLOSE}]") & (F.length(before) >= 2) & a.isNotNull() & _last(before).rlike(f"[{CONSONANTS}]") & H.major(a, last) & H.minor(a, last)
    grown = form.rlike(f"^[{CLOSE}]yor$") & (F.length(stem) >= 3) & stem.rlike(f"[{CONSONANTS}]{{2}}$") & a.isNotNull()
    moves = F.coalesce(F.contains(head["label"], F.lit("ŞİMDİKİ_ZAMAN")) & ~F.coalesce(nodes[stem]["is_verb"], F.lit(False)) & (own | grown), F.lit(False))
    moved = F.concat(F.array(F.struct(F.concat(last, form).alias("form"), F.lit("ŞİMDİKİ_ZAMAN").alias("label"))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))))
    return F.when(moves, F.struct(before.alias("stem"), moved.alias("path"))).otherwise(F.struct(stem.alias("stem"), path.alias("path")))


def read(path: Column) -> Column:
    """One label for suffixes that have two, from the one chosen before and the one after."""
    def one(acc: Column, x: Column) -> Column:
        before, label, after = F.try_element_at(acc, F.lit(-1))["label"], x["label"], x["after"]
        chosen = (
            F.when(label == "OLUMSUZ/İSİM_FİİL", F.when(_any(after, A._NOMINAL_AFTER_MA), "İSİM_FİİL_-mA").when(_any(after, A._VERBAL_AFTER_MA), "OLUMSUZ").otherwise(label))
            .when(label == "ÇOĞUL", F.when(_any(before, A._BEFORE_PLURAL), "KİŞİ_3Ç").otherwise(label))
            .when(label == "EMİR/KİŞİ_2T", F.when(_any(before, A._BEFORE_SIN), "KİŞİ_2T").when(before.isNull() | before.isin("OLUMSUZ", "OLUMSUZ/İSİM_FİİL", "İSİM_FİİL_-mA", "YETERLİLİK"), "EMİR").otherwise(label))
            .when(label == "BİLDİRME/ETTİRGEN", F.when(_any(before, A._BEFORE_DIR) | (before.isNull() & after.isNull()), "BİLDİRME").when(before.isNull(), "ETTİRGEN").otherwise(label))
            .when(label == "İYELİK_3T/BELIRTME", F.when(_any(before, A._POSSESSIVES), "BELIRTME").when(_any(after, A._AFTER_POSSESSIVE), "İYELİK_3T").otherwise(label))
            .when(label == "İYELİK_2T/TAMLAYAN", F.when(_any(before, A._POSSESSIVES), "TAMLAYAN").when(_any(after, A._AFTER_POSSESSIVE), "İYELİK_2T").otherwise(label))
            .otherwise(label)
        )
        return F.concat(acc, F.array(F.struct(x["form"].alias("form"), chosen.alias("label"))))

    with_next = F.transform(path, lambda p, i: F.struct(p["form"].alias("form"), p["label"].alias("label"), F.get(path, i + 1)["label"].alias("after")))
    return F.aggregate(with_next, F.array().cast(_PATH), one)


def rooted(nodes: Column, stem: Column, path: Column, upos: Column, lexicon: bool) -> Column:
    """(root, lemma); what doesn't differ from the stem is null."""
    nothing = F.struct(F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("lemma"))
    if not lexicon:
        return nothing
    wide = F.concat(_minus(stem), F.element_at(F.create_map(*[F.lit(x) for p in WIDENED.items() for x in p]), _last(stem)))
    own, narrow = nodes[stem], nodes[wide]
    said = lambda n, r, is_in, verb, inf, bare: F.struct(n[r].alias("root"), n[is_in].alias("is_in"), n[verb].alias("verb"), n[inf].alias("inf"), n[bare].alias("bare"))
    by_root = lambda n: said(n, "root", "r_in", "r_verb", "r_inf", "r_bare")
    narrowed = F.contains(F.get(path, F.lit(0))["form"], F.lit("yor")) & narrow["root"].isNotNull() & (narrow["root"] != stem)
    base = F.when(own["root"].isNotNull(), by_root(own)).when(narrowed, by_root(narrow)).when(own["base"].isNotNull(), said(own, "base", "b_in", "b_verb", "b_inf", "b_bare"))

    def out(r: Column) -> Column:
        derived = F.coalesce(r["verb"], F.lit(False)) & F.coalesce(upos == "VERB", F.lit(False)) & r["bare"].isNotNull()
        lemma = F.when(F.coalesce(r["verb"], F.lit(False)) & (~F.coalesce(r["is_in"], F.lit(False)) | stem.isin(*sorted(_VERBS))), r["inf"])
        plain = F.struct(F.when(r["root"] != stem, r["root"]).alias("root"), lemma.alias("lemma"))
        return F.when(derived, F.struct(r["bare"].alias("root"), r["root"].alias("lemma"))).otherwise(plain)

    return let(base, out)


def finished(nodes: Column, chosen: Column, upos: Column, most: int, lexicon: bool) -> Column:
    """Analyses (stem, root, lemma, suffixes) without those that equal an earlier one in root, lemma and labels."""
    verbs = F.create_map(*[F.lit(x) for p in sorted(_VERBS.items()) for x in p])

    def whole(c: Column) -> Column:
        def of(labels: Column) -> Column:
            def of_root(r: Column) -> Column:
                root = F.when(F.coalesce(upos == "VERB", F.lit(False)), F.coalesce(verbs[F.coalesce(r["root"], c["stem"])], r["root"])).otherwise(r["root"])
                return F.struct(c["stem"].alias("stem"), root.alias("root"), r["lemma"].alias("lemma"), labels.alias("suffixes"))

            return let(rooted(nodes, c["stem"], labels, upos, lexicon), of_root)

        return let(read(c["path"]), of)

    each = F.transform(chosen, lambda x: let(connected(nodes, x["stem"], x["path"]), whole))
    same = lambda a, b: (F.coalesce(a["root"], a["stem"]) == F.coalesce(b["root"], b["stem"])) & a["lemma"].eqNullSafe(b["lemma"]) & (F.transform(a["suffixes"], lambda p: p["label"]) == F.transform(b["suffixes"], lambda p: p["label"]))
    kind = "array<struct<stem:string,root:string,lemma:string,suffixes:" + _PATH + ">>"
    return F.aggregate(each, F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: same(y, x)), acc).otherwise(F.concat(acc, F.array(x))))


def asked(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """rows (word, upos) with low and w (what the search begins with), proper (stem and ending that an apostrophe parts) and
    fixed, the root that tables decide."""
    plain = F.regexp_replace("word", r"(?U)^\s+|\s+$", "")
    mark = F.when(F.contains(plain, F.lit("’")), "’").when(F.contains(plain, F.lit("'")), "'")
    at = F.instr(plain, mark)
    rows = rows.withColumns({"_p": plain, "_head": F.when(mark.isNotNull(), F.substring(plain, F.lit(1), at - 1)), "_tail": F.when(mark.isNotNull(), F.substring(plain, at + 1, F.length(plain))), "low": lower(plain)})
    parts = (F.col("_head") != "") & (F.col("_tail") != "")
    base, end = lower(F.col("_head")), lower(F.col("_tail"))
    rows = rows.withColumns({"w": F.when(parts, F.concat(base, end)).when(mark.isNotNull(), F.replace("low", mark)).otherwise(F.col("low")), "_end": F.when(parts & F.col("_head").rlike(r"^\p{IsUppercase}"), end)})
    rows = rows.withColumn("spare", F.when(parts, base).otherwise(F.col("w")))
    rows = rows.join(F.broadcast(forms.select(F.col("form").alias("_end"), F.col("label").alias("_label"))), "_end", "left")
    proper = F.when(F.col("_label").isNotNull(), F.array(F.struct(F.col("spare").alias("stem"), F.array(F.struct(F.col("_end").alias("form"), F.col("_label").alias("label"))).alias("path"))))
    own = {k: tables.inverted(v) for k, v in (("aux", tables.AUXILIARIES), ("ordinal", tables.ORDINALS), ("post", tables.POSTPOSITIONS), ("pronoun", tables.PRONOUNS))}
    listed = rows.sparkSession.createDataFrame([(w, *(t.get(w) for t in own.values())) for w in sorted(set().union(*own.values()))], "low string, aux string, ordinal string, post string, pronoun string")
    rows = rows.withColumn("proper", proper).join(F.broadcast(listed), "low", "left")
    u = F.coalesce("upos", F.lit(""))
    none = F.struct(F.lit(None).cast("string").alias("root"))
    root = lambda c: F.struct(F.col(c).alias("root"))
    fixed = F.when(((u == "AUX") & F.col("aux").isNotNull()) | ((u == "VERB") & F.coalesce(F.col("aux") == "değil", F.lit(False))), root("aux")).when(u.isin("CCONJ", "INTJ"), none)
    fixed = fixed.when(u.isin("NUM", "ADJ") & F.col("ordinal").isNotNull(), root("ordinal")).when(u.isin("NOUN", "NUM") & F.col("post").isNotNull(), root("post")).when(F.col("pronoun").isNotNull(), root("pronoun"))
    return rows.withColumn("fixed", fixed).select("word", "upos", "low", "w", "spare", "proper", "fixed")


def analyze(words: DataFrame, dictionary: DataFrame | None = None, most: int = 5, forms=None, strategies=None) -> DataFrame:
    """(word, upos, rank, stem, root, lemma, suffixes) of each distinct word; rank 1 is best. upos may be missing or null.

    dictionary: a DataFrame with the column word, of any size. Without one only the heuristic strategies run and roots stay
    null. Null words give no rows.
    """
    spark, lexicon, derived = words.sparkSession, dictionary is not None, "upos" in words.columns
    rows = words if derived else words.withColumn("upos", F.lit(None).cast("string"))
    rows = rows.select("word", "upos").filter(F.col("word").isNotNull()).distinct()
    strategies = strategies or (A.WITH_DICTIONARY if lexicon else A.HEURISTIC)
    table = _forms(spark, forms)
    longest = max([1, *(len(r["form"]) for r in table.select("form").collect())])  # a few hundred rows
    rows = cut(asked(rows, table))
    reached = rows.filter("fixed IS NULL").select("w").distinct().select("w", F.explode(strings(F.col("w"), longest)).alias("x"))
    known = facts(cut(dictionary.select("word").filter("word IS NOT NULL").distinct()), derived) if lexicon else None
    xs = reached.select("x").distinct()
    if lexicon:
        info = cut(looked_up(xs, known))
        nodes = edges(info.select("x"), info, table, strategies, longest, lexicon)
        nodes = nodes.filter("root IS NOT NULL OR base IS NOT NULL OR size(first) > 0 OR size(rest) > 0")
        names = ["root", "in_dict", "is_verb", "r_in", "r_verb", "r_inf", "r_bare", "base", "b_in", "b_verb", "b_inf", "b_bare", "first", "rest"]
    else:
        nodes = edges(xs, None, table, strategies, longest, lexicon).withColumn("is_verb", F.lit(None).cast("boolean"))
        names = ["is_verb", "first", "rest"]
    per_word = reached.join(nodes.select("x", F.struct(*names).alias("node")), "x").groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("x", "node"))).alias("nodes"))
    # Words are few bytes but much work: adaptive execution would put them in one task.
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    joined = rows.join(per_word, "w", "left").repartition(many, "word", "upos")
    n, w, upos = F.coalesce(F.col("nodes"), F.create_map().cast(dict(per_word.dtypes)["nodes"])), F.col("w"), F.col("upos")
    found = joined.withColumn("nodes", n).withColumn("found", F.when(F.col("proper").isNull() & F.col("fixed").isNull(), paths(F.col("nodes"), w, most, lexicon)))
    chosen = F.coalesce("proper", ranked(F.col("nodes"), F.col("found"), upos, most, lexicon))
    best = finished(F.col("nodes"), chosen, upos, most, lexicon)
    own = lambda stem, root: F.array(F.struct(stem.alias("stem"), root.alias("root"), F.lit(None).cast("string").alias("lemma"), F.array().cast(_PATH).alias("suffixes")))
    out = found.withColumn("best", F.when(F.col("fixed").isNotNull(), own(F.col("low"), F.col("fixed.root"))).otherwise(best))
    out = out.withColumn("best", F.when(F.size("best") > 0, F.col("best")).otherwise(own(F.col("spare"), F.lit(None).cast("string"))))
    return out.select("word", "upos", F.posexplode("best")).select("word", "upos", (F.col("pos") + 1).alias("rank"), "col.*")
