"""Scores of predicted against gold annotations.

Tokens are rows (sent_id, id, form, lemma, upos, head, deprel), ids from 1 in each sentence. Gold and prediction are aligned
by position; gold tokens without a partner count as errors, predicted ones without a partner only break a perfect sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.phonology import turkish_lower
from ..lineage import stored
from .search import let

MISSING = "_MISSING_"


def _peers():
    """Rows of one sentence with the same place. Tokens meet by windows instead of joins on sentence and id: a join would deal
    the tokens out anew each time, windows keep the partitioning by sentence. A place is a part of its own, so what meets there
    is gathered once, and no sentence is held."""
    return W.partitionBy("sent_id", "_at")


def merge_ranges(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Multi-word tokens become one: the first part stays with the surface form, heads of dropped parts move to it."""
    parts = ranges.select("sent_id", "first", "surface", F.explode(F.sequence("first", "last")).alias("id")).dropDuplicates(["sent_id", "id"])
    parts = parts.select("sent_id", "id", F.when(F.col("sent_id").isNotNull(), F.struct("first", "surface")).alias("_part"))
    rows = tokens.withColumn("_own", F.lit(True)).unionByName(parts, allowMissingColumns=True)
    rows = rows.withColumn("_at", F.col("id")).withColumn("_of", F.first("_part", ignorenulls=True).over(_peers()))
    to = F.when(F.col("id") > F.col("_part.first"), F.col("_part.first"))
    rows = rows.withColumn("_at", F.when(F.col("_own"), F.col("head")).otherwise(F.col("id"))).withColumn("_to", F.first(to, ignorenulls=True).over(_peers()))
    own = rows.filter("_own").filter(F.col("_of").isNull() | (F.col("_of.first") == F.col("id")))
    return own.withColumn("form", F.coalesce("_of.surface", "form")).withColumn("head", F.coalesce("_to", "head")).select(*tokens.columns)


def strip_punct(tokens: DataFrame) -> DataFrame:
    """Without PUNCT, ids from 1 again; heads that are gone become 0."""
    place = F.row_number().over(W.partitionBy("sent_id").orderBy("id"))
    left = tokens.filter(F.col("upos") != "PUNCT").withColumn("_new", place)
    # Each token twice: to ask for its head's new id, and, without its other columns, to answer with its own.
    new = F.when(F.col("sent_id").isNotNull() & F.col("id").isNotNull(), F.col("_new"))
    others = [c for c in tokens.columns if c not in ("sent_id", "id", "head")]
    none = lambda c: F.lit(None).cast(left.schema[c].dataType).alias(c)
    ask = F.struct(F.col("head").alias("_at"), F.lit(True).alias("_ask"), F.col("_new").alias("id"), F.lit(None).cast("int").alias("_own"), *others)
    answer = F.struct(F.col("id").alias("_at"), F.lit(False).alias("_ask"), F.lit(None).cast("int").alias("id"), new.alias("_own"), *map(none, others))
    rows = left.select("sent_id", F.inline(F.array(ask, answer))).withColumn("_heads", F.collect_list("_own").over(_peers()))
    out = rows.filter("_ask").withColumn("_head", F.explode_outer("_heads"))
    return out.withColumn("head", F.coalesce("_head", F.lit(0))).select(*tokens.columns)


_PREDICTED = ("form", "upos", "head", "deprel")


def prediction(**columns: Column) -> Column:
    """A token's prediction, for together(); columns that aren't given are the token's own."""
    return F.struct(*[columns.get(c, F.col(c)).alias(c) for c in _PREDICTED])


def together(gold: DataFrame, pred: DataFrame, commas: DataFrame | None = None) -> DataFrame:
    """Rows of gold (_own), of predictions (_p) and of places after a comma (_comma), which meet by sentence and id (_at)."""
    known = F.col("sent_id").isNotNull() & F.col("id").isNotNull()
    rows = gold.withColumns({"_at": F.col("id"), "_own": F.lit(True)})
    rows = rows.unionByName(pred.select("sent_id", F.col("id").alias("_at"), F.when(known, prediction()).alias("_p")), allowMissingColumns=True)
    if commas is None:
        return rows.withColumn("_comma", F.lit(None).cast("boolean"))
    after = commas.select("sent_id", (F.col("id") + 1).alias("_at"), F.when(F.col("sent_id").isNotNull(), True).alias("_comma"))
    return rows.unionByName(after, allowMissingColumns=True)


def derived(gold: DataFrame, predicted: Column, comma: Column | None = None) -> DataFrame:
    """Tokens with their prediction (_p) and whether a comma stands before them (_comma), for aligned_rows() and conjunct_rows().
    `predicted` is a token's prediction() or null, made from gold's own token, `comma` whether one follows. Sentences and ids are
    known, and ids come once, as strip_punct() gives them: so what has a token's sentence and id is its own prediction, which
    together() and a meeting of all tokens would only find again."""
    before = W.partitionBy("sent_id").orderBy("id")
    after = F.lit(None).cast("boolean") if comma is None else F.when((F.lag("id").over(before) == F.col("id") - 1) & F.lag(comma).over(before), True)
    return gold.withColumns({"_p": predicted, "_comma": after})


def _place(rows: DataFrame) -> bool:
    """Whether rows still have to meet at their places; those of derived() have."""
    return "_at" in rows.columns


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold tokens with p_upos, p_head, p_deprel and whether head, deprel, both and upos agree."""
    return aligned_rows(together(gold, pred))


def aligned_rows(rows: DataFrame) -> DataFrame:
    """aligned() of together() or derived()."""
    both = rows if not _place(rows) else rows.withColumn("_ps", F.collect_list("_p").over(_peers())).filter("_own").withColumn("_p", F.explode_outer("_ps"))
    return _agreeing(both, [c for c in rows.columns if c not in ("sent_id", "id") and not c.startswith("_")])


def _agreeing(both: DataFrame, others: list[str]) -> DataFrame:
    both = both.select("sent_id", "id", *others, *[F.col(f"_p.{c}").alias(f"p_{c}") for c in _PREDICTED])
    same = lambda c: F.coalesce(F.col(c) == F.col(f"p_{c}"), F.lit(False))
    return both.withColumns({"head_ok": same("head"), "deprel_ok": same("deprel"), "las_ok": same("head") & same("deprel"), "upos_ok": same("upos")})


def _hits(c: str) -> Column:
    return F.count_if(F.col(c))


def scores(al: DataFrame) -> DataFrame:
    return al.agg(F.count(F.lit(1)).alias("total"), _hits("head_ok").alias("uas"), _hits("las_ok").alias("las"), _hits("deprel_ok").alias("deprel_correct"), _hits("upos_ok").alias("upos_correct"))


def recall(al: DataFrame, by: str, hit: str) -> DataFrame:
    """Gold count and hits of each label."""
    return al.groupBy(by).agg(F.count(F.lit(1)).alias("gold"), _hits(hit).alias("hits"))


def confusion(al: DataFrame) -> DataFrame:
    """(deprel, p_deprel, n) of tokens that aren't right in head and relation."""
    return al.filter(~F.col("las_ok")).groupBy("deprel", F.coalesce("p_deprel", F.lit(MISSING)).alias("p_deprel")).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, n: int) -> DataFrame:
    """The n largest counts, as in a report; ties by the other columns."""
    return df.orderBy(F.desc("n"), *[c for c in df.columns if c != "n"]).limit(n)


def sentences(al: DataFrame, pred: DataFrame) -> DataFrame:
    """(sent_id, gold, predicted, perfect) of each gold sentence."""
    g = al.groupBy("sent_id").agg(F.count(F.lit(1)).alias("gold"), F.bool_and("las_ok").alias("_ok"))
    p = pred.groupBy("sent_id").agg(F.count(F.lit(1)).alias("predicted"))
    return g.join(p, "sent_id", "left").select("sent_id", "gold", F.coalesce("predicted", F.lit(0)).alias("predicted"), (F.col("_ok") & (F.col("gold") == F.coalesce("predicted", F.lit(0)))).alias("perfect"))


def conjuncts(gold: DataFrame, pred: DataFrame, commas: DataFrame) -> DataFrame:
    """Gold conjuncts: (sent_id, id, form, p_upos, p_deprel, upos, head_form, head_upos, head_deprel, kind, joined, comma,
    distance, hit).

    kind: cconj if a CCONJ stands between the head and the conjunct, or is a head to the right; comma if one stands before the
    conjunct; else neither. joined: a CCONJ stands after the first of the two, up to the second. Only words with a
    prediction count as a CCONJ. commas: (sent_id, id) of tokens that a comma follows.
    """
    return conjunct_rows(together(gold, pred, commas))


def conjunct_rows(rows: DataFrame) -> DataFrame:
    """conjuncts() of together() or derived()."""
    # How many CCONJ stand up to each token: whether one stands between two is a difference.
    upto = lambda own, at: F.sum(F.when(own & (F.col("upos") == "CCONJ"), F.col("_found")).otherwise(0)).over(W.partitionBy("sent_id").orderBy(at))
    if _place(rows):
        found = F.count(F.col("_p.deprel")).over(_peers())
        rows = rows.withColumns({"_ps": F.collect_list("_p").over(_peers()), "_found": found, "_comma": F.max("_comma").over(_peers())})
        rows = rows.withColumn("_upto", upto(F.col("_own"), "_at")).filter("_own").withColumn("_p", F.explode_outer("_ps"))
    else:
        rows = rows.withColumn("_found", F.when(F.col("_p.deprel").isNotNull(), 1).otherwise(0)).withColumn("_upto", upto(F.lit(True), "id"))
    rows = rows.select("sent_id", "id", "form", "upos", "head", "deprel", "_comma", "_upto", *[F.col(f"_p.{c}").alias(f"p_{c}") for c in ("upos", "deprel")])
    rows = rows.withColumn("_mine", F.when((F.col("upos") == "CCONJ") & F.col("p_deprel").isNotNull(), 1).otherwise(0))
    # A conjunct comes twice: to ask for its head, and as all others do to answer.
    rows = rows.withColumn("_asks", (F.col("deprel") == "conj") & F.col("p_deprel").isNotNull())
    rows = rows.withColumn("_ask", F.explode(F.when(F.col("_asks"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumn("_at", F.when(F.col("_ask"), F.col("head")).otherwise(F.col("id")))
    own = F.struct(*[F.col(c).alias(f"head_{c}") for c in ("form", "upos", "deprel")], F.col("_upto").alias("_head"))
    answer = F.when(~F.col("_ask") & F.col("sent_id").isNotNull() & F.col("id").isNotNull(), own)
    al = rows.withColumn("_heads", F.collect_list(answer).over(_peers())).filter("_ask").select("*", F.inline_outer("_heads"))
    head = F.coalesce("_head", F.lit(0))
    between = F.when(F.col("head") > F.col("id"), head - F.col("_upto")).otherwise(F.col("_upto") - F.col("_mine") - head)
    kind = F.when(between > 0, "cconj").when(F.col("_comma"), "comma").otherwise("neither")
    known = [F.coalesce(f"head_{c}", F.lit("?")).alias(f"head_{c}") for c in ("form", "upos", "deprel")]
    return al.select(
        "sent_id", "id", "form", "p_upos", "p_deprel", "upos", *known, kind.alias("kind"), (head != F.col("_upto")).alias("joined"), F.coalesce("_comma", F.lit(False)).alias("comma"),
        F.abs(F.col("id") - F.col("head")).alias("distance"), (F.col("p_deprel") == "conj").alias("hit"),
    )


def lemma_rows(tokens: DataFrame, predicted: Column) -> DataFrame:
    """(word, upos, gold, predicted, changed, ok) of tokens (word, lemma, upos) but PUNCT, SYM and X."""
    rows = tokens.filter(~F.col("upos").isin("PUNCT", "SYM", "X")).select("word", "upos", turkish_lower(F.col("lemma")).alias("gold"), F.lower(predicted).alias("predicted"))
    return rows.withColumns({"changed": turkish_lower(F.col("word")) != F.col("gold"), "ok": F.col("predicted") == F.col("gold")})


def lemma_scores(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("correct"), F.count_if("changed").alias("changed_total"),
        F.count_if(F.col("changed") & F.col("ok")).alias("changed_correct"), F.count_if(~F.col("changed") & F.col("ok")).alias("identity_correct"),
    )


def lemma_by_pos(rows: DataFrame) -> DataFrame:
    return rows.groupBy("upos").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("correct"))


def lemma_errors(rows: DataFrame, n: int = 25) -> DataFrame:
    """The n most frequent (gold, predicted, upos) errors with the smallest word as example."""
    return top(rows.filter(~F.col("ok")).groupBy("gold", "predicted", "upos").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("example")), n)


def losses(al: DataFrame, n: int = 10) -> DataFrame:
    """(deprel, gold, hits, loss, percent): the relations that lose most tokens, and their recall."""
    rows = recall(al, "deprel", "las_ok").withColumns({"loss": F.col("gold") - F.col("hits"), "percent": F.round(F.col("hits") * 100.0 / F.col("gold"), 1)})
    return rows.orderBy(F.desc("loss"), "deprel").limit(n)


def mixed_up(al: DataFrame, n: int = 15) -> DataFrame:
    """(deprel, p_deprel, n): the pairs of different relations that are mixed up most."""
    return top(confusion(al).filter(F.col("deprel") != F.col("p_deprel")), n)


def benchmark(blocks: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Gold sentences as CoNLL-U text against the parses of their texts: aligned tokens, without PUNCT and with multi-word
    tokens as one. Sentences without a text give no tokens of their own, so all of theirs are errors.

    All that is asked of a token lies in its own block, so a block keeps its tokens in its row: they are merged, counted and aligned
    there as merge_ranges(), strip_punct() and aligned() do with rows, and none is shuffled.
    """
    from ..sources import conllu
    from .annotate import nested

    blocks = stored(blocks)  # they may come from a parser, whose workers need not run beside those of this one
    parsed = nested(conllu.texts(blocks, F.col("block")), dictionary, dictionary, columns=["form", "upos", "head", "deprel"])
    block = F.col("sent_id")  # a sentence goes by its block
    rows = parsed.select(conllu.nested_tokens(block).alias("tokens"), conllu.nested_ranges(block).alias("ranges"), conllu.name(block).alias("sent_id"), "words")
    names = ["form", "lemma", "upos", "feats", "head", "deprel"]

    def numbered(kept: Column, ids: Column) -> Column:
        new = lambda t: F.coalesce(F.array_position(ids, t["head"]), F.lit(0)).cast("int")
        return F.transform(kept, lambda t, k: F.struct((k + 1).alias("id"), *[(new(t) if n == "head" else t[n]).alias(n) for n in names], F.get("words", k).alias("_p")))

    kept = F.array_sort(F.filter(_merged(F.col("tokens"), F.col("ranges")), lambda t: t["upos"] != "PUNCT"))  # by id
    aligned = let(kept, lambda kept: let(F.transform(kept, lambda t: t["id"]), lambda ids: numbered(kept, ids)))
    return _agreeing(rows.select("sent_id", F.inline(aligned)), names)


def _merged(tokens: Column, ranges: Column) -> Column:
    """merge_ranges() of a sentence's tokens; of ranges that overlap the first counts."""
    part = lambda i: F.get(F.filter(ranges, lambda r: i.between(F.least(r["first"], r["last"]), F.greatest(r["first"], r["last"]))), F.lit(0))

    def one(t: Column) -> Column:
        first = part(t["head"])["first"]
        head = F.when(first < t["head"], first).otherwise(t["head"])
        return let(part(t["id"]), lambda own: t.withField("form", F.coalesce(own["surface"], t["form"])).withField("head", head))

    first = lambda t: part(t["id"])["first"]
    return F.when(F.size(ranges) == 0, tokens).otherwise(F.transform(F.filter(tokens, lambda t: first(t).isNull() | (first(t) == t["id"])), one))


def compared(expected: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """expected (word, lemma, upos) with what each word gets: lemma by itself, part of speech as a sentence of its own, and
    whether they are as expected. What isn't expected (null) isn't compared."""
    from ..functions.glosses import lemma
    from .analyzer import analyze
    from .annotate import annotate

    words = expected.select("word").distinct()
    alone = analyze(words, dictionary).filter("rank = 1").select("word", lemma(F.col("lemma"), F.col("root"), F.col("stem")).alias("p_lemma"))
    parsed = annotate(words.select(F.col("word").alias("sent_id"), F.col("word").alias("text")), dictionary, dictionary, columns=["sent_id", "id", "upos"]).filter("id = 1").select(F.col("sent_id").alias("word"), F.col("upos").alias("p_upos"))
    both = expected.join(alone, "word", "left").join(parsed, "word", "left")
    ok = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.col(c) == F.col(f"p_{c}"), F.lit(False)))
    return both.withColumns({"lemma_ok": ok("lemma"), "upos_ok": ok("upos")})
