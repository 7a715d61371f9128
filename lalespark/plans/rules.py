"""Single rules of the parser, and word-level tests that they use, each with the same rule as SQL.

Rules run over sentences of twelve words made from the tokens of documents by arithmetic on a token's length and place: forms
that the rules know, label sets, parts of speech, and relations that some words have already. The SQL says each rule over
the sentence as a relation: neighbours, the first word of a kind with none of another between, runs of words. What all words
of a document have become is compared as a digest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..operators import relations as R
from ..operators import syntax as S
from ..operators import wordclasses as C
from ..operators.search import let
from .base import TOKEN, dealt, parts, table

QUERIES, ORACLES = {}, {}

FORMS = (
    "Ali Kemal Ankara için ile gibi benim onun ev kapı yer gök saç sakal evdeki okuldaki gelince koşarken dedi sabah akşam bile dahi güzel yavaş yavaş istedi isterim okumayı kitap geldi çocuk"
).split()
LABELS = [
    [], [], [], ["TAMLAYAN"], ["İYELİK_3T"], ["GEÇMİŞ_ZAMAN"], ["SIFAT_FİİL"], ["ZARF_FİİL_-Ip"], ["MASTAR"], ["SIFAT_FİİL_-DIk", "BULUNMA"], ["İYELİK_3T", "YÖNELME"], ["ÇOĞUL", "BELIRTME"],
    ["BİLDİRME"], ["DİLEK_ŞART"], ["YAPIM_-lI"], ["ÇOĞUL", "KİŞİ_3Ç"], ["KİŞİ_1T", "ÇOĞUL"], ["İYELİK_2T/TAMLAYAN", "AYRILMA"], ["GENİŞ_ZAMAN"],
]
TAGS = "NOUN NOUN PROPN PROPN VERB ADJ ADV DET NUM PRON CCONJ ADP NOUN".split()
RELATIONS = "_ _ _ _ dep _ _ root conj nmod:poss acl obj obj nsubj _ _ advcl".split()
SIZE = 12

#: Which form, labels, part of speech, relation, head and comma a token gets, from its length n and place i; Spark and DuckDB
#: read these alike.
CHOICE = {
    "form": f"(n * 7 + i * i) % {len(FORMS)}", "labels": f"(n * 5 + i * i * 3 + i) % {len(LABELS)}", "tag": f"(n * 3 + i * i + i) % {len(TAGS)}",
    "rel": f"(n * 11 + i * i * 7) % {len(RELATIONS)}", "head": f"(n + i * 5) % {SIZE} + 1", "comma": "(n + i * i) % 3 = 0",
}


def given(spark, sf_dir):
    """Annotated tokens in sentences of SIZE words."""
    split = lambda n: F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / SIZE).cast("int")), lambda k: F.slice(n, k * SIZE + 1, SIZE)))
    lengths = F.transform(tokens(F.col("text")), lambda w: F.length(w))
    # Sentences are dealt out as the lengths of their words, before they become words with labels.
    docs = table(spark, sf_dir, "documents")
    sents = docs.select("doc_id", F.posexplode(let(lengths, split)).alias("s", "own"))
    sents = dealt(sents.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("s").cast("string")).alias("sent_id"), "s", "own"), "sent_id", docs)
    rows = sents.select("sent_id", "s", F.posexplode("own").alias("k", "n")).withColumn("i", (F.col("s") * SIZE + F.col("k")) % 997)
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), F.expr(CHOICE[k]).cast("int"))
    path = lambda own: F.array(*[F.struct(F.lit("x").alias("form"), F.lit(x).alias("label")) for x in own]).cast("array<struct<form:string,label:string>>")
    rows = rows.select(
        "sent_id", (F.col("k") + 1).cast("int").alias("id"), pick(FORMS, "form").alias("form"),
        F.get(F.array(*map(path, LABELS)), F.expr(CHOICE["labels"]).cast("int")).alias("suffixes"), pick(TAGS, "tag").alias("upos"), pick(RELATIONS, "rel").alias("deprel"),
        F.expr(CHOICE["head"]).cast("int").alias("_h"), F.expr(CHOICE["comma"]).alias("comma"),
    )
    head = F.when(F.col("deprel").isin("_", "dep", "root"), 0).otherwise(F.col("_h")).cast("int")
    return rows.withColumns({"lemma": F.left(F.lower("form"), F.lit(4)), "head": head}).drop("_h")


def _digest(out, docs, cols=("upos", "head", "deprel")):
    """(doc_id, n, digest): the words of each document, in order, as one text's MD5. docs: the documents, whose size says into
    how many parts their words' texts are dealt."""
    rows = out.select("sent_id", F.struct("id", F.concat_ws(":", "id", *cols).alias("line")).alias("x"))
    text = lambda lines, c: F.array_join(F.transform(lines, lambda x: x[c]), "\n")
    # Words become a sentence's text where they are; only such texts are shuffled.
    said = rows.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n"), text(F.sort_array(F.collect_list("x")), "line").alias("text")).withColumn("_s", F.split("sent_id", "-"))
    said = said.select(F.col("_s")[0].cast("long").alias("doc_id"), "n", F.struct(F.col("_s")[1].cast("int").alias("s"), "text").alias("x"))
    own = said.repartition(parts(docs), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("x")).alias("x"))
    return own.select("doc_id", "n", F.md5(text(F.col("x"), "text")).alias("digest"))


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _has(labels, t: str = "") -> str:
    return f"list_has_any({t}labels, [{', '.join(repr(x) for x in sorted(labels))}])"


def _picked(names, k: str) -> str:
    return f"{names}[{CHOICE[k]} + 1]"


_W = {k: C.words(v) for k, v in vars(C).items() if isinstance(v, str) and k.isupper()}
_NOMINAL, _MODIFIERS = "('NOUN', 'PROPN')", "('ADJ', 'DET', 'NUM', 'ADV')"
_OWNED, _CASED = _has(_W["POSSESSIVES"]), _has(C.CASE)
_PAIRS = "(" + ", ".join("('{}', '{}')".format(*p.split("-")) for p in C.PAIRS.split()) + ")"
_S = f"""w AS (SELECT doc_id, u.i AS pos, u.i % 997 AS i, length(t[u.i + 1]) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents), unnest(range(0, len(t))) AS u(i)),
b AS (SELECT doc_id, pos // {SIZE} AS s, CAST(pos % {SIZE} + 1 AS INTEGER) AS id, {_picked(FORMS, 'form')} AS form, {_picked(LABELS, 'labels')} AS path, {_picked(TAGS, 'tag')} AS upos, {_picked(RELATIONS, 'rel')} AS rel,
  CAST({CHOICE['head']} AS INTEGER) AS h, {CHOICE['comma']} AS comma FROM w),
s AS MATERIALIZED (SELECT doc_id, s, id, form, lower(form) AS low, left(lower(form), 4) AS lemma, path, CAST(flatten(list_transform(path, lambda x: string_split(x, '/'))) AS VARCHAR[]) AS labels, upos, rel,
  rel IN ('_', 'dep') AS free, CASE WHEN rel IN ('_', 'dep', 'root') THEN 0 ELSE h END AS head, comma FROM b),
r AS MATERIALIZED (SELECT doc_id, s, min(id) AS root FROM s WHERE rel = 'root' GROUP BY ALL),
rest AS (SELECT s.*, root FROM s JOIN r USING (doc_id, s) WHERE free AND id <> root)"""
# The nearest predicate to the right, or the root.
_NEXT = "p AS (SELECT a.doc_id, a.s, a.id, coalesce(min(b.id), any_value(a.root)) AS head FROM rest a LEFT JOIN s b ON a.doc_id = b.doc_id AND a.s = b.s AND b.id > a.id AND (b.rel IN ('root', 'advcl', 'acl', 'ccomp') OR b.rel = 'conj' AND b.upos = 'VERB') GROUP BY ALL)"


def _ahead(name: str, of: str, wanted: str, through: str, far: int = SIZE) -> str:
    """name(doc_id, s, id, head): for words with `of`, the first word b that is wanted, if all between may be passed."""
    return (
        f"{name} AS (SELECT doc_id, s, id, w AS head FROM (SELECT a.doc_id, a.s, a.id, min(b.id) FILTER ({wanted}) AS w, min(b.id) FILTER (NOT ({wanted}) AND NOT ({through})) AS z "
        f"FROM (SELECT * FROM s WHERE {of}) a JOIN s b ON a.doc_id = b.doc_id AND a.s = b.s AND b.id > a.id AND b.id <= a.id + {far} GROUP BY ALL) WHERE w < coalesce(z, 99))"
    )


def _rule(*parts: str):
    """Registers a rule with its SQL: tables, the last of which gives (doc_id, s, id, head, rel, upos) of words that change."""
    sql = (
        f"WITH {', '.join([_S, *parts[:-1], f'ch AS ({parts[-1]})'])}, o AS (SELECT s.doc_id, s.s, s.id, coalesce(ch.upos, s.upos) AS upos, coalesce(ch.head, s.head) AS head, coalesce(ch.rel, s.rel) AS rel FROM s LEFT JOIN ch USING (doc_id, s, id)) "
        "SELECT doc_id, count(*) AS n, md5(string_agg(concat_ws(':', id, upos, head, rel), chr(10) ORDER BY s, id)) AS digest FROM o GROUP BY doc_id"
    )

    def add(rule):
        name = f"rule_{rule.__name__}"
        QUERIES[name] = lambda spark, sf_dir: _digest(R.RULES[rule.__name__](given(spark, sf_dir)), table(spark, sf_dir, "documents"))
        ORACLES[name] = sql
        return rule

    return add


_NONE = "CAST(NULL AS VARCHAR)"
_rule(f"SELECT doc_id, s, max(id) AS id, 0 AS head, 'root' AS rel, {_NONE} AS upos FROM s WHERE {_has(S.FINAL)} OR upos = 'VERB' AND low IN {_in(_W['SPEECH'])} GROUP BY doc_id, s")(S.predicate)
_rule(f"SELECT doc_id, s, max(id) AS id, 0 AS head, 'root' AS rel, {_NONE} AS upos FROM s ANTI JOIN r USING (doc_id, s) GROUP BY doc_id, s")(S.nominal_predicate)
_rule(f"SELECT doc_id, s, id, id - 1 AS head, 'case' AS rel, CASE WHEN low <> 'ile' THEN 'ADP' END AS upos FROM s WHERE id > 1 AND free AND (low = 'ile' OR low IN {_in(_W['CASE_POSTPOSITIONS'])})")(S.postposition)
_rule(
    _ahead("x", f"free AND (list_contains(labels, 'TAMLAYAN') OR low IN {_in(_W['GENITIVE_PRONOUNS'])})", _has(_W["POSSESSIVES"], "b."), "b.upos IN ('ADJ', 'DET', 'NUM', 'NOUN', 'PROPN', 'ADV', 'CCONJ', 'PART', 'PRON', 'ADP')"),
    f"SELECT x.doc_id, x.s, x.id, x.head, CASE WHEN h.upos = 'VERB' THEN 'nsubj' ELSE 'nmod:poss' END AS rel, {_NONE} AS upos FROM x JOIN s h ON h.doc_id = x.doc_id AND h.s = x.s AND h.id = x.head",
)(S.possessive)
_nominal = f"(b.upos IN {_NOMINAL} OR b.upos = 'VERB' AND list_contains(b.labels, 'BİLDİRME'))"
_rule(_ahead("x", "free AND upos = 'DET'", _nominal, f"b.upos IN {_MODIFIERS}"), f"SELECT *, 'det' AS rel, {_NONE} AS upos FROM x")(S.determiner)
_rule(
    f"c AS (SELECT *, id - row_number() OVER (PARTITION BY doc_id, s ORDER BY id) AS run FROM s WHERE free AND upos IN {_NOMINAL} AND len(path) = 0 AND left(form, 1) <> lower(left(form, 1)))",
    "f AS (SELECT *, min(id) OVER w AS first, count(*) OVER w AS size FROM c WINDOW w AS (PARTITION BY doc_id, s, run))",
    "SELECT doc_id, s, id, CASE WHEN id > first THEN first END AS head, CASE WHEN id > first THEN 'flat' END AS rel, 'PROPN' AS upos FROM f WHERE size > 1",
)(S.flat_name)
_rule(
    "l AS (SELECT *, lag(low) OVER w AS before, lag(lemma) OVER w AS stem FROM s WINDOW w AS (PARTITION BY doc_id, s ORDER BY id))",
    f"SELECT doc_id, s, id, id - 1 AS head, 'compound:redup' AS rel, {_NONE} AS upos FROM l WHERE free AND id > 1 AND (before = low OR stem = lemma AND length(lemma) >= 2 OR (stem, lemma) IN {_PAIRS})",
)(S.reduplication)
_rule(
    f"l AS (SELECT *, lead(upos) OVER w AS r_upos, lead({_OWNED}) OVER w AS r_owned FROM s WINDOW w AS (PARTITION BY doc_id, s ORDER BY id))",
    f"SELECT doc_id, s, id, id + 1 AS head, 'nmod:poss' AS rel, {_NONE} AS upos FROM l WHERE free AND upos IN {_NOMINAL} AND NOT {_CASED} AND NOT list_contains(labels, 'TAMLAYAN') AND r_upos IN {_NOMINAL} AND r_owned "
    "AND NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = l.doc_id AND x.s = l.s AND x.rel = 'nmod:poss' AND x.head = l.id + 1)",
)(S.compound_noun)
_rule(
    f"SELECT doc_id, s, id, root AS head, 'advcl' AS rel, {_NONE} AS upos FROM rest WHERE {_has(_W['CONVERBS'])} OR regexp_matches(low, '{C.SHAPES['converb']}') OR upos = 'VERB' AND (list_contains(labels, 'DİLEK_ŞART') OR {_has(_W['PARTICIPLES'])} AND {_has(('BULUNMA', 'AYRILMA'))})"
)(S.converb)
_rule(
    _NEXT,
    f"SELECT a.doc_id, a.s, a.id, p.head, CASE WHEN regexp_matches(h.low, '{C.SHAPES['wanting']}') THEN 'xcomp' ELSE 'csubj' END AS rel, {_NONE} AS upos FROM rest a JOIN p USING (doc_id, s, id) JOIN s h ON h.doc_id = a.doc_id AND h.s = a.s AND h.id = p.head WHERE a.upos = 'VERB' AND list_contains(a.labels, 'MASTAR')",
)(S.infinitive)
_rule(_NEXT, f"SELECT doc_id, s, id, p.head, 'obl' AS rel, {_NONE} AS upos FROM rest JOIN p USING (doc_id, s, id) WHERE low IN {_in(_W['TIMES'])} AND len(path) = 0")(S.temporal)
_rule(f"SELECT doc_id, s, id, id - 1 AS head, 'advmod:emph' AS rel, {_NONE} AS upos FROM s WHERE free AND id > 1 AND low IN {_in(_W['EMPHASIS'])}")(S.emphasis)
_rule(
    _ahead("x", "free AND upos = 'ADJ' AND len(list_filter(path, lambda x: x NOT LIKE 'YAPIM\\_%' ESCAPE '\\')) = 0", "b.upos NOT IN ('DET', 'NUM', 'ADJ')", "true"),
    f"SELECT x.*, 'amod' AS rel, {_NONE} AS upos FROM x JOIN s h ON h.doc_id = x.doc_id AND h.s = x.s AND h.id = x.head AND h.upos IN ('NOUN', 'PROPN', 'VERB')",
)(S.adjective_or_adverb)
_rule(
    _NEXT,
    "l AS (SELECT *, lead(upos) OVER (PARTITION BY doc_id, s ORDER BY id) AS r_upos FROM s)",
    f"SELECT a.doc_id, a.s, a.id, CASE WHEN r_upos IN ('ADJ', 'ADV') THEN a.id + 1 ELSE p.head END AS head, 'advmod' AS rel, {_NONE} AS upos FROM rest a JOIN p USING (doc_id, s, id) JOIN l USING (doc_id, s, id) WHERE a.upos = 'ADV'",
)(S.adverb)
_rule(
    "j AS (SELECT doc_id, s, id, upos = 'CCONJ' AND coalesce(lead(upos) OVER (PARTITION BY doc_id, s ORDER BY id) IN ('ADJ', 'ADV'), false) AS joins FROM s)",
    _ahead("any_noun", "free", f"b.upos IN {_NOMINAL}", f"b.upos IN {_MODIFIERS} OR b.joins").replace("JOIN s b", "JOIN (SELECT * FROM s JOIN j USING (doc_id, s, id)) b"),
    _ahead("inflected", "free AND upos = 'ADJ'", f"{_nominal} AND (len(b.path) > 0 OR b.upos = 'VERB')", "CASE WHEN b.upos = 'CCONJ' THEN b.joins ELSE b.upos NOT IN ('VERB', 'ADP') END").replace("JOIN s b", "JOIN (SELECT * FROM s JOIN j USING (doc_id, s, id)) b"),
    f"SELECT a.doc_id, a.s, a.id, coalesce(inflected.head, any_noun.head) AS head, 'amod' AS rel, {_NONE} AS upos FROM s a LEFT JOIN any_noun USING (doc_id, s, id) LEFT JOIN inflected USING (doc_id, s, id) "
    f"WHERE a.free AND (a.upos = 'ADJ' OR a.upos = 'NOUN' AND regexp_matches(a.low, '{C.SHAPES['located']}')) AND coalesce(inflected.head, any_noun.head) IS NOT NULL",
)(S.adjective)
_rule(f"SELECT doc_id, s, id, root AS head, 'conj' AS rel, {_NONE} AS upos FROM rest WHERE upos = 'VERB' AND {_has(C.TENSE)} AND NOT {_has(_W['CONVERBS'] | _W['PARTICIPLES'])}")(S.more_predicates)
_rule(
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, head ORDER BY abs(id - head), id) AS k FROM s WHERE rel = 'obj')",
    f"SELECT doc_id, s, id, head, CASE WHEN {_OWNED} THEN 'nmod:poss' ELSE 'obl' END AS rel, {_NONE} AS upos FROM k WHERE k > 1",
)(S.one_object)
_rule(
    "f AS (SELECT s.doc_id, s.s, any_value(root) AS root, min(id) AS new FROM s JOIN r USING (doc_id, s) WHERE rel = 'conj' AND head = root AND id < root AND upos = 'VERB' AND comma GROUP BY ALL)",
    f"SELECT doc_id, s, id, CASE WHEN id = new THEN 0 ELSE new END AS head, CASE WHEN id = new THEN 'root' WHEN id = root THEN 'conj' ELSE rel END AS rel, {_NONE} AS upos FROM s JOIN f USING (doc_id, s) WHERE id IN (new, root) OR rel = 'conj' AND head = root",
)(S.first_root)


def token_features(spark, sf_dir):
    """The features of each word's labels."""
    from ..sources.conllu import feats_text

    out = given(spark, sf_dir).select("sent_id", "id", feats_text(R.features(F.col("suffixes"))).alias("feats"))
    return _digest(out, table(spark, sf_dir, "documents"), ("feats",))


#: Numerals stand for some forms in the query of their rule.
NUMERALS = ["iki", "12", "ikinci", "üç", "birer", "yüz"]


def rule_numeral(spark, sf_dir):
    """Numerals, alone and in chains; words of documents stand for their places."""
    k = F.pmod(F.col("id") * 5 + F.length("form"), F.lit(9)).cast("int")
    rows = given(spark, sf_dir).withColumn("form", F.coalesce(F.get(F.array(*[F.lit(x) for x in NUMERALS]), k), "form"))
    return _digest(R.RULES["numeral"](rows), table(spark, sf_dir, "documents"))


def _last(kind: dict) -> str:
    """The feature of the last label of a kind."""
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in kind.items())
    return f"MAP {{{pairs}}}[list_filter(labels, lambda x: x IN {_in(kind)})[-1]]"


_PERSONS, _NUMBERS = {k: v[0] for k, v in C.PERSON.items()}, {k: v[1] for k, v in C.PERSON.items()} | {"ÇOĞUL": "Plur"}
_FORMS_OF = {x: "Part" for x in _W["PARTICIPLES"]} | {x: "Conv" for x in _W["CONVERBS"]}
_FEATURES = [("Case", C.CASE), ("Number", _NUMBERS), ("Person", _PERSONS), ("Tense", C.TENSE), ("VerbForm", _FORMS_OF)]
QUERIES["token_features"] = token_features
ORACLES["token_features"] = (
    f"WITH {_S}, f AS (SELECT doc_id, s, id, {', '.join(f'{_last(kind)} AS f_{name}' for name, kind in _FEATURES)} FROM s), "
    f"g AS (SELECT doc_id, s, id, coalesce(nullif(concat_ws('|', {', '.join(f'{chr(39)}{name}={chr(39)} || f_{name}' for name, _ in _FEATURES)}), ''), '_') AS feats FROM f) "
    "SELECT doc_id, count(*) AS n, md5(string_agg(concat_ws(':', id, feats), chr(10) ORDER BY s, id)) AS digest FROM g GROUP BY doc_id"
)


QUERIES["rule_numeral"] = rule_numeral
_PAST = "OVER (PARTITION BY doc_id, s ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLES["rule_numeral"] = (
    f"WITH {_S.replace('s AS MATERIALIZED (SELECT doc_id, s, id, form, lower(form) AS low', 's AS MATERIALIZED (SELECT doc_id, s, id, coalesce([' + ', '.join(repr(x) for x in NUMERALS) + '][(id * 5 + length(form)) % 9 + 1], form) AS form, lower(coalesce([' + ', '.join(repr(x) for x in NUMERALS) + '][(id * 5 + length(form)) % 9 + 1], form)) AS low')}, "
    + _ahead("x", "true", f"b.upos IN {_NOMINAL}", "b.upos IN ('ADJ', 'NUM')")
    + f", m AS (SELECT s.*, x.head AS noun, free AND (low IN {_in(_W['NUMERALS'])} OR regexp_full_match(form, '[0-9]+')) AS mine, NOT (regexp_matches(low, '[ıiuü]nc[ıiuü]$') OR regexp_matches(low, '^(birer|ikişer|üçer|dörtler|beşer|altışar|yedişer|sekizer|dokuzar|onar|yirmişer)$')) AS counted FROM s LEFT JOIN x USING (doc_id, s, id)), "
    f"l AS (SELECT *, mine AND counted AND coalesce(last_value(CASE WHEN NOT mine THEN rel IN ('nummod', 'flat') AND upos = 'NUM' WHEN NOT counted THEN false WHEN noun IS NOT NULL THEN true END IGNORE NULLS) {_PAST}, false) AS flat FROM m), "
    f"c AS (SELECT *, last_value(CASE WHEN NOT flat THEN CASE WHEN NOT mine AND rel = 'flat' THEN head ELSE id END END IGNORE NULLS) {_PAST} AS chain FROM l), "
    "o AS (SELECT doc_id, s, id, CASE WHEN flat OR mine AND noun IS NOT NULL THEN 'NUM' ELSE upos END AS upos, CASE WHEN flat THEN chain WHEN mine AND noun IS NOT NULL THEN noun ELSE head END AS head, "
    "CASE WHEN flat THEN 'flat' WHEN mine AND noun IS NOT NULL THEN CASE WHEN counted THEN 'nummod' ELSE 'amod' END ELSE rel END AS rel FROM c) "
    "SELECT doc_id, count(*) AS n, md5(string_agg(concat_ws(':', id, upos, head, rel), chr(10) ORDER BY s, id)) AS digest FROM o GROUP BY doc_id"
)


def feature_columns(labels: str = "labels") -> str:
    """SQL of a word's features as text, from its labels."""
    return f"coalesce(nullif(concat_ws('|', {', '.join(f'{chr(39)}{name}={chr(39)} || ' + _last(kind).replace('labels', labels) for name, kind in _FEATURES)}), ''), '_')"
