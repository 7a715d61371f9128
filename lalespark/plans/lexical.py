"""Queries of what word lists and the dictionary decide about a word, and of texts made from analyses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glosses as G
from ..operators import annotate as A
from ..operators import evaluation as E
from ..operators import suffixes, tables, wordtests
from ..operators import wordclasses as C
from ..operators.search import analyze
from ..sources import conllu
from . import rules as R
from .base import DICTIONARY, SQL_VOWELS, lowered, parts, table, values
from .evaluation import _GOLD, gold
from .scalar import _LINE
from .sentence import _CHOSEN as CHOSEN
from .words import _ALL, _DICT, dictionary

QUERIES, ORACLES = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_TABLES = {k: tables.inverted(v) for k, v in (("aux", tables.AUXILIARIES), ("ordinal", tables.ORDINALS), ("post", tables.POSTPOSITIONS), ("pronoun", tables.PRONOUNS))}
#: The parts of speech under which each table's words are asked.
_ASKED = {"aux": ("AUX", "CCONJ"), "ordinal": ("NUM", "ADJ", "INTJ"), "post": ("NOUN", "NUM"), "pronoun": (None, "NOUN", "PRON", "AUX")}
_ASKED_ROWS = sorted({(w, tag) for k, t in _TABLES.items() for w in t for tag in _ASKED[k]} | {(w, "VERB") for w, r in _TABLES["aux"].items() if r == "değil"}, key=str)


_JOINS = " ".join(f"LEFT JOIN t_{k} ON t_{k}.word = q.word" for k in _TABLES)


@_query(
    f"WITH q(word, upos) AS (VALUES {values(_ASKED_ROWS)}), {', '.join(f't_{k}(word, r) AS (VALUES {values(sorted(t.items()))})' for k, t in _TABLES.items())} "
    f"SELECT q.word, q.upos, CASE WHEN q.upos = 'AUX' AND t_aux.r IS NOT NULL OR q.upos = 'VERB' AND t_aux.r = 'değil' THEN t_aux.r WHEN q.upos IN ('CCONJ', 'INTJ') THEN NULL "
    f"WHEN q.upos IN ('NUM', 'ADJ') AND t_ordinal.r IS NOT NULL THEN t_ordinal.r WHEN q.upos IN ('NOUN', 'NUM') AND t_post.r IS NOT NULL THEN t_post.r ELSE t_pronoun.r END AS root FROM q {_JOINS}"
)
def analyze_fixed(spark, sf_dir):
    """Words of the tables of auxiliaries, ordinals, postpositions and pronouns by part of speech. Without a dictionary only
    these tables give roots."""
    return analyze(spark.createDataFrame(_ASKED_ROWS, "word string, upos string")).filter("rank = 1").select("word", "upos", "root")


_ENDINGS = "an en yan yen man men mayan meyen amayan ar dan den tan ten ndan nden lardan lerden larından lerinden sından sinden dır dir dur dür tır tir lı li lu lü sız siz suz süz sal sel ımsı imsi lar mış ma me acaktır ecektir".split()
_ROOTS = sorted({w.removesuffix("mak").removesuffix("mek") for w in DICTIONARY} | set(DICTIONARY))
_HARD = "translate(right(x, 1), 'dgğcb', 'tkkçp')"
_ABLATIVE_LENGTHS = ", ".join(f"({k}, '{p}', {len(p.replace('[ae]', 'a').replace('[ıiuü]', 'ı')) - 1})" for k, p in enumerate(C.ABLATIVES))


@_query(
    f"""WITH {_DICT}, v AS (SELECT DISTINCT left(word, length(word) - 3) AS x FROM dict WHERE regexp_matches(word, 'm[ae]k$')), nouns AS (SELECT word AS x FROM dict WHERE NOT regexp_matches(word, 'm[ae]k$')),
f AS (SELECT word AS w FROM low UNION SELECT r || e FROM (VALUES {values((x,) for x in _ROOTS)}) AS r(r), (VALUES {values((x,) for x in _ENDINGS)}) AS e(e)),
s AS (SELECT w, left(w, length(w) - 2) AS x FROM f WHERE length(w) >= 4 AND regexp_matches(w, '[ae]n$') UNION SELECT w, left(w, length(w) - 3) FROM f WHERE length(w) > 4 AND regexp_matches(w, 'y[ae]n$')),
c AS (SELECT w, x FROM s UNION SELECT w, left(x, length(x) - 2) FROM s WHERE regexp_matches(x, '(ma|me)$') AND length(x) > 3 UNION SELECT w, left(x, length(x) - 3) FROM s WHERE regexp_matches(x, '(ama|eme)$') AND length(x) > 4),
part AS (SELECT DISTINCT w FROM c WHERE length(x) >= 2 AND (x IN (SELECT x FROM v) OR length(x) <= 3 AND contains('dgğcb', right(x, 1)) AND left(x, length(x) - 1) || {_HARD} IN (SELECT x FROM v))),
ab AS (SELECT w, k, left(w, length(w) - n) AS x, substr(w, length(w) - n + 1, 1) AS t FROM f, (VALUES {_ABLATIVE_LENGTHS}) AS a(k, p, n) WHERE length(w) >= 5 AND NOT regexp_matches(w, 'm[ae]d[ae]n$') AND regexp_matches(w, p)),
ab1 AS (SELECT w, arg_min(x, k) AS x, arg_min(t, k) AS t FROM ab WHERE length(x) >= 2 AND x IN (SELECT x FROM nouns) GROUP BY w),
abl AS (SELECT w FROM ab1 WHERE NOT (x IN (SELECT x FROM v) OR t = 't' AND x || 't' IN (SELECT x FROM v)) AND NOT (length(x) >= 4 AND regexp_matches(x, '(ma|me)$') AND left(x, length(x) - 2) IN (SELECT x FROM v))),
d AS (SELECT w, regexp_extract(w, '^(.+?)([dt][ıiuü]r)$', 1) AS x FROM f),
dir AS (SELECT w FROM d WHERE x <> '' AND x <> 'değil' AND x IN (SELECT x FROM nouns) AND x NOT IN (SELECT x FROM v) AND NOT regexp_matches(x, '{C.SHAPES['future']}')),
amb AS (SELECT w FROM f WHERE w IN (SELECT x FROM v) OR w || 'la' IN (SELECT x FROM v) OR w || 'le' IN (SELECT x FROM v) OR w || 'etmek' IN (SELECT word FROM dict) OR w || 'olmak' IN (SELECT word FROM dict)
  OR regexp_matches(w, '(ma|me)$') AND length(w) > 3 AND left(w, length(w) - 2) IN (SELECT x FROM v) OR regexp_matches(w, '[ıiuü]ş$') OR w IN ('değil', 'uçar', 'eder'))
SELECT w AS word, w IN (SELECT w FROM part) AS participle, w IN (SELECT w FROM abl) AS ablative, w IN (SELECT w FROM dir) AS nominal_dir, w IN (SELECT w FROM amb) AS ambiguous,
  coalesce(nullif(regexp_extract(w, '^(...+)l[ıiuü]$', 1), ''), nullif(regexp_extract(w, '^(..+)s[ıiuü]z$', 1), ''), nullif(regexp_extract(w, '^(...+)s[ae]l$', 1), ''), nullif(regexp_extract(w, '^(...+)[ıiuü]ms[ıiuü]$', 1), '')) AS adjective_base FROM f"""
)
def word_tests(spark, sf_dir):
    """What the parser asks of a form: participle in -An, noun in the ablative, noun with -DIr, possible verb base, base of a
    derived adjective. Over the words of documents and over Turkish roots with endings."""
    roots, ends = (spark.createDataFrame([(x,) for x in own], f"{c} string") for own, c in ((_ROOTS, "r"), (_ENDINGS, "e")))
    made = roots.join(F.broadcast(ends), F.lit(True)).select(F.concat("r", "e").alias("word"))
    return wordtests.word_tests(lowered(spark, sf_dir).unionByName(made), dictionary(spark, sf_dir))


_W = {k: C.words(v) for k, v in vars(C).items() if isinstance(v, str) and k.isupper()}
#: Lists that decide whatever the word's suffixes, in the order in which they are asked; the lists between decide bare words only.
_ANY = (("PRONOUNS", "PRON"), ("QUESTIONS", "AUX"), ("ALWAYS_CONJUNCTIONS", "CCONJ"), ("ADVERBS", "ADV"), ("VERB_FORMS", "VERB"), ("NOUNS", "NOUN"))
_BARE = _W["FOCUS"] | _W["SUBORDINATORS"] | _W["INTERJECTIONS"] | _W["DETERMINERS"] | _W["CONJUNCTIONS"] | _W["CASE_POSTPOSITIONS"] | _W["NUMERALS"]
_LISTED = sorted((set().union(*(_W[k] for k, _ in _ANY)) - _BARE) | _W["PRONOUNS"] | _W["QUESTIONS"])
_BY_LIST = " ".join(f"WHEN w IN ({', '.join(repr(x) for x in sorted(_W[k]))}) THEN '{tag}'" for k, tag in _ANY)


@_query(f"SELECT w AS word, CASE {_BY_LIST} END AS upos, true AS ok FROM (VALUES {values((x,) for x in _LISTED)}) AS t(w)")
def compare_listed(spark, sf_dir):
    """Words of the lists, each as a sentence of its own, against the part of speech that the lists give."""
    expected = F.coalesce(*[F.when(F.col("word").isin(*sorted(_W[k])), tag) for k, tag in _ANY])
    words = spark.createDataFrame([(x,) for x in _LISTED], "word string")
    return E.compared(words.select("word", F.lit(None).cast("string").alias("lemma"), expected.alias("upos"))).select("word", F.col("upos").alias("upos"), F.col("upos_ok").alias("ok"))


_TAGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in G.TAGS.items()) + "}"
_PIECE = "array_to_string(list_transform(path, lambda x: '{}' || {}), '')"
_TAG = f"coalesce({_TAGS}[x], x)"


def _analyses(spark, sf_dir):
    return R.given(spark, sf_dir).select("sent_id", "id", F.col("form").alias("word"), F.col("lemma").alias("stem"), F.when(F.col("id") % 3 == 0, F.concat("lemma", F.lit("k"))).alias("root"), F.lit(None).cast("string").alias("lemma"), "suffixes")


_ANALYSES = f"{R._S}, a AS (SELECT *, lemma AS stem, CASE WHEN id % 3 = 0 THEN lemma || 'k' ELSE lemma END AS base, form AS word FROM s)"
_TAGGED, _SEGMENTED, _GLOSS = (f"base || {_PIECE.format(*x)}" for x in (("+", _TAG), ("-", "'x'"), ("-", f"upper({_TAG})")))


@_query(f"WITH {_ANALYSES} SELECT word, {_TAGGED} AS tagged, {_SEGMENTED} AS segmented, {_GLOSS} AS gloss, count(*) AS n FROM a GROUP BY ALL")
def gloss_given(spark, sf_dir):
    """Tags, segments and gloss of analyses made by arithmetic."""
    c = [F.col(x) for x in ("root", "stem", "suffixes")]
    return _analyses(spark, sf_dir).groupBy("word", G.tagged(*c).alias("tagged"), G.segmented(*c).alias("segmented"), G.gloss(*c).alias("gloss")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"WITH {_ANALYSES}, l AS (SELECT doc_id, s, id, (id - 1) // 5 AS chunk, {_SEGMENTED} AS seg, {_GLOSS} AS g FROM a), p AS (SELECT *, CAST(greatest(length(seg), length(g)) + 1 AS INTEGER) AS n FROM l), "
    "c AS (SELECT doc_id, s, chunk, string_agg(rpad(seg, n, ' '), '' ORDER BY id) AS segments, string_agg(rpad(g, n, ' '), '' ORDER BY id) AS glosses FROM p GROUP BY ALL) SELECT segments, glosses, count(*) AS n FROM c GROUP BY ALL"
)
def interlinear_given(spark, sf_dir):
    # Nearly all lines differ: together they are larger than the texts.
    lines = G.interlinear(_analyses(spark, sf_dir)).repartition(parts(table(spark, sf_dir, "documents")), "segments", "glosses")
    return lines.groupBy("segments", "glosses").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"WITH {_ANALYSES}, k AS (SELECT doc_id || '-' || s AS word, id AS rank, {_TAGGED} AS t FROM a WHERE id <= 3), "
    "wide AS (SELECT word, coalesce(any_value(t) FILTER (WHERE rank = 1), '—') AS candidate_1, coalesce(any_value(t) FILTER (WHERE rank = 2), '—') AS candidate_2, coalesce(any_value(t) FILTER (WHERE rank = 3), '—') AS candidate_3 FROM k GROUP BY word) "
    "SELECT candidate_1, candidate_2, candidate_3, count(*) AS n FROM wide GROUP BY ALL"
)
def ambiguity_given(spark, sf_dir):
    """Side by side: the words of a sentence stand for the analyses of a word."""
    rows = _analyses(spark, sf_dir).select(F.col("sent_id").alias("word"), F.col("id").alias("rank"), "stem", "root", "lemma", "suffixes")
    return G.ambiguity(rows).groupBy("candidate_1", "candidate_2", "candidate_3").agg(F.count(F.lit(1)).alias("n"))


_BODY = (
    "'  Kök    : ' || base || CASE WHEN id % 4 = 0 THEN chr(10) || '  Lemma  : ' || stem || 'mak' ELSE '' END || chr(10) || '  Ekler  : ' "
    "|| CASE WHEN len(path) > 0 THEN array_to_string(list_transform(path, lambda x: '-x (' || x || ')'), ' + ') ELSE '(ek bulunamadı)' END || chr(10) || '  Ayrım  : ' || array_to_string(list_concat([stem], list_transform(path, lambda x: 'x')), ' + ')"
)
_HARMONY = f"CASE WHEN len(v) < 2 THEN '  (tek ünlülü sözcük – uyum kontrolü gerekmez)' ELSE array_to_string(list_transform(range(1, len(v)), lambda i: {_LINE}), chr(10)) END"


@_query(
    f"WITH {_ANALYSES}, k AS (SELECT {R.FORMS}[s % {len(R.FORMS)} + 1] || '_' || doc_id || '-' || s AS word, id, {_BODY} AS body FROM a WHERE id <= CASE WHEN s % 3 = 0 THEN 1 ELSE 4 END), "
    f"g AS (SELECT word, count(*) AS n, any_value(body) AS one, string_agg('  ── Çözümleme ' || id || ' {'─' * 30}' || chr(10) || body || chr(10), chr(10) ORDER BY id) AS many, {SQL_VOWELS.format(w='word')} AS v FROM k GROUP BY word) "
    "SELECT word, md5('  Sözcük : ' || word || chr(10) || CASE WHEN n = 1 THEN one || chr(10) ELSE '  ⚠ ' || n || ' olası çözümleme (doğru olan bağlama göre belirlenir)' || chr(10) || chr(10) || many || chr(10) END "
    f"|| '  Uyum   :' || chr(10) || {_HARMONY} || chr(10)) AS report FROM g"
)
def reports_given(spark, sf_dir):
    """Reports of one or of several analyses; a sentence's words stand for the analyses of a word that is named by it."""
    place = F.substring_index("sent_id", "-", -1).cast("int")
    rows = _analyses(spark, sf_dir).withColumns({"lemma": F.when(F.col("id") % 4 == 0, F.concat("stem", F.lit("mak"))), "word": F.concat(F.get(F.array(*[F.lit(x) for x in R.FORMS]), place % len(R.FORMS)), F.lit("_"), F.col("sent_id"))})
    rows = rows.filter(F.col("id") <= F.when(place % 3 == 0, 1).otherwise(4))
    return G.reports(rows.withColumnRenamed("id", "rank")).select("word", F.md5("report").alias("report"))


@_query(f"WITH {_GOLD} SELECT upos, count(*) AS n, CAST(sum(length(form)) AS BIGINT) AS chars, count(DISTINCT lemma) AS lemmas FROM gold GROUP BY upos")
def conllu_flat(spark, sf_dir):
    """Words read line by line from the CoNLL-U text of gold, with comments, ranges and empty nodes among them."""
    lines = conllu.blocks(gold(spark, sf_dir)).select(F.explode(F.split("block", "\n")).alias("value"))
    odd = spark.createDataFrame([("# text = a",), ("1-2\tab\t_\t_\t_\t_\t_\t_\t_\t_",), ("1.1\ta\ta\tX\t_\t_\t_\t_\t_\t_",), ("1\tshort\tX",), ("",)], "value string")
    rows = conllu.flat_tokens(lines.unionByName(odd))
    return rows.groupBy("upos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars"), F.countDistinct("lemma").alias("lemmas"))


_OWN = [("{D}{A}ş", "ORTAK", 2, False), ("sal{I}", "OZEL", 3, True)]


@_query(
    "SELECT d || a || 'ş' AS form, 'ORTAK' AS label, CAST(2 AS INTEGER) AS min_stem, false AS exempt FROM (VALUES ('d'), ('t')) AS d(d), (VALUES ('a'), ('e')) AS a(a) "
    "UNION ALL SELECT 'sal' || i, 'OZEL', 3, true FROM (VALUES ('ı'), ('i'), ('u'), ('ü')) AS i(i)"
)
def suffix_register(spark, sf_dir):
    """A caller's own suffixes beside the default ones."""
    extra = spark.createDataFrame(_OWN, "template string, label string, min_stem int, exempt boolean")
    return suffixes.table(spark, extra).filter(F.col("label").isin("ORTAK", "OZEL"))


# Reranking: each word has up to four candidates, whose labels come from those of words further on.
_RANKED = 4
_NEAR = {k: "(" + ", ".join(f"'{w}'" for w in sorted(C.words(v))) + ")" for k, v in (("det", C.DETERMINERS), ("adj", C.NEAR_ADJECTIVES), ("post", C.NEAR_POSTPOSITIONS), ("num", C.NEAR_NUMERALS), ("conj", C.NEAR_CONJUNCTIONS))}
_WORDS = "bir bu güzel yeni iki üç ev kitap geldi gördü için gibi mi mu ve ama ele aldı göz önünde ardında çocuk okul koşarak benim evin".split()


def _candidates(spark, sf_dir):
    rows = R.given(spark, sf_dir).withColumn("k", F.pmod(F.length("form") * 3 + F.col("id") * 5 + F.size("suffixes") * 2 + F.length("lemma"), F.lit(len(_WORDS))))
    path = lambda own: F.array(*[F.struct(F.lit("x").alias("form"), F.lit(x).alias("label")) for x in own]).cast("array<struct<form:string,label:string>>")
    sets = F.array(*map(path, R.LABELS))
    form = F.get(F.array(*[F.lit(x) for x in _WORDS]), F.col("k").cast("int"))
    one = lambda c: F.struct(F.when(F.lit(c) == 2, F.lit("el")).otherwise(F.col("lemma")).alias("stem"), F.get(sets, F.pmod(F.col("k") * 7 + F.col("id") * c + c * 3, F.lit(len(R.LABELS))).cast("int")).alias("suffixes"))
    found = F.slice(F.array(*map(one, range(_RANKED))), F.lit(1), F.pmod(F.col("k") + F.col("id"), F.lit(_RANKED)) + 1)
    return rows.select("sent_id", "id", form.alias("form"), found.alias("candidates"))


_POSS, _CONV = (f"[{', '.join(repr(x) for x in sorted(C.words(v)))}]" for v in (C.POSSESSIVES, C.CONVERBS))
_FINAL = f"[{', '.join(repr(x) for x in sorted(tables.VERB_FINAL))}]"
_SPLIT = "CAST(flatten(list_transform({}, lambda y: string_split(y, '/'))) AS VARCHAR[])"
_RERANK = f"""WITH RECURSIVE {R._S},
q AS (SELECT doc_id, s, id, lemma, (length(form) * 3 + id * 5 + len(path) * 2 + length(lemma)) % {len(_WORDS)} AS k FROM s),
words AS MATERIALIZED (SELECT doc_id, s, id, lemma, k, {_WORDS}[k + 1] AS form, coalesce(lag(form) OVER w, '') AS before, coalesce(lead(form) OVER w, '') AS after, id = 1 AS first, lead(id) OVER w IS NULL AS last FROM q WINDOW w AS (PARTITION BY doc_id, s ORDER BY id)),
c0 AS (SELECT words.*, c, CASE WHEN c = 2 THEN 'el' ELSE lemma END AS stem, {R.LABELS}[CAST((k * 7 + id * c + c * 3) % {len(R.LABELS)} AS INTEGER) + 1] AS path FROM words, unnest(range(0, {_RANKED})) AS u(c) WHERE c <= (k + id) % {_RANKED}),
c AS MATERIALIZED (SELECT *, {_SPLIT.format('path')} AS parts, list_has_any({_SPLIT.format('path[-2:]')}, {_FINAL}) AS fin, coalesce(path[-1], '') AS tail, count(*) OVER (PARTITION BY doc_id, s, id) AS n FROM c0),
walk AS (
  SELECT doc_id, s, 0 AS id, -1 AS c, CAST([] AS VARCHAR[]) AS parts, false AS fin, '' AS tail UNION ALL
  SELECT doc_id, s, id, c, parts, fin, tail FROM (
    SELECT c.doc_id, c.s, c.id, c.c, c.parts, c.fin, c.tail, row_number() OVER (PARTITION BY c.doc_id, c.s ORDER BY CASE WHEN c.n = 1 THEN 0 ELSE -c.c
      + CASE WHEN before IN {_NEAR['det']} THEN CASE WHEN c.fin THEN -4 ELSE 3 END WHEN before IN {_NEAR['adj']} THEN CASE WHEN c.fin THEN 0 ELSE 0.5 END WHEN contains(r.tail, 'SIFAT_FİİL') THEN CASE WHEN c.fin THEN 0 ELSE 0.3 END ELSE 0 END
      + CASE WHEN r.fin AND NOT before IN {_NEAR['conj']} AND c.fin THEN -3 ELSE 0 END
      + CASE WHEN contains(r.tail, 'TAMLAYAN') AND list_has_any(c.parts, {_POSS}) THEN 3 ELSE 0 END
      + CASE WHEN after IN {_NEAR['post']} THEN CASE WHEN c.fin THEN -1.5 ELSE 2 END ELSE 0 END
      + CASE WHEN after IN ('mi', 'mı', 'mu', 'mü') AND c.fin THEN 2 ELSE 0 END
      + CASE WHEN before IN {_NEAR['num']} THEN CASE WHEN c.fin THEN -1.5 ELSE 2 END ELSE 0 END
      + CASE WHEN list_has_any(r.parts, {_CONV}) AND c.fin THEN 2 ELSE 0 END
      + CASE WHEN list_contains(r.parts, 'İSİM_FİİL') AND NOT c.fin THEN 1.5 ELSE 0 END
      + CASE WHEN list_contains(r.parts, 'YÖNELME') AND c.fin THEN 1 ELSE 0 END
      + CASE WHEN form = 'ele' AND starts_with(after, 'al') AND c.stem = 'el' AND list_contains(c.parts, 'YÖNELME') THEN 3 ELSE 0 END
      + CASE WHEN form = 'göz' AND (starts_with(after, 'önün') OR starts_with(after, 'ardı')) AND NOT c.fin THEN 2 ELSE 0 END
      + CASE WHEN list_contains(r.parts, 'BELIRTME') AND c.fin THEN 1.5 ELSE 0 END
      + CASE WHEN list_has_any(r.parts, {_POSS}) AND (list_has_any(c.parts, {_POSS}) OR contains(c.tail, 'TAMLAYAN')) THEN 1 ELSE 0 END
      + CASE WHEN last AND c.fin THEN 1 ELSE 0 END + CASE WHEN first AND NOT c.fin THEN 0.5 ELSE 0 END END DESC, c.c) AS best
    FROM walk r JOIN c ON c.doc_id = r.doc_id AND c.s = r.s AND c.id = r.id + 1) WHERE best = 1)
SELECT doc_id, count(*) AS n, md5(string_agg(concat_ws(':', id, c + 1), chr(10) ORDER BY s, id)) AS digest FROM walk WHERE id > 0 GROUP BY doc_id"""
_RERANK = _RERANK.replace("SELECT doc_id, s, 0 AS id, -1 AS c", "SELECT DISTINCT doc_id, s, 0 AS id, CAST(-1 AS BIGINT) AS c").replace("'' AS tail UNION ALL", "'' AS tail FROM words UNION ALL")


@_query(_RERANK)
def rerank_given(spark, sf_dir):
    """The candidate that each word takes in context, from left to right; the SQL walks the sentences step by step."""
    return R._digest(A.rerank(_candidates(spark, sf_dir)), table(spark, sf_dir, "documents"), ("chosen",))


_READ = f"{_ALL}, g AS (SELECT *, coalesce(root, stem) AS b FROM out WHERE rank = 1)"
_OF = "b || array_to_string(list_transform({}, lambda x: '{}' || {}), '')"
ORACLES["gloss"] = f"{_READ} SELECT word, {_OF.format('ls', '+', _TAG)} AS tagged, {_OF.format('fs', '-', 'x')} AS segmented, {_OF.format('ls', '-', f'upper({_TAG})')} AS gloss FROM g"
_AT = "coalesce(any_value(t) FILTER (WHERE rank = {}), '—') AS candidate_{}"
ORACLES["ambiguity"] = f"{_ALL}, g AS (SELECT word, rank, coalesce(root, stem) AS b, ls FROM out), k AS (SELECT word, rank, {_OF.format('ls', '+', _TAG)} AS t FROM g) SELECT word, {', '.join(_AT.format(k, k) for k in (1, 2, 3))} FROM k GROUP BY word"

_BODY_OF = (
    "'  Kök    : ' || b || CASE WHEN lemma IS NOT NULL AND lemma <> b THEN chr(10) || '  Lemma  : ' || lemma ELSE '' END || chr(10) || '  Ekler  : ' "
    "|| CASE WHEN len(ls) > 0 THEN array_to_string(list_transform(range(1, len(ls) + 1), lambda j: '-' || fs[j] || ' (' || ls[j] || ')'), ' + ') ELSE '(ek bulunamadı)' END "
    "|| chr(10) || '  Ayrım  : ' || array_to_string(list_concat([stem], fs), ' + ')"
)
ORACLES["word_reports"] = (
    f"{_ALL}, k AS (SELECT word, rank, {_BODY_OF} AS body FROM (SELECT *, coalesce(root, stem) AS b FROM out)), "
    f"g AS (SELECT word, count(*) AS n, any_value(body) AS one, string_agg('  ── Çözümleme ' || rank || ' {'─' * 30}' || chr(10) || body || chr(10), chr(10) ORDER BY rank) AS many, {SQL_VOWELS.format(w='word')} AS v FROM k GROUP BY word) "
    "SELECT word, '  Sözcük : ' || word || chr(10) || CASE WHEN n = 1 THEN one || chr(10) ELSE '  ⚠ ' || n || ' olası çözümleme (doğru olan bağlama göre belirlenir)' || chr(10) || chr(10) || many || chr(10) END "
    f"|| '  Uyum   :' || chr(10) || {_HARMONY} || chr(10) AS report FROM g"
)
#: Lines of five words, each as wide as the longer of its two texts.
ORACLES["interlinear"] = (
    f"{CHOSEN}, l AS (SELECT sent_id, w.id, CAST((w.id - 1) // 5 AS INTEGER) AS chunk, {_OF.format('fs', '-', 'x')} AS seg, {_OF.format('ls', '-', f'upper({_TAG})')} AS g "
    "FROM (SELECT w.*, fs, ls, coalesce(root, o.stem) AS b FROM walk w JOIN out o ON o.word = w.form AND o.rank = w.c + 1 WHERE w.id > 0) w), p AS (SELECT *, CAST(greatest(length(seg), length(g)) + 1 AS INTEGER) AS n FROM l) "
    "SELECT sent_id, chunk, string_agg(rpad(seg, n, ' '), '' ORDER BY id) AS segments, string_agg(rpad(g, n, ' '), '' ORDER BY id) AS glosses FROM p GROUP BY ALL"
)
