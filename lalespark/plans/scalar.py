"""Queries of string functions over the words and texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import harmony as H
from ..functions import phonology as P
from ..functions import tokens as T
from .base import SQL_FIRST, SQL_LAST, SQL_LOWER, SQL_VOWELS, SQL_WORDS, TOKEN, V, lowered, sql_consonant, sql_major, sql_minor, sql_syllables, table, words

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


_NUCLEI = f"list_filter(list_transform(syl, lambda s: regexp_extract(s, '[{V}]')), lambda v: v <> '')"
_SYL = f"WITH {SQL_LOWER}, syls AS (SELECT word, {sql_syllables('word')} AS syl FROM low), nuc AS (SELECT word, syl, {_NUCLEI} AS n FROM syls)"
_SPLIT = f"WITH {SQL_LOWER}, s AS (SELECT left(word, length(word) - 2) AS stem, right(word, 2) AS suffix FROM low WHERE length(word) >= 3), v AS (SELECT *, {SQL_LAST.format(w='stem')} AS a, {SQL_FIRST.format(w='suffix')} AS b FROM s)"


def _split(spark, sf_dir):
    """Words cut into a stem and its last two letters."""
    return lowered(spark, sf_dir).filter(F.length(F.col("word")) >= 3).select(F.expr("left(word, length(word) - 2)").alias("stem"), F.expr("right(word, 2)").alias("suffix"))


@_query("turkish_lower", f"WITH {SQL_WORDS} SELECT word, lower(translate(word, 'İI', 'iı')) AS lower_word FROM words")
def turkish_lower(spark, sf_dir):
    return words(spark, sf_dir).select("word", P.turkish_lower(F.col("word")).alias("lower_word"))


@_query("vowels", f"WITH {SQL_LOWER} SELECT word, array_to_string({SQL_VOWELS.format(w='word')}, '') AS vowels, CAST(len({SQL_VOWELS.format(w='word')}) AS INTEGER) AS n FROM low")
def vowels(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", F.array_join(P.vowels(F.col("word")), "").alias("vowels"), F.size(P.vowels(F.col("word"))).alias("n"))


@_query("last_vowel", f"WITH {SQL_LOWER} SELECT word, {SQL_LAST.format(w='word')} AS last_vowel FROM low")
def last_vowel(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", P.last_vowel(F.col("word")).alias("last_vowel"))


def _classes():
    names = ("BACK", "FRONT", "UNROUNDED", "ROUNDED", "OPEN", "CLOSE", "CONSONANTS", "VOICELESS", "SONORANT_SIBILANT", "VOWELS")
    return {n.lower(): getattr(P, n) for n in names}


@_query(
    "letter_classes",
    f"WITH {SQL_LOWER}, l AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(word, '')) AS c FROM low) GROUP BY c) SELECT c AS letter, n, " + ", ".join(f"contains('{v}', c) AS is_{k}" for k, v in _classes().items()) + " FROM l",
)
def letter_classes(spark, sf_dir):
    """Letters of the distinct words, how often each comes, and its classes."""
    each = lowered(spark, sf_dir).select(F.explode(F.split(F.col("word"), "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    return each.select("letter", "n", *[P.is_in(F.col("letter"), v).alias(f"is_{k}") for k, v in _classes().items()])


@_query("syllabify", _SYL + " SELECT word, array_to_string(syl, '-') AS syllables, CAST(len(syl) AS INTEGER) AS n FROM nuc")
def syllabify(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", F.array_join(P.syllables(F.col("word")), "-").alias("syllables"), F.size(P.syllables(F.col("word"))).alias("n"))


@_query("nuclei", _SYL + " SELECT word, array_to_string(n, '') AS nuclei FROM nuc")
def nuclei(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", F.array_join(P.nuclei(F.col("word")), "").alias("nuclei"))


@_query("loanword", _SYL + " SELECT word, len(list_filter(n[2:], lambda v: v IN ('o', 'ö'))) > 0 AS loanword FROM nuc")
def loanword(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", P.is_loanword_candidate(F.col("word")).alias("loanword"))


@_query("stem_valid", f"WITH {SQL_LOWER} SELECT word, regexp_matches(word, '[{V}]') AND NOT regexp_matches(word, '[{P.CONSONANTS}]{{3}}$') AND (NOT regexp_matches(word, '[{P.CONSONANTS}]{{2}}$') OR contains('{P.SONORANT_SIBILANT}', word[-2])) AS valid FROM low")
def stem_valid(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", P.is_valid_stem(F.col("word")).alias("valid"))


@_query("major_harmony", _SPLIT + f" SELECT stem, suffix, {sql_major('a', 'b')} AS ok FROM v")
def major_harmony(spark, sf_dir):
    return _split(spark, sf_dir).select("stem", "suffix", H.major(P.last_vowel(F.col("stem")), P.first_vowel(F.col("suffix"))).alias("ok"))


@_query("minor_harmony", _SPLIT + f" SELECT stem, suffix, {sql_minor('a', 'b')} AS ok FROM v")
def minor_harmony(spark, sf_dir):
    return _split(spark, sf_dir).select("stem", "suffix", H.minor(P.last_vowel(F.col("stem")), P.first_vowel(F.col("suffix"))).alias("ok"))


@_query("vowel_harmony", _SPLIT + f" SELECT stem, suffix, {sql_major('a', 'b')} AND {sql_minor('a', 'b')} AS strict, {sql_minor('a', 'b')} AS relaxed FROM v")
def vowel_harmony(spark, sf_dir):
    s, x = F.col("stem"), F.col("suffix")
    return _split(spark, sf_dir).select("stem", "suffix", H.STRICT.vowels(s, x).alias("strict"), H.RELAXED.vowels(s, x).alias("relaxed"))


@_query("consonant_harmony", _SPLIT + f" SELECT stem, suffix, {sql_consonant('stem', 'suffix')} AS ok FROM v")
def consonant_harmony(spark, sf_dir):
    return _split(spark, sf_dir).select("stem", "suffix", H.STRICT.consonants(F.col("stem"), F.col("suffix")).alias("ok"))


_PAIRS = _SYL + f", pr AS (SELECT word, n, list_transform(range(1, greatest(len(n), 1)), lambda i: {{'pos': i - 1, 'v1': n[i], 'v2': n[i + 1], 'buu': {sql_major('n[i]', 'n[i + 1]')}, 'kuu': {sql_minor('n[i]', 'n[i + 1]')}}}) AS p FROM nuc)"


@_query(
    "internal_harmony",
    _PAIRS + " SELECT word, len(list_filter(p, lambda x: NOT x.buu)) = 0 AS buu_ok, len(list_filter(p, lambda x: NOT x.kuu)) = 0 AS kuu_ok, len(list_filter(p, lambda x: NOT (x.buu AND x.kuu))) = 0 AS full_ok, "
    "array_to_string(list_transform(list_filter(p, lambda x: NOT (x.buu AND x.kuu)), lambda x: x.pos || x.v1 || x.v2), ' ') AS violations FROM pr",
)
def internal_harmony(spark, sf_dir):
    r = F.col("r")
    out = lowered(spark, sf_dir).select("word", H.internal(F.col("word")).alias("r"))
    return out.select("word", r["buu_ok"].alias("buu_ok"), r["kuu_ok"].alias("kuu_ok"), r["full_ok"].alias("full_ok"), F.array_join(F.transform(r["violations"], lambda v: F.concat(v["pos"].cast("string"), v["v1"], v["v2"])), " ").alias("violations"))


def _kind(v: str) -> str:
    return f"{v} || ' (' || CASE WHEN contains('{P.BACK}', {v}) THEN 'kalın' ELSE 'ince' END || ', ' || CASE WHEN contains('{P.UNROUNDED}', {v}) THEN 'düz' ELSE 'yuvarlak' END || ')'"


def _mark(ok: str) -> str:
    return f"CASE WHEN {ok} THEN '✓' ELSE '✗' END"


_LINE = f"'  ' || {_kind('v[i]')} || ' → ' || {_kind('v[i + 1]')} || '  BÜU:' || {_mark(sql_major('v[i]', 'v[i + 1]'))} || '  KÜU:' || {_mark(sql_minor('v[i]', 'v[i + 1]'))}"


@_query(
    "harmony_report",
    f"WITH {SQL_LOWER}, vs AS (SELECT word, {SQL_VOWELS.format(w='word')} AS v FROM low) SELECT word, CASE WHEN len(v) < 2 THEN '  (tek ünlülü sözcük – uyum kontrolü gerekmez)' ELSE array_to_string(list_transform(range(1, len(v)), lambda i: {_LINE}), chr(10)) END AS report FROM vs",
)
def harmony_report(spark, sf_dir):
    return lowered(spark, sf_dir).select("word", H.report(F.col("word")).alias("report"))


@_query("tokenize", f"SELECT doc_id, CAST(i AS INTEGER) AS pos, t[i + 1] AS word FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents), unnest(range(0, len(t))) AS u(i)")
def tokenize(spark, sf_dir):
    return T.token_rows(table(spark, sf_dir, "documents"))


@_query("clean_words", "WITH w AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')), '[.,;:!?\"()\\[\\]…—–'']', '', 'g') AS x FROM documents) SELECT doc_id, count(*) AS n FROM w WHERE x <> '' GROUP BY doc_id")
def clean_words(spark, sf_dir):
    words_ = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.clean_words(F.col("text"))).alias("w"))
    return words_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query("sentence_split", "SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1␞', 'g'), '␞') AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "\n")).alias("digest"))


@_query(
    "comma_flags",
    "SELECT doc_id, CAST(len(g) AS INTEGER) AS n_tokens, CAST(len(list_filter(g[1 : len(g) - 1], lambda x: contains(x, ','))) AS INTEGER) AS n_commas FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_''’]+([^\\p{L}\\p{N}_''’]*)', 1) AS g FROM documents)",
)
def comma_flags(spark, sf_dir):
    f = T.comma_flags(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(f).alias("n_tokens"), F.size(F.filter(f, lambda x: x)).alias("n_commas"))


@_query(
    "harmony_by_lang",
    f"WITH t AS (SELECT lang, lower(translate(unnest(regexp_extract_all(text, '{TOKEN}')), 'İI', 'iı')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM t GROUP BY ALL), "
    f"s AS (SELECT lang, n, {sql_syllables('word')} AS syl FROM c), u AS (SELECT lang, n, len(syl) AS k, {_NUCLEI} AS v FROM s), "
    f"h AS (SELECT lang, n, k, len(list_filter(range(1, greatest(len(v), 1)), lambda i: NOT ({sql_major('v[i]', 'v[i + 1]')} AND {sql_minor('v[i]', 'v[i + 1]')}))) = 0 AS ok FROM u) "
    "SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS harmonic, CAST(sum(n * k) AS BIGINT) AS syllables FROM h GROUP BY lang",
)
def harmony_by_lang(spark, sf_dir):
    """Tokens, harmonic tokens and syllables by language; each distinct word is judged once."""
    words_ = table(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("w")).select("lang", P.turkish_lower(F.col("w")).alias("word"))
    counted = words_.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.select("lang", "n", H.internal(F.col("word"))["full_ok"].alias("ok"), F.size(P.syllables(F.col("word"))).alias("k"))
    return judged.groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("harmonic"), F.sum(F.col("n") * F.col("k")).alias("syllables"))
