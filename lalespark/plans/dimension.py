"""Queries of the suffix table and the automaton."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import suffixes as S
from ..operators import tables
from .base import values

QUERIES, ORACLES = {}, {}

_SLOTS = values((label, S.FROM[s], S.BIT[s]) for label, slots in S.SLOTS_OF.items() for s in slots)
_TEMPLATES = f"tpl AS (SELECT * FROM (VALUES {values(S.SUFFIXES)}) AS t(template, label, min_stem, exempt))"
_PLACE = f"ph(mark, letter) AS (VALUES {values((m, c) for m, cs in S.PLACEHOLDERS.items() for c in cs)})"
_FORMS = f"""{_TEMPLATES}, {_PLACE},
grown(form, label, min_stem, exempt) AS (SELECT template, label, min_stem, exempt FROM tpl UNION ALL
  SELECT left(form, strpos(form, mark) - 1) || letter || substr(form, strpos(form, mark) + 3), label, min_stem, exempt FROM grown, ph
  WHERE contains(form, '{{') AND substr(form, strpos(form, '{{'), 3) = mark),
forms AS (SELECT * FROM grown WHERE NOT contains(form, '{{'))"""

#: Label sequences from the outermost suffix in.
SEQUENCES = [
    ["ÇOĞUL"], ["BULUNMA", "İYELİK_3T"], ["AYRILMA", "İYELİK_3Ç"], ["BULUNMA", "ÇOĞUL"], ["İLGİ_-ki", "BULUNMA"], ["AYRILMA", "İLGİ_-ki", "BULUNMA"],
    ["GEÇMİŞ_ZAMAN"], ["KİŞİ_1T", "GEÇMİŞ_ZAMAN"], ["ÇOĞUL", "GEÇMİŞ_ZAMAN", "OLUMSUZ/İSİM_FİİL"], ["BİLDİRME/ETTİRGEN", "MASTAR", "EDİLGEN"],
    ["İYELİK_3T/BELIRTME", "SIFAT_FİİL_-DIğ", "OLUMSUZ/İSİM_FİİL"], ["BULUNMA", "BULUNMA"], ["ÇOĞUL", "BULUNMA"], ["EDİLGEN", "GEÇMİŞ_ZAMAN"],
    ["MASTAR", "GEÇMİŞ_ZAMAN"], ["YÖNELME", "İYELİK_3T/BELIRTME", "YAPIM_-lIk", "YAPIM_-sIz"], ["YETERLİLİK", "KİŞİ_1T"], ["NEW_LABEL", "ÇOĞUL"], ["ÇOĞUL", "NEW_LABEL", "ÇOĞUL"],
    ["GENİŞ_ZAMAN", "YETERLİLİK", "EDİLGEN", "ETTİRGEN_-lAt"], ["ZARF_FİİL_-ken", "ÇOĞUL", "GENİŞ_ZAMAN"], ["VASITA", "MASTAR", "İŞTEŞ"], ["TAMLAYAN", "ÇOĞUL", "SIFAT_FİİL"], [],
]


def suffix_expand(spark, sf_dir):
    return S.table(spark)


def suffix_order(spark, sf_dir):
    """Forms in the order in which they are tried: longest first, then by form."""
    rows = S.table(spark).select("form", "label", F.length("form").alias("n"))
    return rows.select("form", "label", "n", F.expr("row_number() over (order by n desc, form)").alias("place"))


def suffix_lengths(spark, sf_dir):
    return S.table(spark).groupBy(F.length("form").alias("n")).agg(F.count(F.lit(1)).alias("forms"), F.countDistinct("label").alias("labels"))


def _sequences(spark):
    return spark.createDataFrame([(k, s) for k, s in enumerate(SEQUENCES)], "id int, labels array<string>")


def fsm_valid(spark, sf_dir):
    return _sequences(spark).select("id", S.is_valid_sequence(F.col("labels")).alias("valid"))


def fsm_transition(spark, sf_dir):
    """The states after stripping each label from each single state."""
    states = spark.createDataFrame([(s, b) for s, b in S.BIT.items()], "state string, bit int")
    labels = spark.createDataFrame([(x,) for x in [*S.SLOTS_OF, "NEW_LABEL"]], "label string")
    return states.join(F.broadcast(labels)).select("state", "label", S.step_column(F.col("bit"), F.col("label")).alias("after"))


def fsm_pairs(spark, sf_dir):
    """For each pair of suffix forms' labels, outer and inner, whether the inner may follow and isn't forbidden."""
    labels = S.table(spark).select("label").distinct()
    pairs = labels.select(F.col("label").alias("outer_label")).join(F.broadcast(labels.select(F.col("label").alias("inner_label"))))
    shut = spark.createDataFrame(tables.FORBIDDEN, "inner_label string, outer_label string")
    return pairs.filter(S.is_valid_sequence(F.array("outer_label", "inner_label"))).join(F.broadcast(shut), ["inner_label", "outer_label"], "left_anti").select("outer_label", "inner_label")


QUERIES |= {f.__name__: f for f in (suffix_expand, suffix_order, suffix_lengths, fsm_valid, fsm_transition, fsm_pairs)}

_AFTER = f"slots(label, m, b) AS (VALUES {_SLOTS})"
_SEQ = f"seq(id, pos, label) AS (VALUES {values((i, k, x) for i, s in enumerate(SEQUENCES) for k, x in enumerate(s))}), ids AS (SELECT CAST(unnest(range(0, {len(SEQUENCES)})) AS INTEGER) AS id)"
_STEP = "CASE WHEN EXISTS (SELECT 1 FROM slots x WHERE x.label = {l}) THEN coalesce((SELECT bit_or(CASE WHEN (x.m & {s}) <> 0 THEN x.b ELSE 0 END) FROM slots x WHERE x.label = {l}), 0) ELSE {s} END"

ORACLES |= {
    "suffix_expand": f"WITH RECURSIVE {_FORMS} SELECT form, label, CAST(min_stem AS INTEGER) AS min_stem, exempt FROM forms",
    "suffix_order": f"WITH RECURSIVE {_FORMS} SELECT form, label, CAST(length(form) AS INTEGER) AS n, CAST(row_number() OVER (ORDER BY length(form) DESC, form) AS INTEGER) AS place FROM forms",
    "suffix_lengths": f"WITH RECURSIVE {_FORMS} SELECT CAST(length(form) AS INTEGER) AS n, count(*) AS forms, count(DISTINCT label) AS labels FROM forms GROUP BY 1",
    "fsm_transition": f"WITH {_AFTER}, st(state, bit) AS (VALUES {values(S.BIT.items())}), lb(label) AS (VALUES {values((x,) for x in [*S.SLOTS_OF, 'NEW_LABEL'])}) SELECT state, label, CAST({_STEP.format(l='lb.label', s='st.bit')} AS INTEGER) AS after FROM st, lb",
    "fsm_valid": f"WITH RECURSIVE {_AFTER}, {_SEQ}, walk(id, pos, s) AS (SELECT id, 0, {S.START} FROM ids UNION ALL SELECT w.id, w.pos + 1, {_STEP.format(l='q.label', s='w.s')} FROM walk w JOIN seq q ON q.id = w.id AND q.pos = w.pos) SELECT id, arg_max(s, pos) <> 0 AS valid FROM walk GROUP BY id",
    "fsm_pairs": f"WITH {_AFTER}, shut(i, o) AS (VALUES {values(tables.FORBIDDEN)}), lb(label) AS (SELECT DISTINCT label FROM (VALUES {values(S.SUFFIXES)}) AS t(template, label, m, e)), "
    f"p AS (SELECT a.label AS outer_label, b.label AS inner_label, {_STEP.format(l='a.label', s=str(S.START))} AS s FROM lb a, lb b) SELECT p.outer_label, p.inner_label FROM p WHERE {_STEP.format(l='p.inner_label', s='p.s')} <> 0 AND NOT EXISTS (SELECT 1 FROM shut WHERE i = p.inner_label AND o = p.outer_label)",
}
