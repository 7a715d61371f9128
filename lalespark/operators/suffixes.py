"""The suffix table and the morphotactic automaton, as small dimension tables.

A template's placeholders expand independently: {A} a e, {I} ı i u ü, {D} d t, {C} c ç. States of the automaton are bits of
an integer, so a set of states is one number and a step is an or over the label's slots.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What placeholders stand for.
PLACEHOLDERS = {"{A}": "ae", "{I}": "ıiuü", "{D}": "dt", "{C}": "cç"}

# The default suffixes, template, label, least stem length, exempt from vowel harmony.
SUFFIXES = [
    ("s{I}nl{A}r", "EMİR_3Ç", 2, False),
    ("{C}{I}l{I}k", "YAPIM_-CIlIk", 2, False),
    ("s{I}n{I}z", "KİŞİ_2Ç", 2, False),
    ("{I}m{I}z", "İYELİK_1Ç", 2, False),
    ("{I}n{I}z", "İYELİK_2Ç", 2, False),
    ("y{A}r{A}k", "ZARF_FİİL_-ArAk", 2, False),
    ("{A}r{A}k", "ZARF_FİİL_-ArAk", 2, False),
    ("y{I}nc{A}", "ZARF_FİİL_-IncA", 2, False),
    ("{I}nc{A}", "ZARF_FİİL_-IncA", 2, False),
    ("{A}c{A}k", "GELECEK_ZAMAN", 2, False),
    ("l{A}r{I}", "İYELİK_3Ç", 2, False),
    ("n{D}{A}n", "AYRILMA", 2, False),
    ("{I}yor", "ŞİMDİKİ_ZAMAN", 2, False),
    ("{D}{I}k", "SIFAT_FİİL_-DIk", 2, False),
    ("{A}bil", "YETERLİLİK", 2, False),
    ("l{A}r", "ÇOĞUL", 2, False),
    ("{D}{I}ğ", "SIFAT_FİİL_-DIğ", 2, False),
    ("{D}{A}n", "AYRILMA", 2, False),
    ("n{I}n", "TAMLAYAN", 2, False),
    ("l{I}k", "YAPIM_-lIk", 2, False),
    ("s{I}z", "YAPIM_-sIz", 2, False),
    ("m{I}ş", "DUYULAN_GEÇMİŞ", 2, False),
    ("m{A}k", "MASTAR", 2, False),
    ("m{A}z", "GENİŞ_ZAMAN_OLMSZ", 2, False),
    ("{D}{I}r", "BİLDİRME/ETTİRGEN", 2, False),
    ("l{A}ş", "YAPIM_-lAş", 2, False),
    ("l{A}n", "YAPIM_-lAn", 2, False),
    ("l{A}t", "ETTİRGEN_-lAt", 2, False),
    ("y{I}p", "ZARF_FİİL_-Ip", 2, False),
    ("s{I}n", "EMİR/KİŞİ_2T", 2, False),
    ("yor", "ŞİMDİKİ_ZAMAN", 2, True),
    ("{D}{A}", "BULUNMA", 2, False),
    ("y{A}", "YÖNELME", 2, False),
    ("n{A}", "YÖNELME", 2, False),
    ("{D}{I}", "GEÇMİŞ_ZAMAN", 2, False),
    ("l{A}", "VASITA", 2, False),
    ("y{I}", "BELIRTME", 2, False),
    ("n{I}", "BELIRTME", 2, False),
    ("{I}m", "İYELİK_1T", 3, False),
    ("{I}n", "İYELİK_2T/TAMLAYAN", 3, False),
    ("s{I}", "İYELİK_3T", 2, False),
    ("l{I}", "YAPIM_-lI", 3, False),
    ("{C}{I}", "YAPIM_-CI", 2, False),
    ("s{A}", "DİLEK_ŞART", 2, False),
    ("m{A}", "OLUMSUZ/İSİM_FİİL", 2, False),
    ("{I}l", "EDİLGEN", 3, False),
    ("{I}ş", "İŞTEŞ", 3, False),
    ("{A}n", "SIFAT_FİİL", 3, False),
    ("{I}r", "GENİŞ_ZAMAN", 3, False),
    ("{A}r", "GENİŞ_ZAMAN", 3, False),
    ("{I}z", "KİŞİ_1Ç", 3, False),
    ("{I}p", "ZARF_FİİL_-Ip", 2, False),
    ("ken", "ZARF_FİİL_-ken", 2, True),
    ("ki", "İLGİ_-ki", 2, True),
    ("{I}", "İYELİK_3T/BELIRTME", 3, False),
    ("{A}", "YÖNELME", 3, False),
    ("m", "KİŞİ_1T", 4, False),
]

# The states, in the order of their bits, and the slots that may be stripped next in each.
NEXT = {
    "START": "REL CASE POSS PL DER COP PER TNS ABL NEG VOI PTC CNV INF NIN",
    "REL": "CASE POSS PL DER PTC NIN INF CNV",
    "CASE": "POSS PL DER PTC NIN INF CNV TNS REL",
    "POSS": "PL DER PTC NIN INF CNV TNS REL",
    "PL": "DER PTC NIN INF CNV TNS REL",
    "DER": "DER PTC NIN INF VOI TNS NEG ABL CNV POSS CASE",
    "PTC": "TNS ABL NEG VOI DER",
    "CNV": "ABL NEG VOI TNS DER PTC PER",
    "INF": "NEG VOI ABL DER",
    "NIN": "VOI NEG ABL DER",
    "COP": "PER TNS ABL NEG VOI DER CASE POSS PL PTC NIN INF CNV",
    "PER": "TNS ABL NEG VOI DER COP",
    "TNS": "ABL NEG VOI DER PER TNS COP CASE POSS PL PTC NIN INF CNV",
    "ABL": "NEG VOI DER",
    "NEG": "VOI DER CASE",
    "VOI": "VOI DER",
}

# The slots of each label.
SLOTS = {
    "REL": ["İLGİ_-ki"],
    "CASE": ["BULUNMA", "AYRILMA", "YÖNELME", "BELIRTME", "VASITA", "TAMLAYAN"],
    "POSS": ["İYELİK_3T", "İYELİK_3Ç"],
    "DER": ["YAPIM_-CI", "YAPIM_-CIlIk", "YAPIM_-lAn", "YAPIM_-lAş", "YAPIM_-lI", "YAPIM_-lIk", "YAPIM_-sIz"],
    "COP": ["BİLDİRME"],
    "PER": ["KİŞİ_2Ç", "EMİR", "EMİR_3Ç", "KİŞİ_1T", "KİŞİ_2T", "KİŞİ_3Ç", "EMİR/KİŞİ_2T"],
    "TNS": ["GEÇMİŞ_ZAMAN", "DUYULAN_GEÇMİŞ", "GELECEK_ZAMAN", "GENİŞ_ZAMAN", "GENİŞ_ZAMAN_OLMSZ", "ŞİMDİKİ_ZAMAN", "DİLEK_ŞART"],
    "ABL": ["YETERLİLİK"],
    "NEG": ["OLUMSUZ"],
    "VOI": ["EDİLGEN", "ETTİRGEN_-lAt", "ETTİRGEN"],
    "PTC": ["SIFAT_FİİL", "SIFAT_FİİL_-DIk", "SIFAT_FİİL_-DIğ"],
    "CNV": ["ZARF_FİİL_-ArAk", "ZARF_FİİL_-IncA", "ZARF_FİİL_-Ip", "ZARF_FİİL_-ken"],
    "INF": ["MASTAR"],
    "NIN": ["İSİM_FİİL_-mA"],
    "COP VOI": ["BİLDİRME/ETTİRGEN"],
    "NEG NIN": ["OLUMSUZ/İSİM_FİİL"],
    "POSS CASE": ["İYELİK_3T/BELIRTME"],
    "POSS CASE PER": ["İYELİK_2T/TAMLAYAN"],
    "POSS PER": ["KİŞİ_1Ç", "İYELİK_1T", "İYELİK_2Ç", "İYELİK_1Ç"],
    "PL PER": ["ÇOĞUL"],
    "VOI DER": ["İŞTEŞ"],
}

BIT = {state: 1 << k for k, state in enumerate(NEXT)}
START = BIT["START"]
#: For each slot the states from which it may be stripped.
FROM = {slot: sum(BIT[s] for s, after in NEXT.items() if slot in after.split()) for slot in NEXT if slot != "START"}
SLOTS_OF = {label: slots.split() for slots, labels in SLOTS.items() for label in labels}


def step(states: int, label: str) -> int:
    """The states after stripping the label; an unknown label keeps them; 0 if it can't be stripped."""
    slots = SLOTS_OF.get(label)
    if slots is None:
        return states
    return sum(BIT[s] for s in slots if FROM[s] & states)


def step_column(states: Column, label: Column) -> Column:
    out = states
    for name, slots in SLOTS_OF.items():
        parts = [F.when(states.bitwiseAND(F.lit(FROM[s])) != 0, F.lit(BIT[s])).otherwise(F.lit(0)) for s in slots]
        out = F.when(label == name, reduce(lambda a, b: a.bitwiseOR(b), parts)).otherwise(out)
    return out


def is_valid_sequence(labels: Column) -> Column:
    """Whether the automaton accepts an array of labels, from the outermost in. The transitions go in as one map."""
    table = F.create_map(*[F.lit(x) for name, slots in SLOTS_OF.items() for x in (name, ",".join(f"{FROM[s]}:{BIT[s]}" for s in slots))])

    def move(states, label):
        pairs = F.split(table[label], ",")
        one = lambda acc, p: acc.bitwiseOR(F.when(states.bitwiseAND(F.element_at(F.split(p, ":"), 1).cast("int")) != 0, F.element_at(F.split(p, ":"), 2).cast("int")).otherwise(F.lit(0)))
        return F.when(F.map_contains_key(table, label), F.aggregate(F.coalesce(pairs, F.array()), F.lit(0), one)).otherwise(states)

    return F.aggregate(labels, F.lit(START), move) != 0


def expand(template: str) -> list[str]:
    """All forms of a template, the first placeholder varying slowest."""
    import re

    parts = re.split(r"(\{[AIDC]\})", template)
    return ["".join(x) for x in product(*[PLACEHOLDERS.get(p, [p]) for p in parts])]


def expand_column(template: Column) -> Column:
    """All forms of a template as an array: replaces the first of each placeholder until none is left."""
    def spread(mark: str, letters: str):
        pattern = mark.replace("{", r"\{").replace("}", r"\}")
        return lambda t: F.when(F.contains(t, F.lit(mark)), F.array(*[F.regexp_replace(t, f"^(.*?){pattern}", f"$1{c}") for c in letters])).otherwise(F.array(t))

    out = F.array(template)
    for mark, letters in PLACEHOLDERS.items():
        for _ in range(2):  # no placeholder comes more than twice
            out = F.flatten(F.transform(out, spread(mark, letters)))
    return out


def forms(rows=None) -> list[tuple[str, str, int, bool]]:
    """(form, label, min_stem, exempt), longest first, then by form: the order in which suffixes are tried."""
    out = [(f, label, least, exempt) for template, label, least, exempt in (SUFFIXES if rows is None else rows) for f in expand(template)]
    return sorted(out, key=lambda x: (-len(x[0]), x[0]))


def table(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(form, label, min_stem, exempt) of the default suffixes and of a caller's own ones (template, label, min_stem, exempt)."""
    base = spark.createDataFrame(SUFFIXES, "template string, label string, min_stem int, exempt boolean")
    if extra is not None:
        base = base.unionByName(extra)
    return base.select(F.explode(expand_column(F.col("template"))).alias("form"), "label", "min_stem", "exempt")
