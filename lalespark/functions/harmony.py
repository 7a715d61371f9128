"""Vowel and consonant harmony as Column expressions. A checker is a pair of functions (stem, suffix) -> Column, so a
caller can pass its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonology import BACK, CLOSE, ROUNDED, UNROUNDED, VOICELESS, first_vowel, is_in, last_vowel, nuclei, vowels


def major(v1: Column, v2: Column) -> Column:
    """Both back or both front; true if either is null."""
    return F.coalesce(is_in(v1, BACK) == is_in(v2, BACK), F.lit(True))


def minor(v1: Column, v2: Column) -> Column:
    """After unrounded, unrounded; else rounded close or unrounded open. True if either is null."""
    after_rounded = F.when(is_in(v2, CLOSE), is_in(v2, ROUNDED)).otherwise(is_in(v2, UNROUNDED))
    return F.coalesce(F.when(v1.isNotNull() & v2.isNotNull(), F.when(is_in(v1, UNROUNDED), is_in(v2, UNROUNDED)).otherwise(after_rounded)), F.lit(True))


def vowel_harmony(stem: Column, suffix: Column) -> Column:
    a, b = last_vowel(stem), first_vowel(suffix)
    return major(a, b) & minor(a, b)


def relaxed_vowel_harmony(stem: Column, suffix: Column) -> Column:
    return minor(last_vowel(stem), first_vowel(suffix))


def consonant_harmony(stem: Column, suffix: Column) -> Column:
    """d and c never after a voiceless consonant, t and ç only there; true if either is empty."""
    hard = F.right(stem, F.lit(1)).rlike(f"[{VOICELESS}]")
    first = F.left(suffix, F.lit(1))
    return F.coalesce(F.when((stem == "") | (suffix == ""), F.lit(True)).when(first.isin("d", "c"), ~hard).when(first.isin("t", "ç"), hard), F.lit(True))


@dataclass(frozen=True)
class Checker:
    vowels: Callable[[Column, Column], Column]
    consonants: Callable[[Column, Column], Column] = consonant_harmony


STRICT, RELAXED = Checker(vowel_harmony), Checker(relaxed_vowel_harmony)


def _neighbours(n: Column, f) -> Column:
    """f of each two neighbours in the array; the array itself is not read again for each."""
    k = F.greatest(F.size(n) - 1, F.lit(0))
    return F.zip_with(F.slice(n, F.lit(1), k), F.slice(n, F.lit(2), k), f)


def internal(word: Column) -> Column:
    """Struct (buu_ok, kuu_ok, full_ok, nuclei, violations) over neighbouring syllables; violations hold pos, v1, v2, buu, kuu."""
    n = nuclei(word)
    pairs = _neighbours(n, lambda a, b: F.struct(a.alias("v1"), b.alias("v2"), major(a, b).alias("buu"), minor(a, b).alias("kuu")))
    judged = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["v1"].alias("v1"), p["v2"].alias("v2"), p["buu"].alias("buu"), p["kuu"].alias("kuu")))
    buu, kuu = F.forall(pairs, lambda p: p["buu"]), F.forall(pairs, lambda p: p["kuu"])
    return F.struct(buu.alias("buu_ok"), kuu.alias("kuu_ok"), (buu & kuu).alias("full_ok"), n.alias("nuclei"), F.filter(judged, lambda p: ~(p["buu"] & p["kuu"])).alias("violations"))


def report(word: Column) -> Column:
    """A line for each two neighbouring vowels: their kinds, and whether major (BÜU) and minor (KÜU) harmony hold."""
    kind = lambda v: F.concat(v, F.lit(" ("), F.when(is_in(v, BACK), "kalın").otherwise("ince"), F.lit(", "), F.when(is_in(v, UNROUNDED), "düz").otherwise("yuvarlak"), F.lit(")"))
    mark = lambda ok: F.when(ok, "✓").otherwise("✗")
    line = lambda a, b: F.concat(F.lit("  "), kind(a), F.lit(" → "), kind(b), F.lit("  BÜU:"), mark(major(a, b)), F.lit("  KÜU:"), mark(minor(a, b)))
    v = vowels(word)
    return F.when(F.size(v) < 2, "  (tek ünlülü sözcük – uyum kontrolü gerekmez)").otherwise(F.array_join(_neighbours(v, line), "\n"))
