"""Sounds of Turkish as Column expressions; all of them are built from Catalyst functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter classes.
VOWELS = "aeıioöuüâîû"
BACK = "aıouâû"
FRONT = "eiöüî"
UNROUNDED = "aeıiâî"
ROUNDED = "oöuüû"
OPEN = "aeoöâ"
CLOSE = "ıiuüîû"
CONSONANTS = "bcçdfgğhjklmnprsştvyz"
VOICELESS = "çfhkpsşt"
SONORANT_SIBILANT = "lmnryşszğ"

#: One reversed syllable: the coda, the vowel, and an onset of one letter, or all letters before the first vowel.
_REVERSED_SYLLABLE = f"[^{VOWELS}]*[{VOWELS}](?:[^{VOWELS}]+$|[^{VOWELS}]?)"


def is_in(letter: Column, letters: str) -> Column:
    """Whether the one-letter string is one of letters; null stays null."""
    return F.instr(F.lit(letters), letter) > 0


def vowels(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(f"[{VOWELS}]"), F.lit(0))


def first_vowel(word: Column) -> Column:
    return F.nullif(F.regexp_extract(word, f"[{VOWELS}]", 0), F.lit(""))


def last_vowel(word: Column) -> Column:
    return F.nullif(F.regexp_extract(word, f".*([{VOWELS}])", 1), F.lit(""))


def turkish_lower(text: Column) -> Column:
    """İ to i and I to ı before the common lower case: lower('İ') alone is two characters."""
    return F.lower(F.translate(text, "İI", "iı"))


def syllables(word: Column) -> Column:
    """One vowel a syllable: a boundary stands before the last consonant between two vowels, or between the vowels."""
    low = F.lower(word)
    cut = F.reverse(F.transform(F.regexp_extract_all(F.reverse(low), F.lit(_REVERSED_SYLLABLE), F.lit(0)), F.reverse))
    return F.when(F.size(vowels(low)) <= 1, F.array(low)).otherwise(cut)


def nuclei(word: Column) -> Column:
    return F.filter(F.transform(syllables(word), lambda s: F.regexp_extract(s, f"[{VOWELS}]", 0)), lambda v: v != "")


def is_loanword_candidate(word: Column) -> Column:
    """o or ö after the first syllable."""
    n = nuclei(word)
    return F.exists(F.slice(n, F.lit(2), F.greatest(F.size(n), F.lit(1))), lambda v: v.isin("o", "ö"))


def is_valid_stem(stem: Column) -> Column:
    """A vowel, fewer than three consonants at the end, and of two the first a sonorant or sibilant."""
    end = f"[{CONSONANTS}]"
    pair_ok = ~stem.rlike(f"{end}{end}$") | stem.rlike(f"[{SONORANT_SIBILANT}]{end}$")
    return stem.rlike(f"[{VOWELS}]") & ~stem.rlike(f"{end}{{3}}$") & pair_ok
