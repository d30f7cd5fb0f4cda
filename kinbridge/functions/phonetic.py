"""A consonant skeleton that is alike across scripts: Indic letters to Latin, Latin words to sound classes."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinbridge.functions import rules

# The sounds of Indic letters, and the ordered rewrites.
#: Devanagari by code point; the other blocks have the same letters at the same places, and what is not here is dropped.
ROMAN = {
    0x0900: "n", 0x0901: "n", 0x0902: "n", 0x0903: "h",
    0x0904: "a", 0x0905: "a", 0x0906: "aa", 0x0907: "i", 0x0908: "ii", 0x0909: "u", 0x090A: "uu", 0x090B: "ri", 0x090C: "li", 0x090D: "e", 0x090E: "e", 0x090F: "e", 0x0910: "ai", 0x0911: "o", 0x0912: "o", 0x0913: "o", 0x0914: "au",
    0x0915: "k", 0x0916: "kh", 0x0917: "g", 0x0918: "gh", 0x0919: "n", 0x091A: "ch", 0x091B: "chh", 0x091C: "j", 0x091D: "jh", 0x091E: "n", 0x091F: "t", 0x0920: "th", 0x0921: "d", 0x0922: "dh", 0x0923: "n", 0x0924: "t", 0x0925: "th", 0x0926: "d", 0x0927: "dh", 0x0928: "n", 0x0929: "n", 0x092A: "p", 0x092B: "ph", 0x092C: "b", 0x092D: "bh", 0x092E: "m", 0x092F: "y", 0x0930: "r", 0x0931: "r", 0x0932: "l", 0x0933: "l", 0x0934: "l", 0x0935: "v", 0x0936: "sh", 0x0937: "sh", 0x0938: "s", 0x0939: "h",
    0x093E: "aa", 0x093F: "i", 0x0940: "ii", 0x0941: "u", 0x0942: "uu", 0x0943: "ri", 0x0944: "ri", 0x0945: "e", 0x0946: "e", 0x0947: "e", 0x0948: "ai", 0x0949: "o", 0x094A: "o", 0x094B: "o", 0x094C: "au",
    0x0950: "om",
    0x0958: "q", 0x0959: "kh", 0x095A: "g", 0x095B: "z", 0x095C: "r", 0x095D: "rh", 0x095E: "f", 0x095F: "y",
    0x0960: "ri", 0x0961: "li", 0x0962: "li", 0x0963: "li", 0x0964: " ", 0x0965: " ",
    0x0966: "0", 0x0967: "1", 0x0968: "2", 0x0969: "3", 0x096A: "4", 0x096B: "5", 0x096C: "6", 0x096D: "7", 0x096E: "8", 0x096F: "9",
    0x0972: "e",
}
#: Letters that differ from Devanagari's at their place.
SPECIAL = {
    0x0A70: "n", 0x0A71: "", 0x0A72: "", 0x0A73: "", 0x09CE: "t", 0x0B71: "v", 0x0B83: "h", 0x0D7A: "n", 0x0D7B: "n", 0x0D7C: "r", 0x0D7D: "l", 0x0D7E: "l", 0x0D7F: "k", 0x0D4E: "r",
}
CONJUNCTS = (("റ്റ", "t"), ("ന്റ", "nt"))
REWRITES = (("tech", "tek"), ("tion", "shan"), ("sion", "shan"), ("tur", "chur"), ("x", "ks"), ("qu", "k"), ("ck", "k"))
DIGRAPHS = (("chh", "j"), ("ch", "j"), ("sh", "s"), ("ph", "p"), ("th", "t"), ("dh", "t"), ("kh", "k"), ("gh", "k"), ("bh", "p"), ("jh", "j"))
CLASSES = ("cgqdbfwz", "kkktppvs")
# End of fixed values.

#: (pattern, replacement) in order; Java and Python agree on all of them.
SKELETON = [
    ("[^a-z]", ""), *REWRITES, *DIGRAPHS, ("c(?=[eiy])", "s"), ("(?<=.)g(?=[eiy])", "j"),
    *zip(*CLASSES, strict=True), ("^[aeiou]", "A"), ("(?<=.)[aeiouyh]", ""), ("^A", "a"), ("(.)\\1+", "$1"), ("^(.{3}.*?)[sj]+$", "$1"), ("^.$", ""),
]


@lru_cache(1)
def roman_table() -> dict[int, str]:
    """For str.translate: Devanagari's table shifted to all blocks, the special letters, nothing for what is left."""
    out = {start + offset: ROMAN.get(0x0900 + offset, "") for start in rules.INDIC_SCRIPTS.values() for offset in range(0x80)}
    return out | SPECIAL


def romanized(text: str) -> str:
    for a, b in CONJUNCTS:
        text = text.replace(a, b)
    return text.translate(roman_table())


@lru_cache(1 << 17)
def word_skeleton(word: str) -> str:
    word = word.lower()
    for pattern, replacement in SKELETON:
        word = re.sub(pattern, replacement.replace("$1", r"\1"), word)
    return word


def skeleton(text: str | None) -> str:
    return " ".join(k for k in map(word_skeleton, romanized(text or "").split()) if k)


def skeleton_udf():
    """An Arrow-batched UDF; each distinct value of a batch once."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        once = {v: skeleton(v) for v in x.unique() if isinstance(v, str)}
        return x.map(lambda v: once.get(v, ""))

    return run


def word_skeleton_column(x: Column) -> Column:
    """Of one Latin word, by SQL functions alone."""
    x = F.lower(x)
    for pattern, replacement in SKELETON:
        x = F.regexp_replace(x, pattern, replacement)
    return x


def skeleton_column(x: Column) -> Column:
    """Of a text in Latin letters, by SQL functions alone."""
    return F.array_join(F.filter(F.transform(F.split(x, " "), word_skeleton_column), lambda k: k != ""), " ")


def skeleton_key(x: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))), " ")
