"""Porter's suffix stripping for English (A35), from the published description of the algorithm.

A word is read as a line of consonants and vowels; its measure is how often a
vowel is followed by a consonant.  Each step is a table of suffixes: the longest
that the word ends in decides, and it is replaced if what stands before it meets
the step's condition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published suffix tables.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DOUBLE_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
SINGLE_SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """A letter v or c for every letter; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return shape(stem).count("vc")


def ends_short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def swapped(word: str, table, allowed: Callable[[str], bool]) -> str:
    """``word`` with the longest suffix of ``table`` that it has replaced, if the rest is ``allowed``."""
    suffix, other = max(((s, o) for s, o in table if word.endswith(s)), key=lambda x: len(x[0]), default=("", ""))
    rest = word[: len(word) - len(suffix)]
    return rest + other if suffix and allowed(rest) else word


def past_forms(word: str) -> str:
    """eed, ed and ing."""
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    suffix = next((s for s in ("ed", "ing") if word.endswith(s)), None)
    if suffix is None or "v" not in shape(word[: -len(suffix)]):
        return word
    rest = word[: -len(suffix)]
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if ends_double(rest) and rest[-1] not in "lsz":
        return rest[:-1]
    return rest + "e" if measure(rest) == 1 and ends_short(rest) else rest


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = past_forms(swapped(word, PLURALS, lambda rest: True))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (DOUBLE_SUFFIXES, SINGLE_SUFFIXES):
        word = swapped(word, table, lambda rest: measure(rest) > 0)
    ending = max((e for e in ENDINGS if word.endswith(e)), key=len, default="")
    rest = word[: len(word) - len(ending)]
    if ending and measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not ends_short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map({w: stem(w) for w in words.dropna().unique()})


def stemmed(word: Column) -> Column:
    """The stem of a column of lower-case words; each distinct word of a batch is read once."""
    return F.pandas_udf(_stems, StringType())(word)
