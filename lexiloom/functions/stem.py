"""Porter's 1980 stemmer with three departures: a final ' and 's go first, `bli` becomes `ble`, and `logi` becomes `log`."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes and what stands for them, by step.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(s: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(s):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def measure(s: str) -> int:
    return len(re.findall("v+c+", shape(s)))


def ends_cvc(s: str) -> bool:
    return shape(s).endswith("cvc") and s[-1] not in "wxy"


def doubled(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and shape(s)[-1] == "c"


def _longest(word: str, suffixes: list[tuple[str, str]], least: int) -> str:
    for suffix, to in sorted(suffixes, key=lambda x: -len(x[0])):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + to if measure(base) > least else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removesuffix("'")
    word = word.removesuffix("'s")
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (m := re.search("(ed|ing)$", word)) and "v" in shape(word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif doubled(word):
            word = word if word[-1] in "lsz" else word[:-1]
        elif measure(word) == 1 and ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, STEP_2, 0)
    word = _longest(word, STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not ends_cvc(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def stem_column(term: Column) -> Column:
    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else stem(t))

    return stems(term)


def with_stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """Distinct terms with their stems, to be joined back."""
    return terms.select(term).distinct().withColumn("stem", stem_column(F.col(term)))
