"""English stems by suffix rules (the algorithm published by Porter, 1980), on a table of distinct words.

A word is consonants and vowels in turn; its measure counts how often a consonant run follows a vowel
run. Each step takes the longest suffix of its table off the word and puts another there, if what is
left meets the step's condition.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Conditions on what is left of a word, as patterns (y is a vowel behind a consonant).
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({_C})?[aeiouy]"
MEASURE_OVER_0 = f"^({_C})?{_V}{_C}"
MEASURE_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
MEASURE_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes and what replaces them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
FORMED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
REMOVED = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def suffix_pattern(suffixes) -> str:
    """What is left (group 1, as short as possible) and the longest of the suffixes (group 2)."""
    return f"^(.*?)({'|'.join(suffixes)})$"


def _replaced(word: Column, table: dict[str, str], condition: str, extra: Column | None = None) -> Column:
    pattern = F.lit(suffix_pattern(table))
    left, suffix = F.regexp_extract(word, suffix_pattern(table), 1), F.regexp_extract(word, suffix_pattern(table), 2)
    put = F.lit("")
    for old, new in table.items():
        if new:
            put = F.when(suffix == old, F.lit(new)).otherwise(put)
    holds = F.rlike(word, pattern) & F.rlike(left, F.lit(condition))
    return F.when(holds if extra is None else holds & extra, F.concat(left, put)).otherwise(word)


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def stem_table(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) of every row. Words of fewer than three letters or others than a to z are their own stem."""
    w = F.col("_w")
    steps = words.select(F.col(column).alias("word"), F.col(column).alias("_w"))

    def step(value: Column, name: str = "_w") -> None:
        nonlocal steps
        steps = steps.withColumn(name, value)

    matches = lambda c, pattern: F.rlike(c, F.lit(pattern))
    step(_replaced(w, PLURALS, ""))
    # Past and present forms: what they leave is mended to a word.
    rest = F.regexp_extract(w, "^(.*?)(ed|ing)$", 1)
    step(F.when(~w.endswith("eed") & matches(rest, HAS_VOWEL), rest), "_rest")
    r = F.col("_rest")
    mended = (
        F.when(matches(r, "(at|bl|iz)$"), F.concat(r, F.lit("e")))
        .when(matches(r, "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"), _cut(r, 1))
        .when(matches(r, MEASURE_IS_1) & matches(r, SHORT_END), F.concat(r, F.lit("e")))
        .otherwise(r)
    )
    step(F.when(r.isNotNull(), mended).when(w.endswith("eed") & matches(_cut(w, 3), MEASURE_OVER_0), _cut(w, 1)).otherwise(w))
    step(F.when(w.endswith("y") & matches(_cut(w, 1), HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    step(_replaced(w, DERIVED, MEASURE_OVER_0))
    step(_replaced(w, FORMED, MEASURE_OVER_0))
    step(_replaced(w, dict.fromkeys(REMOVED, ""), MEASURE_OVER_1, ~w.endswith("ion") | matches(w, "[st]ion$")))
    short = _cut(w, 1)
    drop_e = matches(short, MEASURE_OVER_1) | (matches(short, MEASURE_IS_1) & ~matches(short, SHORT_END))
    step(F.when(w.endswith("e") & drop_e, short).otherwise(w))
    step(F.when(w.endswith("ll") & matches(w, MEASURE_OVER_1), _cut(w, 1)).otherwise(w))
    return steps.select("word", F.when(matches("word", "^[a-z]{3,}$"), w).otherwise(F.col("word")).alias("stem"))


# Fixed value: words whose stems a Python worker keeps.
KEPT_STEMS = 100_000


def _has(pattern: str) -> Callable[[str], re.Match | None]:
    return re.compile(pattern, re.ASCII).search


def _by_last_letter(table: dict[str, str]) -> dict[str, list[tuple[str, str]]]:
    """The suffixes of a table by their last letter, longest first."""
    longest_first = sorted(table.items(), key=lambda pair: -len(pair[0]))
    return {last: [pair for pair in longest_first if pair[0][-1] == last] for last in {suffix[-1] for suffix in table}}


_PLURALS, _DERIVED, _FORMED, _REMOVED = map(_by_last_letter, (PLURALS, DERIVED, FORMED, dict.fromkeys(REMOVED, "")))
_ENGLISH, _VOWEL = _has("^[a-z]{3,}$"), _has(HAS_VOWEL)
_OVER_0, _IS_1, _OVER_1, _SHORT = map(_has, (MEASURE_OVER_0, MEASURE_IS_1, MEASURE_OVER_1, SHORT_END))
_DOUBLED = tuple(c * 2 for c in "bcdfghjkmnpqrtvwxy")


def _replaced_in(word: str, table: dict[str, list[tuple[str, str]]], holds: Callable[[str], object]) -> str:
    for suffix, new in table.get(word[-1:], ()):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            return left + new if holds(left) else word
    return word


@functools.lru_cache(KEPT_STEMS)
def stemmed(word: str) -> str:
    """The stem of one word, by the rules of ``stem_table``: for words that tasks hold already."""
    if not _ENGLISH(word):
        return word
    w = _replaced_in(word, _PLURALS, lambda left: True)
    if w.endswith("eed"):
        if _OVER_0(w[:-3]):
            w = w[:-1]
    elif w.endswith(("ed", "ing")):
        rest = w[:-2] if w.endswith("ed") else w[:-3]
        if _VOWEL(rest):
            if rest.endswith(("at", "bl", "iz")):
                w = rest + "e"
            elif rest.endswith(_DOUBLED):
                w = rest[:-1]
            else:
                w = rest + "e" if _IS_1(rest) and _SHORT(rest) else rest
    if w.endswith("y") and _VOWEL(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced_in(_replaced_in(w, _DERIVED, _OVER_0), _FORMED, _OVER_0)
    if not w.endswith("ion") or w.endswith(("sion", "tion")):
        w = _replaced_in(w, _REMOVED, _OVER_1)
    if w.endswith("e"):
        short = w[:-1]
        if _OVER_1(short) or (_IS_1(short) and not _SHORT(short)):
            w = short
    return w[:-1] if w.endswith("ll") and _OVER_1(w) else w
