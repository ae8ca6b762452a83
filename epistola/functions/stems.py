"""Suffix stripping by the measure of what is left: the steps of Porter's algorithm with the extensions in common use.

The measure of a stem is its number of vowel runs with a consonant run behind them; an automaton over
the characters counts it (y is a vowel behind a consonant). Words come in Arrow batches, and each worker keeps the stems it knows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words with stems of their own (fixed values).
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what stands for them, by step; the first that fits decides (fixed values).
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
VOWELS = frozenset("aeiou")
#: Stems that a worker keeps.
KNOWN = 200_000


def shape(stem: str) -> str:
    """v and c for every character."""
    out, before = [], "v"
    for ch in stem:
        before = "v" if ch in VOWELS or (ch == "y" and before == "c" and out) else "c"
        out.append(before)
    return "".join(out)


def measure(stem: str) -> int:
    return shape(stem).count("vc")


def _closed(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; or just a vowel and a consonant."""
    form = shape(stem)
    return (form[-3:] == "cvc" and stem[-1] not in "wxy") or form == "vc"


def _first_fit(word: str, rules: tuple[tuple[str, str], ...], allowed: Callable[[str], bool]) -> str:
    for suffix, instead in rules:
        if word.endswith(suffix):
            left = word[: len(word) - len(suffix)]
            return left + instead if allowed(left) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    left = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "v" in shape(w[: -len(x)])), None)
    if left is None:
        return w
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if len(left) > 1 and left[-1] == left[-2] and left[-1] not in "aeiouy":
        return left if left[-1] in "lsz" else left[:-1]
    return left + "e" if measure(left) == 1 and _closed(left) else left


def _second(w: str) -> str:
    if w.endswith("alli"):
        return _second(w[:-2]) if measure(w[:-4]) > 0 else w
    if w.endswith("logi"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    return _first_fit(w, SECOND, lambda s: measure(s) > 0)


def _fourth(w: str) -> str:
    return _first_fit(w, tuple((x, "") for x in FOURTH), lambda s: measure(s) > 1 and (not w.endswith("ion") or s.endswith(("s", "t"))))


def _ending(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _closed(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two characters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _first_fit(_second(w), THIRD, lambda s: measure(s) > 0)
    return _ending(_fourth(w))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    out = []
    for words in lists:
        if words is None:
            out.append(None)
            continue
        made = []
        for w in words:
            if w is not None and w not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[w] = stem(w)
            made.append(known.get(w))
        out.append(made)
    return pd.Series(out, dtype="object")


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words, in place; a null array or word stays null."""
    return _stems(words)
