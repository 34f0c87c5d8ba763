"""Porter's stemmer (Porter 1980) and column functions that need Python: stems and HTML entities."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# The published algorithm's suffix tables of steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replace(w: str, table: list[tuple[str, str]]) -> str:
    for old, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(old):
            return w[: -len(old)] + new if _m(w[: -len(old)]) > 0 else w
    return w


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _m(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _m(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def _each(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A column function of ``f`` over values that are not null; its UDF is made at the first call, in a session."""

    def column(value: Column | str) -> Column:
        def run(values: pd.Series) -> pd.Series:
            return values.map(f, na_action="ignore")

        return F.pandas_udf(run, kind)(value)

    return column


stems = _each(stem, "string")
stem_all = _each(lambda words: [stem(w) for w in words], "array<string>")
unescape_html = _each(html.unescape, "string")
