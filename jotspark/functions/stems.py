"""English stems by the published Porter2 rules, for columns of words; a small helper for each distinct word of a batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Irregular words and endings of the published rules.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where the two parts begin in which endings count."""
    known = re.match("gener|commun|arsen", w)
    first = known.end() if known else (m.end() if (m := re.search("[aeiouy][^aeiouy]", w)) else len(w))
    second = re.compile("[aeiouy][^aeiouy]").search(w, first)
    return first, second.end() if second else len(w)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w) is not None


def stem_of(word: str) -> str:
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'?$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(?:ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif re.search("[aeiouy].+[^us]s$", w) or re.search("[aeiouy][^aeiouyus]+s$", w):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if m := re.search("(?:eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(?:ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if re.search("(?:at|bl|iz)$", w):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    if re.search(r"(?<=.)[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    for rules, extra in ((STEP_2, {"ogi": ("log", "l"), "li": ("", "cdeghkmnrt")}), (STEP_3, {"ative": ("", None)})):
        ends = sorted((e for e in (*rules, *extra) if w.endswith(e)), key=len)
        if ends and len(w) - len(ends[-1]) >= r1:
            e, cut = ends[-1], w[: -len(ends[-1])]
            if e in rules:
                w = cut + rules[e]
            elif e == "ogi" and cut.endswith("l"):
                w = cut + "og"
            elif e == "li" and cut[-1:] in extra["li"][1]:
                w = cut
            elif e == "ative" and len(cut) >= r2:
                w = cut
    for e in (*STEP_4, "ion"):
        if w.endswith(e):
            cut = w[: -len(e)]
            if len(cut) >= r2 and (e != "ion" or cut[-1:] in "st"):
                w = cut
            break
    if w.endswith("e"):
        cut = w[:-1]
        if len(cut) >= r2 or len(cut) >= r1 and not re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", cut):
            w = cut
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    known = {w: stem_of(w) for w in words.dropna().unique()}
    return pd.Series([known.get(w) for w in words], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    known = {w: stem_of(w) for w in {w for t in tokens if t is not None for w in t if w is not None}}
    return pd.Series([None if t is None else [known.get(w) for w in t] for t in tokens], dtype=object)


def stem(word: Column) -> Column:
    return _stem(word)


def stems(tokens: Column) -> Column:
    return _stems(tokens)
