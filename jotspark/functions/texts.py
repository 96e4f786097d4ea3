"""Text functions: counts, tokens, n-grams, several patterns at once, escapes and checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def word_count(s: Column) -> Column:
    return F.size(split_words(s))


def char_count(s: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(s, r"\s", ""))


def sentence_count(s: Column) -> Column:
    """Closing marks; 1 for a text without any, 0 for a blank one."""
    n = F.regexp_count(s, F.lit("[.!?]"))
    return F.when(F.trim(F.regexp_replace(s, r"\s+", "")) == "", 0).otherwise(F.greatest(n, F.lit(1)))


def paragraph_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, "\n\n"), lambda p: F.regexp_replace(p, r"\s", "") != ""))


def reading_time_seconds(s: Column) -> Column:
    """At 200 words a minute."""
    return F.ceil(word_count(s) * 60 / 200.0).cast("long")


def tokens(s: Column) -> Column:
    return F.filter(F.transform(split_words(s), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))), lambda w: w != "")


def ngrams(s: Column, n: int) -> Column:
    w = split_words(s)
    return F.filter(F.transform(w, lambda _, i: F.slice(w, i + 1, F.lit(n))), lambda g: F.size(g) == n)


def find_last(s: Column, sub: str) -> Column:
    """Place of the last occurrence, from 0; null if there is none."""
    at = F.locate(sub[::-1], F.reverse(s))
    return F.when(at > 0, F.length(s) - at - len(sub) + 1)


def extract_between(s: Column, start: str, end: str) -> Column:
    """Between the first start and the first end after it; null if one is missing."""
    return F.when(s.rlike(f"(?s){re.escape(start)}.*?{re.escape(end)}"), F.regexp_extract(s, f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1))


def match_any(s: Column, patterns: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(s, p))


def match_all(s: Column, patterns: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, patterns)), lambda p: F.contains(s, p))


def match_which(s: Column, patterns: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(s, p))


def match_count(s: Column, patterns: list[str]) -> Column:
    """Occurrences from left to right without overlap, earlier patterns first."""
    return F.regexp_count(s, F.lit("|".join(map(re.escape, patterns))))


def split_keep(s: Column, delimiter: str) -> Column:
    """Pieces and delimiters in turn; no empty ones."""
    d = re.escape(delimiter)
    return F.regexp_extract_all(s, F.lit(f"(?s){d}|(?:(?!{d}).)+"), F.lit(0))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_unescape(s: Column) -> Column:
    for a, b in (("&#x27;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def base64url_encode(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(F.encode(s, "UTF-8")), "+/", "-_"), "[=\r\n]", "")


def base64url_decode(s: Column) -> Column:
    padded = F.concat(F.translate(s, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4))))
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")


def shell_escape(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def is_url(s: Column) -> Column:
    """A web address with a host and without white space."""
    good = F.lower(F.try_parse_url(s, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(s, F.lit("HOST"))) > 1) & ~s.rlike(r"\s")
    return F.when(s.isNotNull(), F.coalesce(good, F.lit(False)))


def is_phone(s: Column) -> Column:
    return s.rlike(r"^\+?[\d\s\-().]{7,}$") & F.length(F.regexp_replace(s, "[^0-9]", "")).between(7, 15)


def is_hex(s: Column) -> Column:
    return s.rlike("^[0-9a-fA-F]+$")


def is_jwt(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9_=-]+(\.[A-Za-z0-9_=-]+){2}$")


def sorensen_dice(a: Column, b: Column) -> Column:
    """Shared pairs of characters, as often as both have them; equal texts give 1."""
    grams = lambda s: F.filter(F.transform(F.split(s, ""), lambda _, i: F.substring(s, i + 1, F.lit(2))), lambda g: F.length(g) == 2)
    x, y = grams(a), grams(b)
    times = lambda g, of: F.size(F.filter(of, lambda o: o == g))
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(times(g, x), times(g, y)))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared * 2.0 / F.nullif(F.size(x) + F.size(y), F.lit(0)))
