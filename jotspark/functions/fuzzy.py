"""Edit and likeness measures, sound codes and further text functions. Spark's own functions where they suffice; the
distances that need a table of a pair of texts are vectorised UDFs, a small helper for each pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _osa(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def _damerau(a: str, b: str) -> int:
    """The same, but a part may be edited again after a swap."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        d.append([far, i])
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i + 1].append(min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        seen[x] = i
    return d[-1][-1]


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (y for y, t in zip(b, taken) if t), strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _pairs(fn, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def osa_distance(a: Column, b: Column) -> Column:
    return _pairs(_osa, "long")(a, b)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    return _pairs(_damerau, "long")(a, b)


def jaro(a: Column, b: Column) -> Column:
    """0 to 1; two empty texts are alike."""
    return _pairs(_jaro, "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro with a tenth of what lacks added for each of up to four common first characters."""
    same = [F.substring(a, 1, n) == F.substring(b, 1, n) for n in range(1, 5)]
    long_enough = [F.least(F.length(a), F.length(b)) >= n for n in range(1, 5)]
    n = sum((F.when(x & y, 1).otherwise(0) for x, y in zip(same, long_enough, strict=True)), F.lit(0))
    j = jaro(a, b)
    return j + n * 0.1 * (1 - j)


def match_rating_codex(s: Column) -> Column:
    """Vowels after the first letter and doubled letters go; of over six letters the first and last three stay."""
    letters = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    code = F.regexp_replace(F.concat(F.left(letters, F.lit(1)), F.regexp_replace(F.substr(letters, F.lit(2)), "[AEIOU]", "")), r"([A-Z])\1+", "$1")
    return F.when(F.length(code) > 6, F.concat(F.left(code, F.lit(3)), F.right(code, F.lit(3)))).otherwise(code)


def sounds_like(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


def word_frequencies(s: Column) -> Column:
    """Map of lower-case runs of letters and digits to how often they occur."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    names = F.array_distinct(words)
    return F.map_from_arrays(names, F.transform(names, lambda w: F.size(F.filter(words, lambda x: x == w)).cast("long")))


def char_frequencies(s: Column) -> Column:
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    names = F.array_distinct(chars)
    return F.map_from_arrays(names, F.transform(names, lambda w: F.size(F.filter(chars, lambda x: x == w)).cast("long")))


def remove_words(s: Column, words: list[str]) -> Column:
    """The text's words without those given (lower case), joined by single spaces."""
    kept = F.filter(F.split(F.trim(s), r"\s+"), lambda w: ~F.lower(w).isin(words))
    return F.array_join(kept, " ")


def replace_many(s: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def match_positions(s: Column, patterns: list[str]) -> Column:
    """Array of pattern and 0-based place of each pattern's first occurrence, for those that occur."""
    places = F.array(*[F.struct(F.lit(p).alias("pattern"), (F.instr(s, p) - 1).cast("long").alias("start")) for p in patterns])
    return F.when(s.isNotNull(), F.filter(places, lambda x: x["start"] >= 0))


def indices(s: Column, sub: str) -> Column:
    """0-based places of all occurrences, overlapping ones too."""
    n = F.length(s) - len(sub) + 1
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(s.isNotNull(), F.filter(places, lambda i: F.substr(s, i + 1, F.lit(len(sub))) == sub))


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\.+*?()|\[\]{}^$])", r"\\$1")


def abbreviate(s: Column, length: int, suffix: str = "...") -> Column:
    """Up to `length` characters, the suffix among them; where it does not fit, the text is plainly cut."""
    cut = F.left(s, F.lit(length)) if length <= len(suffix) else F.concat(F.left(s, F.lit(length - len(suffix))), F.lit(suffix))
    return F.when(F.length(s) > length, cut).otherwise(s)


def is_base64(s: Column) -> Column:
    return s.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


def is_ipv4(s: Column) -> Column:
    return s.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")


def is_iso_date(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}") & F.coalesce(F.left(s, F.lit(10)).try_cast("date").isNotNull() & s.try_cast("timestamp").isNotNull(), F.lit(False))


def is_json(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def jwt_part(s: Column, place: int) -> Column:
    """JSON text of the header (0) or the claims (1); signatures are not checked; null for what is no token."""
    part = F.translate(F.split_part(s, F.lit("."), F.lit(place + 1)), "-_", "+/")
    padded = F.concat(part, F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4)).cast("int")))
    text = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when(s.rlike(r"^[\w-]+\.[\w-]+\.[\w-]*$") & F.try_parse_json(text).isNotNull(), text)


def ulid_timestamp(s: Column) -> Column:
    """Milliseconds in the first ten of 26 digits; null for what is no such id."""
    digits = F.transform(F.filter(F.split(F.upper(F.left(s, F.lit(10))), ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ"), c) - 1)
    return F.when(F.upper(s).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), F.aggregate(digits, F.lit(0).cast("long"), lambda x, d: x * 32 + d))


def detect_script(s: Column) -> Column:
    """The script with the most letters; null without letters. Ties go to the first of the list."""
    scripts = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari"]
    counts = F.array(*[F.struct(F.regexp_count(s, F.lit(rf"\p{{Is{x}}}")).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("name")) for i, x in enumerate(scripts)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["name"])


def time_ago(t: Column, now: Column) -> Column:
    """The greatest whole unit of now - t, as in '3 days ago', 'in 2 hours' or '0 seconds ago'."""
    gap = now.cast("long") - t.cast("long")
    n, out = F.abs(gap), F.lit("0 seconds ago")
    for unit, size in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400), ("month", 2592000), ("year", 31536000)):
        k = F.floor(n / size).cast("long")
        text = F.concat(k.cast("string"), F.lit(f" {unit}"), F.when(k == 1, "").otherwise("s"))
        out = F.when(n >= size, F.when(gap > 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))).otherwise(out)
    return F.when(gap.isNotNull(), out)
