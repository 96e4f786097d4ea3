"""Sound codes, stop words, languages, ranked likeness and identifiers as column functions; null gives null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jotspark.functions.fuzzy import indices, jaro_winkler

# The rules of the published sound codes, in the order in which they apply.
CAVERPHONE_1 = [
    ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^gn", "2n"), ("mb$", "m2"), ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"),
    ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"),
    ("w3", "W3"), ("wy", "Wy"), ("wh3", "Wh3"), ("why", "Why"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("ry", "Ry"), ("r", "2"), ("l3", "L3"), ("ly", "Ly"), ("l", "2"), ("j", "y"), ("y3", "Y3"), ("y", "2"), ("2", ""), ("3", ""),
]
CAVERPHONE_2 = [
    ("e$", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"), ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"),
    ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"),
    ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
]
NYSIIS = [
    ("^MAC", "MCC"), ("^KN", "NN"), ("^K", "C"), ("^(PH|PF)", "FF"), ("^SCH", "SSS"), ("(EE|IE)$", "Y"), ("(DT|RT|RD|NT|ND)$", "D"),
]
NYSIIS_INNER = [
    ("(?<=.)EV", "AF"), ("(?<=.)[AEIOU]", "A"), ("(?<=.)Q", "G"), ("(?<=.)Z", "S"), ("(?<=.)M", "N"), ("(?<=.)KN", "NN"), ("(?<=.)K", "C"), ("(?<=.)SCH", "SSS"), ("(?<=.)PH", "FF"), ("(?<=[^A])H", "~"), ("(?<=.)H(?=[^A])", "~"), ("(?<=A)W", "A"),
]
METAPHONE = [
    ("^(AE|GN|KN|PN|WR)", "#$1"), ("^#.", ""), ("^X", "S"), ("^WH", "W"), ("([A-BD-Z])\\1+", "$1"), ("MB$", "M"), ("SCH", "SK"), ("C(?=IA|H)", "X"), ("XH", "X"), ("S?C(?=[EIY])", "S"), ("C", "K"), ("DG(?=[EIY])", "J"), ("D", "T"), ("GH(?![AEIOU]|$)", ""), ("GH$", ""), ("G(?=N(ED)?$)", ""),
    ("G(?=[EIY])", "J"), ("G", "K"), ("CK", "K"), ("KK", "K"), ("PH", "F"), ("Q", "K"), ("S(?=H|I[OA])", "X"), ("XH", "X"), ("T(?=I[AO])", "X"), ("TH", "0"), ("TCH", "X"), ("V", "F"), ("W(?![AEIOU])", ""), ("X(?=.)", "X"), ("Y(?![AEIOU])", ""), ("Z", "S"), ("(?<=[AEIOU])H(?![AEIOU])", ""), ("(?<=[CSPTG])H", ""), ("(?<=.)[AEIOU]", ""),
]


def _rules(s: Column, rules: list[tuple[str, str]]) -> Column:
    for old, new in rules:
        s = F.regexp_replace(s, old, new)
    return s


def caverphone(s: Column) -> Column:
    """Six signs, filled with 1."""
    return F.rpad(_rules(F.regexp_replace(F.lower(s), "[^a-z]", ""), CAVERPHONE_1), 6, "1")


def caverphone2(s: Column) -> Column:
    """Ten signs, filled with 1."""
    return F.rpad(_rules(F.regexp_replace(F.lower(s), "[^a-z]", ""), CAVERPHONE_2), 10, "1")


def nysiis(s: Column) -> Column:
    start = _rules(F.regexp_replace(F.upper(s), "[^A-Z]", ""), NYSIIS)
    inner = F.regexp_replace(_rules(start, NYSIIS_INNER), "~", "")
    ended = _rules(inner, [("S$", ""), ("AY$", "Y"), ("A$", ""), ("([A-Z])\\1+", "$1")])
    return F.when(F.length(start) <= 1, start).otherwise(F.left(ended, F.lit(6)))


def metaphone(s: Column) -> Column:
    return F.upper(_rules(F.regexp_replace(F.upper(s), "[^A-Z]", ""), METAPHONE))


def phonetic_match(a: Column, b: Column, algorithm: str = "soundex") -> Column:
    code = {"soundex": F.soundex, "metaphone": metaphone, "nysiis": nysiis, "caverphone": caverphone, "caverphone2": caverphone2}[algorithm]
    return code(a) == code(b)


# Frequent function words by language.
STOPWORDS = {
    "en": "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your",
    "de": "aber alle als am an auch auf aus bei bin bis bist da das dass dem den der des die dir doch du durch ein eine einem einen einer er es für hat haben ich ihr im in ist ja kann mein mich mir mit nach nicht noch nur oder sein sich sie sind so um und uns von war was wenn wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "es": "a al algo como con cual de del desde donde el ella ellos en entre era es esta este estos fue ha hay la las le les lo los más me mi muy no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo un una y ya yo",
}
LANGUAGES = {"en": ("eng", "English"), "de": ("deu", "Deutsch"), "fr": ("fra", "Français"), "es": ("spa", "Español")}


def stopwords(lang: str = "en") -> Column:
    return F.array(*map(F.lit, STOPWORDS[lang].split()))


def is_stopword(w: Column, lang: str = "en") -> Column:
    return F.lower(w).isin(STOPWORDS[lang].split())


def remove_stopwords(tokens: Column, lang: str = "en") -> Column:
    return F.filter(tokens, lambda w: ~is_stopword(w, lang))


def detect_language_info(s: Column) -> Column:
    """code, iso, name and confidence of the language with the most function words; null for none. An approximation: words that
    other languages share count for each of them."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}]+"), lambda w: w != "")

    def counted(place: int, code: str) -> Column:
        n = F.size(F.filter(words, lambda w: w.isin(STOPWORDS[code].split())))
        return F.struct(n.alias("n"), F.lit(-place).alias("i"), F.lit(code).alias("code"), F.lit(LANGUAGES[code][0]).alias("iso"), F.lit(LANGUAGES[code][1]).alias("name"))

    counts = F.array(*[counted(i, c) for i, c in enumerate(STOPWORDS)])

    def best(c: Column) -> Column:
        top, total = F.array_max(c), F.aggregate(c, F.lit(0), lambda a, x: a + x["n"])
        return F.when(top["n"] > 0, F.struct(top["code"].alias("code"), top["iso"].alias("iso"), top["name"].alias("name"), (top["n"] / F.greatest(total, F.lit(1))).alias("confidence")))

    return F.element_at(F.transform(F.array(counts), best), 1)


def detect_language(s: Column) -> Column:
    return detect_language_info(s)["name"]


def detect_language_iso(s: Column) -> Column:
    return detect_language_info(s)["iso"]


def detect_language_confidence(s: Column) -> Column:
    return detect_language_info(s)["confidence"]


@F.pandas_udf(StringType())
def _normal(s: pd.Series, form: pd.Series) -> pd.Series:
    return s.str.normalize(form.iloc[0]) if len(s) else s


def normalize_unicode(s: Column, form: str = "NFC") -> Column:
    return _normal(s, F.lit(form))


def remove_accents(s: Column) -> Column:
    """Without combining marks."""
    return F.regexp_replace(normalize_unicode(s, "NFD"), r"\p{Mn}", "")


def is_ipv6(s: Column) -> Column:
    group, v4 = "[0-9a-fA-F]{1,4}", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    parts = F.size(F.split(F.regexp_replace(s, rf"{v4}$", "0:0"), ":"))
    shaped = s.rlike(rf"^(?:{group}(?::{group})*)?(?:::(?:{group}(?::{group})*)?)?(?:(?<=:){v4})?$") | s.rlike(rf"^(?:{group}:)+{v4}$") | s.rlike(rf"^(?:{group}(?::{group})*)?::(?:{group}:)*{v4}$")
    return shaped & F.when(s.contains("::"), (parts <= 8) | ((parts == 9) & s.rlike("^::|::$"))).otherwise(parts == 8)


def extract_all(s: Column, patterns: list[str]) -> Column:
    """Every occurrence of literal patterns, overlapping ones too: pattern, match, and start and end from 0, by place."""

    def found(p: str) -> Column:
        return F.transform(indices(s, p), lambda i: F.struct(i.alias("start"), (i + len(p)).alias("end"), F.lit(p).alias("pattern"), F.lit(p).alias("match")))

    return F.array_sort(F.concat(*[found(p) for p in patterns if p]))


# ranked likeness


def fuzzy_match(value: Column, query: str, weight: int = 10) -> Column:
    """How a value matches a query, without case: exact, prefix, contains, fuzzy (Jaro-Winkler over 0.8) or none, and its score."""
    v, q = F.lower(value), F.lit(query.lower())
    like = jaro_winkler(v, q) > 0.8
    fuzzy = like & (F.length(value) >= 3) if len(query) >= 3 else F.lit(False)
    kind = F.when(v == q, "exact").when(F.startswith(v, q), "prefix").when(F.contains(v, q), "contains").when(fuzzy, "fuzzy").otherwise("none")
    base = F.when(kind == "exact", 1000).when(kind == "prefix", 800).when(kind == "contains", 600).when(kind == "fuzzy", 400).otherwise(0)
    return F.when(value.isNotNull(), F.struct((kind != "none").alias("matches"), (F.floor(base * weight / 10)).cast("long").alias("score"), kind.alias("match_type")))


def fuzzy_score(value: Column, query: str, weight: int = 10) -> Column:
    return fuzzy_match(value, query, weight)["score"]


def normalized_damerau_levenshtein(a: Column, b: Column, distance: Column) -> Column:
    """1 less the distance's share of the longer text; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - distance / F.nullif(longest, F.lit(0)))


# identifiers and chance


def uuid() -> Column:
    return F.expr("uuid()")


def _random_text(alphabet: str, n: int) -> Column:
    return F.concat(*[F.substr(F.lit(alphabet), F.floor(F.rand() * len(alphabet)).cast("int") + 1, F.lit(1)) for _ in range(n)])


def nanoid(size: int = 21) -> Column:
    return _random_text("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-", size)


def ulid(now: Column | None = None) -> Column:
    """48 bits of milliseconds and 80 of chance, in Crockford's digits."""
    digits = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    ms = F.unix_millis(now if now is not None else F.current_timestamp())
    head = [F.substr(F.lit(digits), F.shiftright(ms, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(9, -1, -1)]
    return F.concat(*head, _random_text(digits, 16))


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """From low to high, both in."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def random_choice(a: Column, seed: int | None = None) -> Column:
    return F.get(a, F.floor(F.rand(seed) * F.size(a)).cast("int"))


def shuffle(a: Column, seed: int | None = None) -> Column:
    return F.shuffle(a, seed) if seed is not None else F.shuffle(a)


def sample(a: Column, n: int, seed: int | None = None) -> Column:
    return F.slice(shuffle(a, seed), 1, n)
