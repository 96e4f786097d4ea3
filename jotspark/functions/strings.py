"""String functions: columns in, columns out; a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(s: Column) -> Column:
    """Parts at changes of case and at anything that is not a letter or digit."""
    spaced = F.regexp_replace(F.regexp_replace(s, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def _joined(s: Column, sep: str, each) -> Column:
    return F.array_join(F.transform(words(s), each), sep)


def snake_case(s: Column) -> Column:
    return _joined(s, "_", F.lower)


def kebab_case(s: Column) -> Column:
    return _joined(s, "-", F.lower)


def shouty_snake_case(s: Column) -> Column:
    return _joined(s, "_", F.upper)


def shouty_kebab_case(s: Column) -> Column:
    return _joined(s, "-", F.upper)


def _title(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))


def pascal_case(s: Column) -> Column:
    return _joined(s, "", _title)


def train_case(s: Column) -> Column:
    return _joined(s, "-", _title)


def title_case(s: Column) -> Column:
    return _joined(s, " ", _title)


def camel_case(s: Column) -> Column:
    p = pascal_case(s)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))


def reverse_string(s: Column) -> Column:
    return F.reverse(s)


def is_blank(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", "")) == ""


def normalize_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def pad_left(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_right(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def center(s: Column, width: int, fill: str = " ") -> Column:
    """The odd fill goes to the right."""
    return pad_right(F.when(F.length(s) >= width, s).otherwise(F.concat(F.repeat(F.lit(fill), F.floor((F.lit(width) - F.length(s)) / 2).cast("int")), s)), width, fill)


def truncate(s: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(s) <= length, s).otherwise(F.concat(F.substring(s, 1, max(0, length - len(suffix))), F.lit(suffix)))


def obscure(s: Column, visible: int = 4, mask: str = "*") -> Column:
    """All but the last characters masked."""
    hidden = F.greatest(F.length(s) - visible, F.lit(0))
    return F.concat(F.repeat(F.lit(mask), hidden), F.when(F.length(s) > visible, F.right(s, F.lit(visible))).otherwise(s))


def find_first(s: Column, sub: str) -> Column:
    """Place of the first occurrence, from 0; null if there is none."""
    return F.nullif(F.locate(sub, s), F.lit(0)) - 1


def implode(a: Column, sep: str = "") -> Column:
    return F.array_join(a, sep)


def ltrimstr(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 2**31 - 1)).otherwise(s)


def rtrimstr(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), F.left(s, F.length(s) - len(suffix))).otherwise(s)


def redact_pattern(s: Column, pattern: str, mask: str = "[REDACTED]") -> Column:
    return F.regexp_replace(s, pattern, mask.replace("$", r"\$"))


def semver_parse(s: Column) -> Column:
    """major, minor and patch; null for other texts."""
    p = r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$"
    part = [F.regexp_extract(s, p, i).try_cast("long") for i in (1, 2, 3)]
    return F.when(s.rlike(p), F.struct(*[x.alias(n) for x, n in zip(part, ("major", "minor", "patch"), strict=True)]))


def jaccard_words(a: Column, b: Column) -> Column:
    x, y = words(F.lower(a)), words(F.lower(b))
    return F.when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column) -> Column:
    """Places at which texts of one length differ; null for other lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(pairs, lambda d: d)))
