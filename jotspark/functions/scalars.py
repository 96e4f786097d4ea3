"""Numbers, types, bits and text as column functions. A null argument gives null; what the rules call an error raises one.

Types are known when a plan is made, so functions that depend on a value's type take its DataType.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for null, true and false, in lower case.
NULLS, TRUES, FALSES = ("null", "none", "nil", "undefined"), ("true", "yes", "on"), ("false", "no", "off")
NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


# numbers


def _no(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(value)


def divide(a: Column, b: Column) -> Column:
    return _no(b == 0, "division by zero", a.cast("double") / F.when(b == 0, F.lit(1.0)).otherwise(b))


def mod(a: Column, b: Column) -> Column:
    """The remainder, with the sign of a."""
    return F.when(b == 0, F.raise_error("modulo by zero").cast("double")).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b))


def sqrt(x: Column) -> Column:
    return _no(x < 0, "square root of a negative number", F.sqrt(F.greatest(x, F.lit(0))))


def log(x: Column, base: float | None = None) -> Column:
    good = F.when(x > 0, x).otherwise(F.lit(1.0))
    return _no(x <= 0, "logarithm of a number that is not positive", F.ln(good) if base is None else F.log(float(base), good))


def asin(x: Column) -> Column:
    """Null outside -1 to 1."""
    return F.when(F.abs(x) <= 1, F.asin(x))


def acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def to_fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def format_number(x: Column, digits: int = 0, suffix: str | None = None) -> Column:
    """With commas at thousands; or scaled by a suffix k, M, B or T, or by the largest that fits for 'auto'."""
    scales = {"k": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
    plain = F.format_number(x.cast("double"), digits)
    if suffix is None:
        return plain
    scaled = lambda s: F.concat(F.format_string(f"%.{digits}f", x / scales[s]), F.lit(s))
    if suffix != "auto":
        return scaled(suffix)
    out = F.format_string(f"%.{digits}f", x.cast("double"))
    for s, size in scales.items():
        out = F.when(F.abs(x) >= size, scaled(s)).otherwise(out)
    return out


def bit_shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x.cast("long"), n)


def bit_shift_right(x: Column, n: int) -> Column:
    return F.shiftright(x.cast("long"), n)


# types


def type_name(t: T.DataType) -> str:
    """The JSON name of a type."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "null" if isinstance(t, T.NullType) else "string"


def type_of(x: Column, t: T.DataType) -> Column:
    return F.when(x.isNull(), "null").otherwise(type_name(t))


def is_type(x: Column, t: T.DataType, name: str) -> Column:
    """Whether a value has the JSON type `name`; null has the type null."""
    return x.isNull() if name == "null" else x.isNotNull() & F.lit(type_name(t) == name)


def is_empty(x: Column, t: T.DataType) -> Column:
    """Null and empty texts, arrays and objects; numbers and booleans are not empty."""
    name = type_name(t)
    if name == "string":
        return F.coalesce(x == "", F.lit(True))
    if name == "array" or isinstance(t, T.MapType):
        return F.coalesce(F.size(x) == 0, F.lit(True))
    return x.isNull()


def to_boolean(x: Column, t: T.DataType) -> Column:
    """Null, 0 and what is empty are false, all else is true; so is the text 'false'."""
    name = type_name(t)
    if name == "boolean":
        return F.coalesce(x, F.lit(False))
    return F.coalesce(x != 0, F.lit(False)) if name == "number" else ~is_empty(x, t)


def to_number(x: Column, t: T.DataType) -> Column:
    """Texts that are JSON numbers, and 1 or 0 for booleans; others give null."""
    name = type_name(t)
    if name == "string":
        return F.when(x.rlike(NUMBER), x.try_cast("double"))
    return x.cast("double") if name in ("number", "boolean") else F.lit(None).cast("double")


def to_text(x: Column, t: T.DataType) -> Column:
    """Texts as they are, other values as JSON."""
    name = type_name(t)
    if name in ("array", "object"):
        return F.to_json(x)
    return x.cast("string")


def to_array(x: Column, t: T.DataType) -> Column:
    return x if isinstance(t, T.ArrayType) else F.array(x)


def parse_nulls(s: Column) -> Column:
    return F.when(~F.lower(F.trim(s)).isin(*NULLS), s)


def parse_booleans(s: Column) -> Column:
    """True or false for texts that say so; null for others."""
    low = F.lower(F.trim(s))
    return F.when(low.isin(*TRUES), True).when(low.isin(*FALSES), False)


def parse_numbers(s: Column) -> Column:
    return F.when(F.trim(s).rlike(NUMBER), F.trim(s).try_cast("double"))


def auto_parse(s: Column) -> Column:
    """What a text stands for, as VARIANT: null, a boolean, a number, or the text itself."""
    low, text = F.lower(F.trim(s)), F.to_json(F.array(s))
    json = F.when(low.isin(*NULLS), "null").when(low.isin(*TRUES), "true").when(low.isin(*FALSES), "false").when(F.trim(s).rlike(NUMBER), F.trim(s)).otherwise(F.substr(text, F.lit(2), F.length(text) - 2))
    return F.parse_json(json)


def if_(condition: Column, t: T.DataType, then: Column, other: Column) -> Column:
    return F.when(to_boolean(condition, t), then).otherwise(other)


def get_env(name: str) -> Column:
    """A variable of the driver's environment, when the plan is made."""
    return F.lit(os.environ.get(name))


def now() -> Column:
    return F.unix_timestamp()


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


# text

# The ASCII forms of the accented letters of Latin-1 and Latin Extended-A.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
LIGATURES = {"Æ": "AE", "æ": "ae", "ß": "ss", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "Œ": "OE", "œ": "oe"}
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


def deburr(s: Column) -> Column:
    out = F.translate(s, ACCENTED, UNACCENTED)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape(s: Column) -> Column:
    for a, b in ENTITIES.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape(s: Column) -> Column:
    for a, b in reversed(ENTITIES.items()):
        s = F.replace(s, F.lit(b), F.lit(a))
    return s


def title(s: Column) -> Column:
    """Words between white space, each with a capital first letter; single spaces between them."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")


def explode_text(s: Column) -> Column:
    """Code points, in order."""
    return F.when(s == "", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii))


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """From a place counted from 0, or from the end if negative."""
    at = F.lit(start) if start >= 0 else F.greatest(F.length(s) + start, F.lit(0))
    return F.substr(s, at + 1, F.lit(2**31 - 1 if length is None else length))


def inside(sub: Column, s: Column) -> Column:
    return F.contains(s, sub)


def trim_left(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s\u0085  -     　]+", "")


def trim_right(s: Column) -> Column:
    return F.regexp_replace(s, r"[\s\u0085  -     　]+$", "")


def wrap(s: Column, width: int) -> Column:
    """Lines of up to `width` bytes where words allow it; each line of the text is filled by itself."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, w: Column) -> Column:
        n = F.octet_length(w)
        fits = a["at"] + 1 + n <= width
        out = F.when(a["at"] == 0, F.concat(a["out"], w)).otherwise(F.concat(a["out"], F.when(fits, " ").otherwise("\n"), w))
        return F.struct(out.alias("out"), F.when((a["at"] > 0) & fits, a["at"] + 1 + n).otherwise(n).alias("at"))

    filled = lambda line: F.aggregate(F.filter(F.split(line, r"\s+"), lambda w: w != ""), start, step, lambda a: a["out"])
    return F.array_join(F.transform(F.split(s, "\n", -1), filled), "\n")


def format_text(template: str, *values: Column, **named: Column) -> Column:
    """{0} and {name} are replaced by values; a template known when the plan is made."""
    out = F.lit(template)
    for key, value in [*((str(i), v) for i, v in enumerate(values)), *named.items()]:
        out = F.replace(out, F.lit("{" + key + "}"), value.cast("string"))
    return out


def template(text: str, values: dict[str, Column], strict: bool = False) -> Column:
    """{{name}} is replaced by its value as text; a missing or null one by nothing, or, if strict, all is null."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([\w.]+)\s*\}\}", text):
        value = values[m[1]].cast("string") if m[1] in values else F.lit(None).cast("string")
        parts += [F.lit(text[at : m.start()]), value if strict else F.coalesce(value, F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def regex_extract(s: Column, pattern: str) -> Column:
    """All matches; null for none."""
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, found)


def regex_split(s: Column, pattern: str) -> Column:
    return F.split(s, pattern, -1)


def url_encode(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(s: Column) -> Column:
    """A plus sign stays one."""
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def url_build(scheme: Column, host: Column, path: Column | None = None, query: Column | None = None, fragment: Column | None = None) -> Column:
    parts = [scheme, F.lit("://"), host]
    for mark, part in (("", path), ("?", query), ("#", fragment)):
        if part is not None:
            parts.append(F.when(part.isNull() | (part == ""), "").otherwise(F.concat(F.lit(mark), part)))
    return F.concat(*parts)


def hmac(s: Column, key: str, algorithm: str) -> Column:
    """Lower-case hexadecimal HMAC with a key known when the plan is made: md5, sha1, sha256 or sha512."""
    block = 128 if algorithm == "sha512" else 64
    hashed = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512)}[algorithm]
    raw = key.encode()
    raw = (hashlib.new(algorithm, raw).digest() if len(raw) > block else raw).ljust(block, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return hashed(F.concat(outer, F.unhex(hashed(F.concat(inner, s.cast("binary"))))))


def _field(x: Column, sep: str) -> Column:
    """RFC 4180: quoted if it holds a separator, a quote or a line break."""
    text = F.coalesce(x, F.lit(""))
    return F.when(text.rlike(f'["\\r\\n{sep}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def to_csv(a: Column, sep: str = ",") -> Column:
    """An array of texts as one row."""
    return F.array_join(F.transform(a, lambda x: _field(x, sep)), sep)


def to_csv_rows(rows: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(rows, lambda r: to_csv(r, sep)), "\n")


def to_csv_table(rows: Column, names: list[str], sep: str = ",") -> Column:
    """An array of structs with a line of names before it."""
    head = sep.join('"' + n.replace('"', '""') + '"' if any(c in n for c in f'"\r\n{sep}') else n for n in names)
    lines = F.transform(rows, lambda r: to_csv(F.array(*[r[n].cast("string") for n in names]), sep))
    return F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"))


def from_csv(s: Column, sep: str = ",") -> Column:
    """Rows of texts; line breaks and separators within quotes belong to their field, and empty lines are left out."""
    row = r'(?:"(?:[^"]|"")*"|[^"\r\n])+'
    field = rf'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}"]*)'
    plain = lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.regexp_extract_all(s, F.lit(row), F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(field), F.lit(1)), plain))
