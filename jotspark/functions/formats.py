"""Durations, sizes, versions, paths, colours, units and geohashes as column functions; what cannot be read gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds, bytes and factors to metres, kilograms and litres.
SECONDS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}
DURATION = r"^(\s*\d+\s*(w|weeks?|d|days?|h|hrs?|hours?|m|mins?|minutes?|s|secs?|seconds?)?)+\s*$"
BYTES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50}
LENGTH = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "ft": 0.3048, "in": 0.0254, "yd": 0.9144, "nmi": 1852.0}
MASS = {"kg": 1.0, "g": 0.001, "mg": 0.000001, "lbs": 0.45359237, "oz": 0.028349523125, "t": 1000.0, "st": 6.35029318}
VOLUME = {"l": 1.0, "ml": 0.001, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "cup": 0.2365882365, "floz": 0.0295735295625, "tbsp": 0.0147867647813, "tsp": 0.00492892159375}
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def parse_duration(s: Column) -> Column:
    """Seconds of texts such as '1h 30m'; a bare number is seconds."""
    low = F.lower(s)
    pairs = F.zip_with(F.regexp_extract_all(low, F.lit(r"(\d+)\s*([a-z]*)"), F.lit(1)), F.regexp_extract_all(low, F.lit(r"(\d+)\s*([a-z]*)"), F.lit(2)), lambda n, u: n.try_cast("long") * F.when(u == "", F.lit(1)).otherwise(_lookup(F.left(u, F.lit(1)), SECONDS)))
    return F.when(low.rlike(DURATION), F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x))


def format_duration(seconds: Column) -> Column:
    """Parts that are not 0, as in '1d2h'; '0s' for none."""
    x = F.floor(seconds).cast("long")
    parts, above = [], None
    for unit, size in SECONDS.items():
        n = F.floor((x if above is None else F.pmod(x, F.lit(above))) / size).cast("long")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(""))
        above = size
    return F.when(x == 0, "0s").otherwise(F.concat(*parts))


def duration_part(seconds: Column, unit: str) -> Column:
    """The component of days, hours, minutes or seconds, not the total."""
    size, wrap = {"d": (86400, 7), "h": (3600, 24), "m": (60, 60), "s": (1, 60)}[unit]
    return F.pmod(F.floor(seconds / size), F.lit(wrap)).cast("long")


def duration_add(a: Column, b: Column) -> Column:
    return format_duration(parse_duration(a) + parse_duration(b))


def duration_subtract(a: Column, b: Column) -> Column:
    return format_duration(F.greatest(parse_duration(a) - parse_duration(b), F.lit(0)))


def parse_bytes(s: Column) -> Column:
    p = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)\s*$"
    low = F.lower(s)
    unit = F.regexp_extract(low, p, 2)
    return F.regexp_extract(low, p, 1).try_cast("double") * _lookup(F.when(unit == "", "b").otherwise(unit), BYTES)


_SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def semver_key(s: Column) -> Column:
    """Sorts as versions do: numbers, then pre-releases before the release; numeric parts before words."""
    part = lambda i: F.regexp_extract(s, _SEMVER, i)
    pre = F.transform(F.split(part(4), r"\."), lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.coalesce(F.when(x.rlike(r"^\d+$"), x.try_cast("decimal(38,0)")), F.lit(0)).alias("n"), x.alias("x")))
    return F.when(s.rlike(_SEMVER), F.struct(*[part(i).try_cast("long").alias(f"n{i}") for i in (1, 2, 3)], (part(4) == "").alias("release"), pre.alias("pre")))


def semver_is_valid(s: Column) -> Column:
    return s.rlike(_SEMVER)


def semver_compare(a: Column, b: Column) -> Column:
    x, y = semver_key(a), semver_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def path_basename(s: Column) -> Column:
    return F.regexp_extract(s, r"([^/]*)/*$", 1)


def path_dirname(s: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(s, r"(?<=.)/+$", ""), r"^(.*)/", 1)


def path_ext(s: Column) -> Column:
    """With its dot; empty for none."""
    return F.regexp_extract(path_basename(s), r"[^.](\.[^.]+)$", 1)


def path_stem(s: Column) -> Column:
    b = path_basename(s)
    return F.nullif(F.regexp_replace(b, r"(?<=.)\.[^.]*$", ""), F.lit(""))


def path_is_absolute(s: Column) -> Column:
    return s.startswith("/")


def _channels(c: Column) -> list[Column]:
    """Numbers of '#rrggbb' or '#rgb'; null for other texts."""
    h = F.regexp_replace(F.lower(c), "^#", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    h = F.when(h.rlike("^[0-9a-f]{6}$"), h)
    return [F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    ints = [x.cast("int") for x in (r, g, b)]
    known = ints[0].isNotNull() & ints[1].isNotNull() & ints[2].isNotNull()
    return F.when(known, F.format_string("#%02x%02x%02x", *ints))


def hex_to_rgb(c: Column) -> Column:
    r, g, b = _channels(c)
    return F.when(r.isNotNull(), F.struct(r.alias("r"), g.alias("g"), b.alias("b")))


def lighten(c: Column, percent: float) -> Column:
    k = min(max(percent / 100, 0.0), 1.0)
    return rgb_to_hex(*[F.round(x + (255 - x) * k) for x in _channels(c)])


def darken(c: Column, percent: float) -> Column:
    k = 1 - min(max(percent / 100, 0.0), 1.0)
    return rgb_to_hex(*[F.round(x * k) for x in _channels(c)])


def color_invert(c: Column) -> Column:
    return rgb_to_hex(*[255 - x for x in _channels(c)])


def color_grayscale(c: Column) -> Column:
    r, g, b = _channels(c)
    y = F.round(r * 0.299 + g * 0.587 + b * 0.114)
    return rgb_to_hex(y, y, y)


def color_complement(c: Column) -> Column:
    """The hue turned by half: each channel mirrored between the least and the highest."""
    x = _channels(c)
    return rgb_to_hex(*[F.least(*x) + F.greatest(*x) - v for v in x])


def convert(x: Column, of: str, to: str, factors: dict[str, float]) -> Column:
    """LENGTH, MASS or VOLUME by their short names."""
    return x * factors[of] / factors[to]


def convert_temperature(x: Column, of: str, to: str) -> Column:
    c = {"C": x, "F": (x - 32.0) * 5.0 / 9.0, "K": x - 273.15}[of]
    return {"C": c, "F": c * 9.0 / 5.0 + 32.0, "K": c + 273.15}[to]


def geo_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turn + 360, F.lit(360.0))


def geo_in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def geohash_encode(lat: Column, lon: Column, precision: int = 12) -> Column:
    """Cells of longitude and latitude as whole numbers, their bits taken in turn, longitude first."""
    bits = precision * 5
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda x, low, span, n: F.least(F.floor((x - low) / span * 2.0**n), F.lit(2**n - 1)).cast("long")
    x, y = cell(lon, -180, 360, n_lon), cell(lat, -90, 180, n_lat)
    bit = lambda i: F.shiftright(x, n_lon - 1 - i // 2).bitwiseAND(1) if i % 2 == 0 else F.shiftright(y, n_lat - 1 - i // 2).bitwiseAND(1)
    chars = [F.substring(F.lit(GEOHASH), (sum((bit(5 * k + j) * 2 ** (4 - j) for j in range(5)), F.lit(0)) + 1).cast("int"), F.lit(1)) for k in range(precision)]
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(*chars))
