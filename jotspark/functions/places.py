"""Circles and boxes on the globe, address blocks, version ranges, and path and address parts as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jotspark.functions.formats import GEOHASH, semver_compare
from jotspark.functions.values import geo_distance, int_to_ip, ip_to_int

#: Fixed value: metres in a mile.
MILE = 1609.344


def geo_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return geo_distance(lat1, lon1, lat2, lon2) / 1000


def geo_distance_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return geo_distance(lat1, lon1, lat2, lon2) / MILE


def geo_in_radius(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    return geo_distance(lat, lon, F.lit(lat0), F.lit(lon0)) <= metres


def geo_midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct lat, lon: the middle of the great circle."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x, y = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt((F.cos(a) + x) * (F.cos(a) + x) + y * y))
    lon = F.degrees(F.radians(lon1) + F.atan2(y, F.cos(a) + x))
    return F.struct(F.degrees(lat).alias("lat"), (F.pmod(lon + 540, F.lit(360.0)) - 180).alias("lon"))


def geo_bounding_box(points: Column) -> Column:
    """Struct south, west, north, east of an array of structs lat, lon; null for none."""
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    box = F.struct(F.array_min(lat).alias("south"), F.array_min(lon).alias("west"), F.array_max(lat).alias("north"), F.array_max(lon).alias("east"))
    return F.when(F.size(points) > 0, box)


def geohash_decode(s: Column) -> Column:
    """Struct lat, lon: the middle of the cell; null where a character is no geohash digit."""
    low = F.lower(s)
    digits = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.instr(F.lit(GEOHASH), c) - 1)
    bits = F.flatten(F.transform(digits, lambda d: F.array(*[F.shiftright(d, i).bitwiseAND(1) for i in (4, 3, 2, 1, 0)])))

    def middle(odd: int, half: float) -> Column:
        mine = F.filter(bits, lambda b, i: i % 2 == odd)
        step = lambda acc, b: F.struct((acc["x"] + F.when(b == 1, acc["w"]).otherwise(-acc["w"])).alias("x"), (acc["w"] / 2).alias("w"))
        return F.aggregate(mine, F.struct(F.lit(0.0).alias("x"), F.lit(half / 2).alias("w")), step)["x"]

    return F.when(low.rlike(f"^[{GEOHASH}]+$"), F.struct(middle(1, 90.0).alias("lat"), middle(0, 180.0).alias("lon")))


def cidr_prefix(cidr: Column) -> Column:
    """Bits of the prefix, 0 to 32; null for what is no block of addresses."""
    bits = F.regexp_extract(cidr, r"^[0-9.]+/(\d{1,2})$", 1).try_cast("int")
    return F.when((bits <= 32) & ip_to_int(F.split_part(cidr, F.lit("/"), F.lit(1))).isNotNull(), bits)


def _block(cidr: Column) -> tuple[Column, Column]:
    size = F.pow(F.lit(2.0), 32 - cidr_prefix(cidr)).cast("long")
    ip = ip_to_int(F.split_part(cidr, F.lit("/"), F.lit(1)))
    return ip - F.pmod(ip, size), size


def cidr_network(cidr: Column) -> Column:
    return int_to_ip(_block(cidr)[0])


def cidr_broadcast(cidr: Column) -> Column:
    first, size = _block(cidr)
    return int_to_ip(first + size - 1)


def semver_part(s: Column, part: str) -> Column:
    """part: major, minor or patch."""
    place = ("major", "minor", "patch").index(part) + 1
    return F.regexp_extract(s, r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$", place).try_cast("long")


def semver_satisfies(s: Column, wanted: str) -> Column:
    """wanted: comparisons joined by commas, each of >=, >, <=, <, =, ^ or ~ and a version; a bare version counts as ^. Parts left
    out or given as x or * are free, and || joins alternatives."""
    if "||" in wanted:
        out = F.lit(False)
        for one in wanted.split("||"):
            out = out | semver_satisfies(s, one)
        return out
    out = F.lit(True)
    for part in wanted.split(","):
        part = part.strip()
        free = re.fullmatch(r"[\^~=]?\s*v?(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?", part)
        fixed = [int(x) for x in free.groups() if x and x.isdigit()] if free else []
        if free and len(fixed) < 3:
            parts = [semver_part(s, p) for p in ("major", "minor", "patch")]
            out = out & semver_part(s, "major").isNotNull()
            if part[:1] == "^" and len(fixed) == 2 and fixed[0] > 0:
                out = out & (parts[0] == fixed[0]) & (parts[1] >= fixed[1])
            else:
                for have, want in zip(parts, fixed, strict=False):
                    out = out & (have == want)
            continue
        sign = next((x for x in (">=", "<=", ">", "<", "=", "^", "~") if part.startswith(x)), "^")
        version = part.removeprefix(sign).strip()
        c = semver_compare(s, F.lit(version))
        if sign in "^~":
            n = [int(x) for x in version.split("-")[0].split("+")[0].split(".")]
            at = 1 if sign == "~" else next((i for i, x in enumerate(n) if x), 2)
            top = [*n[:at], n[at] + 1, 0, 0][:3]
            parts = [semver_part(s, p) for p in ("major", "minor", "patch")]
            below = F.struct(*parts) < F.struct(*[F.lit(x).cast("long") for x in top])
            out = out & (c >= 0) & below
        else:
            out = out & {">=": c >= 0, "<=": c <= 0, ">": c > 0, "<": c < 0, "=": c == 0}[sign]
    return out


def path_join(*parts: Column) -> Column:
    """Parts with single slashes between; an absolute part starts anew."""
    out = parts[0]
    for p in parts[1:]:
        out = F.when(p.startswith("/") | (out == ""), p).otherwise(F.concat(F.regexp_replace(out, "/+$", ""), F.lit("/"), p))
    return out


def query_string_parse(s: Column) -> Column:
    """Map of names to decoded values; of repeated names the last counts."""
    rows = F.filter(F.split(F.regexp_replace(s, r"^\?", ""), "&"), lambda x: x != "")
    name = lambda x: F.try_url_decode(F.split_part(x, F.lit("="), F.lit(1)))
    names = F.transform(rows, name)
    last = F.filter(rows, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), name(x)) & name(x).isNotNull())
    return F.map_from_entries(F.transform(last, lambda x: F.struct(name(x).alias("k"), F.try_url_decode(F.regexp_replace(x, "^[^=]*=?", "")).alias("v"))))


def query_string_build(m: Column) -> Column:
    """Names in order, values encoded."""
    names = F.array_sort(F.map_keys(m))
    return F.array_join(F.transform(names, lambda k: F.concat(F.url_encode(k), F.lit("="), F.url_encode(F.coalesce(F.element_at(m, k), F.lit(""))))), "&")


def color_mix(a: Column, b: Column) -> Column:
    """Mean of two colours as #rrggbb, halves rounded up; null for what is no colour."""

    def channel(i: int) -> Column:
        x, y = (F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int") for c in (a, b))
        return F.lpad(F.lower(F.hex(F.floor((x + y + 1) / 2).cast("long"))), 2, "0")

    whole = a.rlike("(?i)^#[0-9a-f]{6}$") & b.rlike("(?i)^#[0-9a-f]{6}$")
    return F.when(whole, F.concat(F.lit("#"), channel(0), channel(1), channel(2)))
