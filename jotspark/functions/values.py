"""Dates, numbers, network addresses, geography, units and checks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def is_weekend(t: Column) -> Column:
    return F.dayofweek(t).isin(1, 7)


def start_of(unit: str, t: Column) -> Column:
    return F.date_trunc(unit, t)


def end_of_day(t: Column) -> Column:
    return F.date_trunc("day", t) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def to_epoch(t: Column) -> Column:
    return F.unix_timestamp(t)


def date_diff_days(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def business_days_between(a: Column, b: Column) -> Column:
    """Days from Monday to Friday from a (in) to b (out), for a <= b."""
    whole, from_monday = F.datediff(b, a), F.weekday(a)
    rest = whole % 7
    extra = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when((i < rest) & (F.pmod(from_monday + i, F.lit(7)) < 5), 1).otherwise(0))
    return F.floor(whole / 7) * 5 + F.aggregate(extra, F.lit(0), lambda s, x: s + x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def geo_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.asin(F.sqrt(a)) * 2 * EARTH_M


def ip_to_int(s: Column) -> Column:
    p = F.split(s, r"\.")
    ok = s.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n * 256 + x.try_cast("long")))


def int_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])


def cidr_contains(cidr: str, ip: Column) -> Column:
    net, bits = cidr.split("/")
    base = 0
    for part in net.split("."):
        base = base * 256 + int(part)
    size = 1 << (32 - int(bits))
    return F.floor(ip_to_int(ip) / size) == base // size


def is_private_ip(ip: Column) -> Column:
    return cidr_contains("10.0.0.0/8", ip) | cidr_contains("172.16.0.0/12", ip) | cidr_contains("192.168.0.0/16", ip)


def url_parse(u: Column) -> Column:
    return F.struct(F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(u, F.lit("HOST")).alias("host"), F.try_parse_url(u, F.lit("PATH")).alias("path"), F.try_parse_url(u, F.lit("QUERY")).alias("query"))


def format_bytes(n: Column, base: int = 1000) -> Column:
    units = ("B", "KB", "MB", "GB", "TB", "PB") if base == 1000 else ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(n >= base**k, F.concat(F.format_string("%.2f", n / float(base**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def celsius_to_fahrenheit(x: Column) -> Column:
    return x * 9 / 5 + 32


def luhn_check(s: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(s, r"[\s-]", ""))


def is_email(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def truthy(x: Column, kind: str) -> Column:
    """Null, false, empty texts, arrays and maps count as false; every number as true."""
    if kind == "boolean":
        return F.coalesce(x, F.lit(False))
    if kind == "string":
        return F.coalesce(x != "", F.lit(False))
    return F.coalesce(F.size(x) > 0, F.lit(False)) if kind.startswith(("array", "map")) else x.isNotNull()
