"""Times as column functions. Moments are seconds since 1970, timestamps, or texts; texts that cannot be read give null. All in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Forms of dates and times that are read, the first that fits.
FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "dd-MMM-yyyy",
)


def read(s: Column, form: str | None = None) -> Column:
    """A timestamp of a text; a text of digits is seconds."""
    forms = (form,) if form else FORMS
    plain = F.when(s.rlike(r"^-?\d{6,12}$"), F.timestamp_seconds(s.try_cast("long")))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms], plain if not form else F.lit(None).cast("timestamp"))


def parse_date(s: Column, form: str | None = None) -> Column:
    """Seconds since 1970."""
    return F.unix_timestamp(read(s, form))


def iso(t: Column) -> Column:
    return F.date_format(t, ISO)


def parse_datetime(s: Column) -> Column:
    return iso(read(s))


def from_epoch(seconds: Column) -> Column:
    return iso(F.timestamp_seconds(F.floor(seconds).cast("long")))


def from_epoch_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_epoch_ms(t: Column) -> Column:
    return F.unix_millis(t)


def date_add(seconds: Column, n: Column | int, unit: str) -> Column:
    if unit not in UNITS:
        raise ValueError(f"no unit of time: {unit}")
    return seconds + (F.lit(n) if isinstance(n, int) else n) * UNITS[unit]


def is_before(a: Column, b: Column) -> Column:
    return a < b


def is_after(a: Column, b: Column) -> Column:
    return a > b


def is_between(t: Column, low: Column, high: Column) -> Column:
    return t.between(low, high)


def is_same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def is_weekday(t: Column) -> Column:
    return F.weekday(t) < 5


def timezone_convert(s: Column, source: str, target: str) -> Column:
    """A local time of one zone as that of another."""
    local = F.try_to_timestamp(s, F.lit("yyyy-MM-dd['T'][' ']HH:mm:ss")).cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.lit(source), F.lit(target), local), "yyyy-MM-dd'T'HH:mm:ss")


def duration_since(t: Column, now: Column | None = None) -> Column:
    """Totals of seconds, minutes, hours and days from t to now, whether t lies ahead, and words for it."""
    gap = (now if now is not None else F.current_timestamp()).cast("long") - t.cast("long")
    n = F.abs(gap)
    words = F.lit("1 second")
    for unit, size in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400)):
        k = F.floor(n / size)
        words = F.when((n >= size) | F.lit(size == 1), F.concat(k.cast("string"), F.lit(f" {unit}"), F.when(k == 1, "").otherwise("s"))).otherwise(words)
    human = F.when(gap < 0, F.concat(F.lit("in "), words)).otherwise(F.concat(words, F.lit(" ago")))
    whole = lambda size: F.floor(n / size).alias({1: "seconds", 60: "minutes", 3600: "hours", 86400: "days"}[size])
    return F.when(gap.isNotNull(), F.struct(*map(whole, (1, 60, 3600, 86400)), (gap < 0).alias("is_future"), human.alias("human")))


def relative_time(t: Column, now: Column | None = None) -> Column:
    return duration_since(t, now)["human"]


# Names of the days from Monday on, and lengths of the units that phrases name.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
PHRASES = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def parse_natural_date(s: Column, now: Column | None = None) -> Column:
    """'today', 'yesterday', 'tomorrow', '3 days ago', 'in 2 weeks', 'next friday', 'last monday' and readable dates, as ISO text.

    Days stand for their midnight, smaller units for the moment itself; months and years keep the day where the calendar has it."""
    at = now if now is not None else F.current_timestamp()
    low, day = F.lower(F.trim(s)), F.date_trunc("day", at)
    n = F.regexp_extract(low, r"(\d+) (?:second|minute|hour|day|week|month|year)s?", 1).try_cast("int")
    n = F.when(low.rlike(" ago$"), -n).otherwise(n)
    out = F.when(low == "now", at).when(low == "today", day).when(low == "yesterday", day - F.expr("INTERVAL 1 DAY")).when(low == "tomorrow", day + F.expr("INTERVAL 1 DAY"))
    for unit, size in PHRASES.items():
        moved = F.timestamp_seconds(at.cast("long") + n * size)
        out = out.when(low.rlike(rf"^(\d+ {unit}s? ago|in \d+ {unit}s?)$"), F.date_trunc("day", moved) if size >= 86400 else moved)
    for unit, months in (("month", 1), ("year", 12)):
        out = out.when(low.rlike(rf"^(\d+ {unit}s? ago|in \d+ {unit}s?)$"), F.add_months(day, n * months).cast("timestamp"))
    for i, name in enumerate(DAYS):
        ahead = F.pmod(F.lit(i) - F.weekday(at), F.lit(7))
        out = out.when(low == f"next {name}", F.date_add(F.to_date(at), F.when(ahead == 0, 7).otherwise(ahead)).cast("timestamp"))
        out = out.when(low == f"last {name}", F.date_sub(F.to_date(at), F.when(ahead == 0, 7).otherwise(7 - ahead)).cast("timestamp"))
    return iso(out.otherwise(read(s)))
