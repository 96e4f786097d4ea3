"""Statistics of number arrays within a row; empty and null arrays give null. Across rows Spark's own aggregates do the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def moment(a: Column, k: int) -> Column:
    m = mean(a)
    return mean(F.transform(a, lambda x: F.pow(x - m, F.lit(k))))


def variance(a: Column) -> Column:
    return moment(a, 2)


def stddev(a: Column) -> Column:
    return F.sqrt(variance(a))


def quantile(a: Column, q: float) -> Column:
    """Linear between neighbours; null for q outside 0 to 1."""
    s = F.array_sort(F.transform(a, lambda x: x.cast("double")))
    at = (F.size(s) - 1) * F.lit(float(q))
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return F.when((F.size(s) > 0) & F.lit(0 <= q <= 1), low + (high - low) * (at - F.floor(at)))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def quartiles(a: Column) -> Column:
    q = {n: quantile(a, v) for n, v in (("min", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("max", 1.0))}
    return F.struct(*[c.alias(n) for n, c in q.items()], (q["q3"] - q["q1"]).alias("iqr"))


def mad(a: Column) -> Column:
    m = median(a)
    return median(F.transform(a, lambda x: F.abs(x - m)))


def z_scores(a: Column) -> Column:
    m, s = mean(a), stddev(a)
    return F.transform(a, lambda x: F.when(s == 0, 0.0).otherwise((x - m) / F.nullif(s, F.lit(0.0))))


def normalize(a: Column) -> Column:
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.when(low == high, 0.0).otherwise((x - low) / F.nullif(high - low, F.lit(0)).cast("double")))


def covariance(a: Column, b: Column) -> Column:
    x, y = mean(a), mean(b)
    return F.when(F.size(a) == F.size(b), mean(F.zip_with(a, b, lambda p, q: (p - x) * (q - y))))


def correlation(a: Column, b: Column) -> Column:
    """0 where one side does not vary."""
    s = stddev(a) * stddev(b)
    return F.when(s == 0, 0.0).otherwise(covariance(a, b) / F.nullif(s, F.lit(0.0)))


def trend_slope(a: Column) -> Column:
    """Least squares over the places 0, 1, ...; 0 for fewer than two numbers."""
    i = F.transform(a, lambda x, i: i.cast("double"))
    v = variance(i)
    return F.when(F.size(a) < 2, 0.0).otherwise(covariance(i, a) / F.nullif(v, F.lit(0.0)))


def skew(a: Column) -> Column:
    s = stddev(a)
    return F.when(F.size(a) < 3, None).when(s == 0, 0.0).otherwise(moment(a, 3) / F.nullif(F.pow(s, 3), F.lit(0.0)))


def kurtosis(a: Column) -> Column:
    v = variance(a)
    return F.when(F.size(a) < 4, None).when(v == 0, 0.0).otherwise(moment(a, 4) / F.nullif(v * v, F.lit(0.0)) - 3)


def rate_of_change(a: Column) -> Column:
    """Percent from each number to the next; 0 after a 0."""
    pairs = F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.filter(a, lambda x, i: i > 0), lambda p, x: F.when(p == 0, 0.0).otherwise((x - p) / F.nullif(p, F.lit(0)) * 100.0))
    return pairs


def ewma(a: Column, alpha: float) -> Column:
    empty = F.array().cast("array<double>")
    return F.aggregate(a, empty, lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x.cast("double")).otherwise(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) * (1 - alpha) + x * alpha))))


def moving_average(a: Column, size: int) -> Column:
    """Null until a window is full; empty for windows over the array's length."""
    full = F.transform(a, lambda _, i: F.when(i >= size - 1, total(F.slice(a, F.greatest(i - size + 2, F.lit(1)), F.lit(size))) / size))
    return F.when(F.size(a) >= size, full).otherwise(F.array().cast("array<double>"))
