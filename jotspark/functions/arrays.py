"""Array functions: order is kept, indices start at 0, null arrays give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i)) if i >= 0 else F.get(a, F.size(a) + i)


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return index_at(a, -1)


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n) if n > 0 else F.slice(a, 1, 0)


def drop(a: Column, n: int) -> Column:
    return F.filter(a, lambda x, i: i >= n)


def tail(a: Column) -> Column:
    return drop(a, 1)


def butlast(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def slice_step(a: Column, start: int | None, stop: int | None, step: int = 1) -> Column:
    """a[start:stop:step] with the usual meaning of negative values."""
    if step == 0:
        raise ValueError("a slice's step cannot be 0")
    n = F.size(a)
    at = lambda v, low, high: F.least(F.greatest(F.lit(v) + F.when(F.lit(v) < 0, n).otherwise(0), low), high)
    if step > 0:
        lo = F.lit(0) if start is None else at(start, F.lit(0), n)
        hi = n if stop is None else at(stop, F.lit(0), n)
        return F.filter(a, lambda x, i: (i >= lo) & (i < hi) & ((i - lo) % step == 0))
    hi = n - 1 if start is None else at(start, F.lit(-1), n - 1)
    lo = F.lit(-1) if stop is None else at(stop, F.lit(-1), n - 1)
    return F.reverse(F.filter(a, lambda x, i: (i <= hi) & (i > lo) & ((hi - i) % -step == 0)))


def chunk(a: Column, size: int) -> Column:
    n = F.ceil(F.size(a) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * size + 1, F.lit(size)))).otherwise(F.slice(F.array(a), 1, 0))


def sliding_window(a: Column, size: int) -> Column:
    n = F.size(a) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(a, i + 1, F.lit(size)))).otherwise(F.slice(F.array(a), 1, 0))


def pairwise(a: Column) -> Column:
    return sliding_window(a, 2)


def dedupe(a: Column) -> Column:
    """Runs of equal neighbours become one."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def rotate(a: Column, n: int) -> Column:
    k = F.pmod(F.lit(n), F.greatest(F.size(a), F.lit(1)))
    return F.concat(F.filter(a, lambda x, i: i >= k), F.filter(a, lambda x, i: i < k))


def frequencies(a: Column) -> Column:
    """Map of each element as text to how often it occurs; nulls count as 'null'. Equal elements are counted as runs of the sorted array."""
    text = F.array_sort(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("null"))))
    n = F.size(text)

    def counted(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n + 1))
        return F.map_from_arrays(F.transform(starts, lambda i: F.element_at(t, i)), F.zip_with(starts, ends, lambda i, j: (j - i).cast("long")))

    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return F.when(n == 0, empty).otherwise(F.element_at(F.transform(F.array(text), counted), 1))


def cumulative_sum(a: Column, kind: str = "double") -> Column:
    """Running totals in the type `kind`: 'long' keeps whole numbers exact."""
    start = F.struct(F.lit(0).cast(kind).alias("sum"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda s, x: F.struct((s["sum"] + x.cast(kind)).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x.cast(kind))).alias("out"))
    return F.aggregate(a, start, step, lambda s: s["out"])


def xor(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(F.size(a), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
