"""More functions of arrays and maps: building, searching, folding and reshaping; null arrays give null.

Folds that keep every step copy what they have at each one, so they are meant for arrays of a row, not for whole tables: there,
use a window (operators/tables.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jotspark.functions.maps import from_items

#: Elements that range() gives at most, and steps that a loop may take.
RANGE_MOST, STEPS_MOST = 10_000, 100_000


def number_range(start: int, stop: int, step: int = 1) -> Column:
    """start, start + step and so on, before stop; the first 10,000 of them."""
    if step == 0:
        raise ValueError("a range's step cannot be 0")
    n = min(max(0, -(-(stop - start) // step)), RANGE_MOST)
    return F.sequence(F.lit(start), F.lit(start + (n - 1) * step), F.lit(step)) if n else F.array().cast("array<int>")


def zip_arrays(a: Column, b: Column) -> Column:
    """Pairs, up to the shorter one's end."""
    return zip_with(a, b, lambda x, y: F.array(x, y))


def zip_with(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), fn)


def transpose(rows: Column) -> Column:
    """Columns of an array of rows, as far as the first row goes."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: F.transform(rows, lambda r: F.get(r, j)))).otherwise(F.slice(rows, 1, 0))


def flatten_deep(a: Column, depth: int) -> Column:
    """All levels of nested arrays in one; depth: how many levels the type has below the first."""
    for _ in range(depth):
        a = F.flatten(a)
    return a


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def includes(a: Column, x: Column) -> Column:
    return F.exists(a, lambda y: y.eqNullSafe(x))


def indices_of(a: Column, x: Column) -> Column:
    """All places, from 0, of a value."""
    return F.filter(F.transform(a, lambda y, i: F.when(y.eqNullSafe(x), i)), lambda i: i.isNotNull())


def all_inside(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def bsearch(a: Column, x: Column) -> Column:
    """Place of x in a sorted array, or -(place to insert it) - 1."""
    before = F.size(F.filter(a, lambda y: y < x))
    return F.when(F.array_contains(a, x), before).otherwise(-before - 1)


def partition_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """Runs of neighbours with equal keys, in order."""
    def cut(x: Column) -> Column:
        keys = F.transform(x, key)
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | ~F.get(keys, i).eqNullSafe(F.get(keys, F.greatest(i - 1, F.lit(0)))))
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(x)))
        return F.zip_with(starts, ends, lambda i, j: F.slice(x, i + 1, j - i))

    return F.when(F.size(a) > 0, F.element_at(F.transform(F.array(a), cut), 1)).otherwise(F.slice(F.array(a), 1, 0))


def repeat_array(x: Column, n: int) -> Column:
    return F.array_repeat(x, n)


def every_nth(a: Column, n: int) -> Column:
    return F.filter(a, lambda x, i: i % n == 0)


def fill(a: Column, value: Column, start: int = 0, stop: int | None = None) -> Column:
    """The value in the places from start to before stop; negative ones count from the end."""
    at = lambda v: F.lit(v) if v >= 0 else F.greatest(F.size(a) + v, F.lit(0))
    low, high = at(start), F.size(a) if stop is None else at(stop)
    return F.transform(a, lambda x, i: F.when((i >= low) & (i < high), value).otherwise(x))


def mode(a: Column) -> Column:
    """The most frequent element; of several, the one that comes first."""
    counted = F.transform(a, lambda x, i: F.struct(F.size(F.filter(a, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(counted)["x"]


def percentile(a: Column, p: float) -> Column:
    """Between neighbours, as far as the rank lies between them."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies between 0 and 100")

    def at(s: Column) -> Column:
        rank = (F.size(s) - 1) * F.lit(p / 100.0)
        low = F.floor(rank).cast("int")
        x, y = F.get(s, low).cast("double"), F.get(s, F.ceil(rank).cast("int")).cast("double")
        return x + (y - x) * (rank - low)

    return F.element_at(F.transform(F.array(F.array_sort(a)), at), 1)


def outliers_zscore(a: Column, most: float = 3.0) -> Column:
    """Elements more than `most` population standard deviations from the mean; none if all are equal."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.when(sd > 0, F.filter(a, lambda x: F.abs(x - mean) / sd > most)).otherwise(F.slice(a, 1, 0))


# folds and loops


def fold(a: Column, start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """step(so far, element, place) over all elements."""
    first = F.struct(start.alias("so_far"), F.lit(0).alias("place"))
    return F.aggregate(a, first, lambda s, x: F.struct(step(s["so_far"], x, s["place"]).alias("so_far"), (s["place"] + 1).alias("place")), lambda s: s["so_far"])


def scan(a: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What a fold has after each element."""
    first = F.struct(start.alias("now"), F.slice(F.array(start), 1, 0).alias("out"))
    return F.aggregate(a, first, lambda s, x: F.struct(step(s["now"], x).alias("now"), F.concat(s["out"], F.array(step(s["now"], x))).alias("out")), lambda s: s["out"])


def while_loop(start: Column, test: Callable[[Column], Column], step: Callable[[Column], Column], most: int = 1000) -> Column:
    """The value once the test fails; an error if that takes more than `most` steps (at most 100,000)."""
    last = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, STEPS_MOST))), start, lambda v, _: F.when(test(v), step(v)).otherwise(v))
    return F.element_at(F.transform(F.array(last), lambda v: F.when(test(v), F.raise_error("a loop took too many steps")).otherwise(v)), 1)


def until_loop(start: Column, test: Callable[[Column], Column], step: Callable[[Column], Column], most: int = 1000) -> Column:
    return while_loop(start, lambda v: ~test(v), step, most)


# maps


def map_keys(m: Column, fn: Callable[[Column], Column]) -> Column:
    """Of keys that become equal the last one stays."""
    return from_items(F.transform(F.map_entries(m), lambda e: F.struct(fn(e["key"]).alias("key"), e["value"].alias("value"))))


def map_values(m: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform_values(m, lambda k, v: fn(v))


def with_entries(m: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """fn gives a struct of key and value for each entry; null drops it."""
    return from_items(F.filter(F.transform(F.map_entries(m), lambda e: fn(e["key"], e["value"])), lambda e: e.isNotNull()))


def pivot(a: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """A map of an array's keys to its values; the last of equal keys stays."""
    return from_items(F.transform(a, lambda x: F.struct(key(x).cast("string").alias("key"), value(x).alias("value"))))


def unpivot(m: Column) -> Column:
    return F.map_entries(m)


def chunk_by_size(a: Column, most: int) -> Column:
    """Neighbours together while their JSON fits `most` bytes; a longer element stands alone."""
    def step(s: Column, x: Column) -> Column:
        n = F.octet_length(F.to_json(F.array(x)))
        fits = (F.size(s["out"]) > 0) & (s["bytes"] + n <= most)
        last = F.size(s["out"])
        grown = F.transform(s["out"], lambda c, i: F.when(i == last - 1, F.concat(c, F.array(x))).otherwise(c))
        return F.struct(F.when(fits, grown).otherwise(F.concat(s["out"], F.array(F.array(x)))).alias("out"), F.when(fits, s["bytes"] + n).otherwise(n).alias("bytes"))

    return F.aggregate(a, F.struct(F.slice(F.array(a), 1, 0).alias("out"), F.lit(0).alias("bytes")), step, lambda s: s["out"])


def truncate_to_size(a: Column, most: int) -> Column:
    """The first elements whose JSON fits `most` bytes."""
    sizes = F.transform(a, lambda x: F.octet_length(F.to_json(F.array(x))))
    kept = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes")), lambda s, x: F.struct((s["n"] + F.when(s["bytes"] + x <= most, 1).otherwise(0)).alias("n"), (s["bytes"] + x).alias("bytes")), lambda s: s["n"])
    return F.slice(a, F.lit(1), kept)


def paginate(a: Column, page: int, per_page: int) -> Column:
    """One page, from 1, with its place among all; values under 1 count as 1."""
    page, size = max(1, page), max(1, per_page)
    total = F.size(a)
    pages = F.ceil(total / size).cast("long")
    return F.struct(
        F.slice(a, (page - 1) * size + 1, size).alias("data"), F.lit(page).alias("page"), F.lit(size).alias("per_page"), total.alias("total"), pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev")
    )
