"""Array functions that take a function of an element, and reorderings of arrays; null arrays give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def holds(test: Test) -> Test:
    """The test with null as false."""
    return lambda x: F.coalesce(test(x), F.lit(False))


def find_index(a: Column, test: Test) -> Column:
    """0-based place of the first element that passes; null for none."""
    return F.nullif(F.array_position(F.transform(a, holds(test)), True), F.lit(0)) - 1


def find(a: Column, test: Test) -> Column:
    return F.get(F.filter(a, holds(test)), F.lit(0))


def count_where(a: Column, test: Test) -> Column:
    return F.size(F.filter(a, holds(test))).cast("long")


def every(a: Column, test: Test) -> Column:
    return F.forall(a, holds(test))


def some(a: Column, test: Test) -> Column:
    return F.exists(a, holds(test))


def none(a: Column, test: Test) -> Column:
    return ~F.exists(a, holds(test))


def reject(a: Column, test: Test) -> Column:
    return F.filter(a, lambda x: ~holds(test)(x))


def partition(a: Column, test: Test) -> Column:
    """Two arrays: what passes, and the rest."""
    return F.array(F.filter(a, holds(test)), reject(a, test))


def take_while(a: Column, test: Test) -> Column:
    return F.slice(a, F.lit(1), F.coalesce(find_index(a, lambda x: ~holds(test)(x)), F.size(a).cast("long")).cast("int"))


def drop_while(a: Column, test: Test) -> Column:
    start = F.coalesce(find_index(a, lambda x: ~holds(test)(x)), F.size(a).cast("long")).cast("int")
    return F.slice(a, start + 1, F.size(a))


def order_by(a: Column, key: Test, descending: bool = False) -> Column:
    """By key, then by place."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), (-i if descending else i).alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed, asc=not descending), lambda s: s["x"])


def min_by(a: Column, key: Test) -> Column:
    return F.array_min(F.transform(F.filter(a, lambda x: key(x).isNotNull()), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))["x"]


def max_by(a: Column, key: Test) -> Column:
    """The first of the greatest."""
    return F.array_max(F.transform(F.filter(a, lambda x: key(x).isNotNull()), lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x"))))["x"]


def unique_by(a: Column, key: Test) -> Column:
    """The first element of each key."""
    keys = F.transform(a, lambda x: F.coalesce(F.concat(F.lit("="), key(x).cast("string")), F.lit("null")))
    return F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def group_by(a: Column, key: Test) -> Column:
    """Map of the key as text to its elements; null keys stand under 'null'."""
    named = lambda x: F.coalesce(key(x).cast("string"), F.lit("null"))
    names = F.array_distinct(F.transform(a, named))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.filter(a, lambda x: named(x) == k)))


def count_by(a: Column, key: Test) -> Column:
    return F.transform_values(group_by(a, key), lambda k, v: F.size(v).cast("long"))


def index_by(a: Column, key: Test) -> Column:
    """Map of the key as text to its last element."""
    return F.transform_values(group_by(a, key), lambda k, v: F.element_at(v, -1))


def flat_map(a: Column, fn: Test) -> Column:
    return F.flatten(F.filter(F.transform(a, fn), lambda x: x.isNotNull()))


def rank(a: Column) -> Column:
    """Of each number, 1 for the greatest; ties share a rank and leave gaps."""
    return F.transform(a, lambda x: (F.size(F.filter(a, lambda y: y > x)) + 1).cast("long"))


def dense_rank(a: Column) -> Column:
    return F.transform(a, lambda x: (F.size(F.filter(F.array_distinct(a), lambda y: y > x)) + 1).cast("long"))


def lag(a: Column, n: int = 1) -> Column:
    return F.transform(a, lambda x, i: F.when(i >= n, F.get(a, i - n)))


def lead(a: Column, n: int = 1) -> Column:
    return F.transform(a, lambda x, i: F.get(a, i + n))


def without(a: Column, *values) -> Column:
    return F.array_except(a, F.array(*map(F.lit, values))) if values else F.array_distinct(a)


def compact(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def interpose(a: Column, value) -> Column:
    return F.slice(F.flatten(F.transform(a, lambda x: F.array(F.lit(value), x))), F.lit(2), F.greatest(F.size(a) * 2 - 1, F.lit(0)))


def interleave(a: Column, b: Column) -> Column:
    """Elements in turn; the rest of the longer one follows."""
    n = F.least(F.size(a), F.size(b))
    turns = F.flatten(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)))
    return F.concat(turns, F.slice(a, n + 1, F.size(a)), F.slice(b, n + 1, F.size(b)))


def cycle(a: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(a, times))


def cartesian(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array(x, y))))


def pairs(a: Column) -> Column:
    """Combinations of two, in order of place."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.array(x, y))))


def pull_at(a: Column, *places: int) -> Column:
    return F.array(*[F.get(a, F.lit(p) if p >= 0 else F.size(a) + p) for p in places])


def zipmap(names: Column, values: Column) -> Column:
    """Map up to the shorter one's end; of repeated names the last counts."""
    n = F.least(F.size(names), F.size(values))
    k = F.slice(names, F.lit(1), n)
    last = F.filter(F.arrays_zip(k.alias("k"), F.slice(values, F.lit(1), n).alias("v")), lambda x, i: ~F.array_contains(F.slice(k, i + 2, F.size(k)), x["k"]))
    return F.map_from_entries(last)
