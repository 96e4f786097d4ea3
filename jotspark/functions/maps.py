"""Functions of objects: maps with text keys, and structs where the names are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_items(pairs: Column) -> Column:
    """A map of an array of (key, value) structs; the last of equal keys stays."""
    keys = F.transform(pairs, lambda p: p.getField("key"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p.getField("key")))
    return F.map_from_entries(last)


def items(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def merge(a: Column, b: Column) -> Column:
    """b's values replace a's."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def defaults(m: Column, fallback: Column) -> Column:
    return merge(fallback, m)


def pick(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*names))


def omit(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*names))


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """A key renamed to one that is there replaces it."""
    def new(k: Column) -> Column:
        out = k
        for a, b in names.items():
            out = F.when(k == a, F.lit(b)).otherwise(out)
        return out

    return from_items(F.transform(F.map_entries(m), lambda e: F.struct(new(e["key"]).alias("key"), e["value"].alias("value"))))


def invert(m: Column) -> Column:
    """Values become keys; of equal values the last key stays, and null values go."""
    pairs = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
    return from_items(F.transform(pairs, lambda e: F.struct(e["value"].cast("string").alias("key"), e["key"].alias("value"))))


def remove_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def diff(a: Column, b: Column) -> Column:
    """Keys that b adds, that it lacks, and whose values differ, each sorted."""
    ka, kb = F.map_keys(a), F.map_keys(b)
    changed = F.filter(F.array_intersect(ka, kb), lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.struct(F.array_sort(F.array_except(kb, ka)).alias("added"), F.array_sort(F.array_except(ka, kb)).alias("removed"), F.array_sort(changed).alias("changed"))


def merge_patch(target: Column, patch: Column) -> Column:
    """A flat merge patch: null values remove their keys, others replace or add."""
    return merge(F.map_filter(target, lambda k, v: ~F.map_contains_key(patch, k)), remove_nulls(patch))


def mask(s: Column, visible: int = 4) -> Column:
    return F.when(F.length(s) <= visible, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(s) - visible), F.right(s, F.lit(visible))))


def completeness(*columns: Column) -> Column:
    """Percentage of the columns that are not null."""
    return sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0)) * 100.0 / len(columns)
