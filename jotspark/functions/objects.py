"""Nested objects as structs. Their types are known when a plan is made, so paths, merges and renamings become plain column
expressions without any work at run time; a value is given as a column with its type. Null objects give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jotspark.functions.scalars import type_name


def steps(path: str) -> list[str]:
    """The parts of a path with dots, or of a JSON pointer."""
    if path.startswith("/"):
        return [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
    return path.split(".") if path else []


def find(x: Column, t: T.DataType, path: str) -> tuple[Column, T.DataType] | None:
    """The value at a path with its type; None where the type has no such place."""
    for p in steps(path):
        if isinstance(t, T.StructType) and p in t.names:
            x, t = x.getField(p), t[p].dataType
        elif isinstance(t, T.ArrayType) and re.fullmatch(r"-?\d+", p):
            x, t = (F.get(x, F.lit(int(p))) if int(p) >= 0 else F.get(x, F.size(x) + int(p))), t.elementType
        elif isinstance(t, T.MapType):
            x, t = F.try_element_at(x, F.lit(p)), t.valueType
        else:
            return None
    return x, t


def get_path(x: Column, t: T.DataType, path: str, default: Column | None = None) -> Column:
    found = find(x, t, path)
    value = found[0] if found else F.lit(None)
    return value if default is None else F.coalesce(value, default)


def has_path(x: Column, t: T.DataType, path: str) -> Column:
    """Whether the place is there: fields of a type always are, elements of arrays and keys of maps by the value."""
    found = find(x, t, path)
    if not found:
        return F.lit(False)
    *before, last = steps(path) or [""]
    parent = find(x, t, ".".join(before)) if before else (x, t)
    if isinstance(parent[1], T.ArrayType):
        k = int(last)
        return F.coalesce(F.size(parent[0]) > (k if k >= 0 else -k - 1), F.lit(False))
    if isinstance(parent[1], T.MapType):
        return F.coalesce(F.map_contains_key(parent[0], last), F.lit(False))
    return parent[0].isNotNull()


def rebuilt(x: Column, t: T.StructType, fields: list[tuple[str, Column]]) -> Column:
    """A struct of these fields where x is not null; {} becomes null."""
    return F.when(x.isNotNull(), F.struct(*[c.alias(n) for n, c in fields])) if fields else F.lit(None)


def set_path(x: Column, t: T.DataType, path: str, value: Column) -> Column:
    """The value put at a path; missing objects on the way are made."""
    parts = steps(path)
    if not parts:
        return value
    first, rest = parts[0], ".".join(parts[1:])
    if isinstance(t, T.ArrayType):
        k = int(first)
        return F.transform(x, lambda y, i: F.when(i == (F.lit(k) if k >= 0 else F.size(x) + k), set_path(y, t.elementType, rest, value)).otherwise(y))
    if isinstance(t, T.MapType):
        return F.map_concat(F.map_filter(x, lambda k, v: k != first), F.create_map(F.lit(first), set_path(F.try_element_at(x, F.lit(first)), t.valueType, rest, value)))
    names = t.names if isinstance(t, T.StructType) else []
    fields = [(n, set_path(x.getField(n), t[n].dataType, rest, value) if n == first else x.getField(n)) for n in names]
    if first not in names:
        fields.append((first, set_path(F.lit(None), T.NullType(), rest, value)))
    return F.struct(*[c.alias(n) for n, c in fields])


def delete_path(x: Column, t: T.DataType, path: str) -> Column:
    """Without the value at a path; what is not there changes nothing."""
    *before, last = steps(path)
    if isinstance(t, T.ArrayType):
        if before:
            k = int(before.pop(0) if not isinstance(t, T.StructType) else 0)
            rest = ".".join([*before, last])
            return F.transform(x, lambda y, i: F.when(i == k, delete_path(y, t.elementType, rest)).otherwise(y))
        return F.filter(x, lambda y, i: i != int(last)) if re.fullmatch(r"\d+", last) else x
    if isinstance(t, T.MapType):
        return F.map_filter(x, lambda k, v: k != last) if not before else x
    if not isinstance(t, T.StructType):
        return x
    if before:
        first, rest = before[0], ".".join([*before[1:], last])
        return rebuilt(x, t, [(n, delete_path(x.getField(n), t[n].dataType, rest) if n == first else x.getField(n)) for n in t.names])
    return rebuilt(x, t, [(n, x.getField(n)) for n in t.names if n != last])


def walk_types(x: Column, t: T.DataType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Column, T.DataType]]:
    """Every object and value of a struct, outer ones first; arrays and maps are values."""
    yield path, x, t
    if isinstance(t, T.StructType):
        for f in t:
            yield from walk_types(x.getField(f.name), f.dataType, (*path, f.name))


def leaf_fields(x: Column, t: T.DataType) -> list[tuple[tuple[str, ...], Column, T.DataType]]:
    return [(p, c, k) for p, c, k in walk_types(x, t) if not isinstance(k, T.StructType)]


def flatten_keys(x: Column, t: T.StructType, sep: str = ".") -> Column:
    """One struct of all leaves, named by their paths."""
    return F.struct(*[c.alias(sep.join(p)) for p, c, _ in leaf_fields(x, t)])


def flatten_array(x: Column, t: T.StructType, sep: str = ".") -> Column:
    """A map of the paths of all leaves, elements of arrays by their places, to their JSON."""

    def part(name: str, c: Column, k: T.DataType) -> Column:
        if not isinstance(k, T.ArrayType):
            return F.array(F.struct(F.lit(name).alias("key"), as_json(c, k).alias("value")))
        each = F.transform(c, lambda y, i: F.struct(F.concat(F.lit(f"{name}{sep}"), i.cast("string")).alias("key"), as_json(y, k.elementType).alias("value")))
        return F.coalesce(each, F.array().cast("array<struct<key: string, value: string>>"))

    return F.map_from_entries(F.concat(*[part(sep.join(p), c, k) for p, c, k in leaf_fields(x, t)]))


def as_json(x: Column, t: T.DataType) -> Column:
    """JSON text of any value; null for null."""
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(x)
    inner = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(inner, F.lit(2), F.length(inner) - 2))


def unflatten_keys(x: Column, t: T.StructType, sep: str = ".") -> Column:
    """Fields with dots in their names as nested objects."""
    tree: dict = {}
    for n in t.names:
        at = tree
        *before, last = n.split(sep)
        for p in before:
            at = at.setdefault(p, {})
        at[last] = x.getField(n)

    def build(at: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in at.items()])

    return build(tree)


def deep_merge(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """b's values replace a's; objects of both are merged."""
    if not (isinstance(ta, T.StructType) and isinstance(tb, T.StructType)):
        return b
    fields = []
    for n in [*ta.names, *(n for n in tb.names if n not in ta.names)]:
        if n in ta.names and n in tb.names:
            fields.append((n, deep_merge(a.getField(n), ta[n].dataType, b.getField(n), tb[n].dataType)))
        else:
            fields.append((n, (a if n in ta.names else b).getField(n)))
    return F.struct(*[c.alias(n) for n, c in fields])


def defaults_deep(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """a's values, and b's where a has none."""
    if not (isinstance(ta, T.StructType) and isinstance(tb, T.StructType)):
        return F.coalesce(a, b)
    fields = []
    for n in [*ta.names, *(n for n in tb.names if n not in ta.names)]:
        if n in ta.names and n in tb.names:
            fields.append((n, defaults_deep(a.getField(n), ta[n].dataType, b.getField(n), tb[n].dataType)))
        else:
            fields.append((n, (a if n in ta.names else b).getField(n)))
    return F.struct(*[c.alias(n) for n, c in fields])


def deep_equals(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Equal values; objects by names, whatever their order."""
    if isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        if set(ta.names) != set(tb.names):
            return F.lit(False)
        same = [deep_equals(a.getField(n), ta[n].dataType, b.getField(n), tb[n].dataType) for n in ta.names]
        out = F.lit(True)
        for s in same:
            out = out & s
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(out)
    return a.eqNullSafe(b) if type_name(ta) == type_name(tb) else a.isNull() & b.isNull()


def has_same_shape(ta: T.DataType, tb: T.DataType) -> Column:
    """Whether two types have the same names and JSON types at all levels."""
    return F.lit(shape(ta) == shape(tb))


def shape(t: T.DataType):
    if isinstance(t, T.StructType):
        return {f.name: shape(f.dataType) for f in t}
    if isinstance(t, T.ArrayType):
        return [shape(t.elementType)]
    return type_name(t)


def infer_schema(t: T.DataType) -> dict:
    """A JSON-schema-like description of a type."""
    if isinstance(t, T.StructType):
        return {"type": "object", "properties": {f.name: infer_schema(f.dataType) for f in t}}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": infer_schema(t.elementType)}
    return {"type": type_name(t)}


def paths(x: Column, t: T.DataType) -> Column:
    """JSON pointers of every object and value, without the root."""
    escaped = lambda p: "/" + "/".join(k.replace("~", "~0").replace("/", "~1") for k in p)
    return F.array(*[F.lit(escaped(p)) for p, _, _ in walk_types(x, t) if p])


def leaves(x: Column, t: T.DataType) -> Column:
    """JSON of all values that are no objects, in order; nulls stand as 'null'."""
    return F.array(*[F.coalesce(as_json(c, k), F.lit("null")) for _, c, k in leaf_fields(x, t)])


def leaves_with_paths(x: Column, t: T.DataType) -> Column:
    return F.array(*[F.struct(F.lit("/" + "/".join(p)).alias("path"), F.coalesce(as_json(c, k), F.lit("null")).alias("value")) for p, c, k in leaf_fields(x, t)])


def recurse(x: Column, t: T.DataType) -> Column:
    """JSON of the value itself and of all that it holds, outer ones first."""
    return F.array(*[F.coalesce(as_json(c, k), F.lit("null")) for _, c, k in walk_types(x, t)])


def recurse_with(x: Column, t: T.DataType, test: Callable[[T.DataType], bool]) -> Column:
    """The same for those whose type passes."""
    return F.array(*[F.coalesce(as_json(c, k), F.lit("null")) for _, c, k in walk_types(x, t) if test(k)])


def walk(x: Column, t: T.DataType, fn: Callable[[Column, T.DataType], Column]) -> Column:
    """fn of every value, inner ones first; objects keep their names."""
    if isinstance(t, T.StructType):
        return rebuilt(x, t, [(f.name, walk(x.getField(f.name), f.dataType, fn)) for f in t])
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda y: walk(y, t.elementType, fn))
    return fn(x, t)


def pluck_deep(x: Column, t: T.DataType, key: str) -> Column:
    """JSON of the values of a key at any depth, without nulls."""
    found = [as_json(c, k) for p, c, k in walk_types(x, t) if p and p[-1] == key]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def paths_to(t: T.DataType, key: str) -> Column:
    """Paths with dots at which a key stands."""
    return F.array(*[F.lit(".".join(p)) for p, _, _ in walk_types(F.lit(None), t) if p and p[-1] == key])


def redact_keys(x: Column, t: T.DataType, test: Callable[[str], bool], mask: str = "[REDACTED]") -> Column:
    """A mask in place of the values of keys whose name passes, at any depth."""
    if isinstance(t, T.StructType):
        return rebuilt(x, t, [(f.name, F.lit(mask) if test(f.name) else redact_keys(x.getField(f.name), f.dataType, test, mask)) for f in t])
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda y: redact_keys(y, t.elementType, test, mask))
    return x


def redact(x: Column, t: T.DataType, names: list[str]) -> Column:
    return redact_keys(x, t, lambda n: n in names)


def redact_matching(x: Column, t: T.DataType, pattern: str) -> Column:
    return redact_keys(x, t, lambda n: re.search(pattern, n) is not None)


def rename_deep(x: Column, t: T.DataType, fn: Callable[[str], str]) -> Column:
    """All keys renamed, at any depth."""
    if isinstance(t, T.StructType):
        return rebuilt(x, t, [(fn(f.name), rename_deep(x.getField(f.name), f.dataType, fn)) for f in t])
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda y: rename_deep(y, t.elementType, fn))
    return x


def words_of(name: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)


#: Names of keys in the usual styles.
STYLES: dict[str, Callable[[str], str]] = {
    "snake": lambda n: "_".join(words_of(n)).lower(),
    "kebab": lambda n: "-".join(words_of(n)).lower(),
    "camel": lambda n: (p := STYLES["pascal"](n))[:1].lower() + p[1:],
    "pascal": lambda n: "".join(w.capitalize() for w in words_of(n)),
    "train": lambda n: "-".join(w.capitalize() for w in words_of(n)),
    "shouty_snake": lambda n: "_".join(words_of(n)).upper(),
    "shouty_kebab": lambda n: "-".join(words_of(n)).upper(),
}


def styled_keys(x: Column, t: T.DataType, style: str) -> Column:
    return rename_deep(x, t, STYLES[style])


def compact_deep(a: Column, t: T.DataType) -> Column:
    """Arrays without nulls, at all levels."""
    if not isinstance(t, T.ArrayType):
        return a
    return F.array_compact(F.transform(a, lambda y: compact_deep(y, t.elementType)))


def remove_empty(x: Column, t: T.DataType, only_texts: bool = False) -> Column:
    """Empty texts, arrays and objects become null, inner ones first, and leave arrays; to_json leaves nulls out of objects.
    only_texts: empty texts alone."""
    kind = type_name(t)
    if isinstance(t, T.StructType):
        fields = [(f.name, remove_empty(x.getField(f.name), f.dataType, only_texts)) for f in t]
        some = F.lit(only_texts)
        for _, c in fields:
            some = some | c.isNotNull()
        return F.when(x.isNotNull() & some, F.struct(*[c.alias(n) for n, c in fields]))
    if isinstance(t, T.ArrayType):
        left = F.array_compact(F.transform(x, lambda y: remove_empty(y, t.elementType, only_texts)))
        return left if only_texts else F.when(F.size(left) > 0, left)
    return F.nullif(x, F.lit("")) if kind == "string" and isinstance(t, T.StringType) else x


def estimate_size(x: Column, t: T.DataType) -> Column:
    """Bytes of the value's JSON."""
    return F.octet_length(F.coalesce(as_json(x, t), F.lit("null")))


def quality(x: Column, t: T.StructType) -> Column:
    """Score from 0 to 100 of a row by the share of its leaves that are neither null nor empty texts, and how many are which."""
    fields = leaf_fields(x, t)
    nulls = sum((c.isNull().cast("int") for _, c, _ in fields), F.lit(0))
    empty = sum((F.coalesce(c == "", F.lit(False)).cast("int") for _, c, k in fields if isinstance(k, T.StringType)), F.lit(0))
    score = F.greatest(F.lit(0.0), 100 * (1 - (nulls + empty) / F.lit(float(max(1, len(fields))))))
    return F.struct(score.alias("score"), F.lit(len(fields)).alias("total_fields"), nulls.alias("null_count"), empty.alias("empty_string_count"))


def json_pointer(v: Column, pointer: str) -> Column:
    """The VARIANT at a JSON pointer; null where there is nothing."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else '["' + p.replace('"', '\\"') + '"]' for p in steps(pointer)) if pointer else "$"
    return F.try_variant_get(v, path, "variant")


def type_consistency(a: Column) -> Column:
    """Whether the elements of an array of VARIANTs have one type, and which types they have."""
    kinds = F.array_sort(F.array_distinct(F.transform(a, lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))))
    return F.struct((F.size(kinds) <= 1).alias("consistent"), kinds.alias("types"))


def json_patch(df: DataFrame, column: str, operations: list[dict]) -> DataFrame:
    """df with the struct in a column changed by RFC 6902 operations known when the plan is made, one after the other: add, replace,
    remove, copy, move and test (a row that fails one raises an error). A path that the type lacks is an error for all but add."""
    for o in operations:
        x, t = F.col(column), df.schema[column].dataType
        source = find(x, t, o["from"]) if "from" in o else None
        there = find(x, t, o["path"])
        if o["op"] in ("replace", "remove", "test") and not there or "from" in o and not source:
            raise ValueError(f"nothing at {o.get('from', o['path'])}")
        if o["op"] == "remove":
            x = delete_path(x, t, o["path"])
        elif o["op"] == "test":
            x = F.when(there[0].eqNullSafe(literal(o["value"])), x).otherwise(F.raise_error(F.lit(f"test failed at {o['path']}")).cast(t))
        elif o["op"] in ("add", "replace", "copy", "move"):
            value = source[0] if source else literal(o["value"])
            x = set_path(x, t, o["path"], value)
        else:
            raise ValueError(f"no such operation: {o['op']}")
        df = df.withColumn(column, x)
        if o["op"] == "move":
            df = df.withColumn(column, delete_path(F.col(column), df.schema[column].dataType, o["from"]))
    return df


def literal(value) -> Column:
    """A JSON value as a column."""
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    return F.array(*map(literal, value)) if isinstance(value, list) else F.lit(value)


def json_diff(a: Column, b: Column, t: T.DataType) -> Column:
    """The operations, as JSON texts, that make b of a, for values of one type: replace where leaves differ."""
    theirs = {p: c for p, c, _ in leaf_fields(b, t)}

    def change(p: tuple[str, ...], c: Column, k: T.DataType) -> Column:
        new = F.coalesce(as_json(theirs[p], k), F.lit("null"))
        return F.when(~c.eqNullSafe(theirs[p]), F.concat(F.lit('{"op":"replace","path":"/' + "/".join(p) + '","value":'), new, F.lit("}")))

    return F.array_compact(F.array(*[change(p, c, k) for p, c, k in leaf_fields(a, t)]))
