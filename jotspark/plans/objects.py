"""Queries for nested objects."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from jotspark.functions import objects as J
from jotspark.plans.columns import registry
from jotspark.plans.relational import table

QUERIES, ORACLE, query = registry()


def people(spark, sf_dir):
    """Customers as nested objects: x, and its type."""
    c = table(spark, sf_dir, "customer")
    place = F.struct(F.col("c_nationkey").alias("nationKey"), F.nullif(F.lit(""), F.when(F.col("c_nationkey") > 100, "x").otherwise("y")).alias("emptyText"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    x = F.struct(F.col("c_name").alias("fullName"), place.alias("homePlace"), F.array(F.col("c_custkey"), F.lit(None).cast("long"), F.lit(7).cast("long")).alias("someTags"))
    df = c.select("c_custkey", x.alias("x"))
    return df, F.col("x"), df.schema["x"].dataType


@query(
    "object_paths",
    """SELECT c_custkey, c_nationkey AS nation, c_custkey AS first_tag, 7 AS last_tag, 'none' AS missing, true AS has_nation, false AS has_other, true AS has_tag, false AS has_tag_9, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'unknown' END AS segment,
    ['/fullName', '/homePlace', '/homePlace/nationKey', '/homePlace/emptyText', '/homePlace/segment', '/someTags'] AS pointers, ['homePlace.nationKey'] AS places, [c_nationkey::VARCHAR] AS plucked, 5 AS n_leaves, '"' || c_name || '"' AS first_leaf, 7 AS n_all FROM customer""",
    lists="pointers places plucked",
)
def object_paths(spark, sf_dir):
    df, x, t = people(spark, sf_dir)
    g = lambda p, d=None: J.get_path(x, t, p, d)
    return df.select(
        "c_custkey", g("homePlace.nationKey").alias("nation"), g("someTags.0").alias("first_tag"), g("/someTags/-1").alias("last_tag"), g("no.such", F.lit("none")).alias("missing"), J.has_path(x, t, "homePlace.nationKey").alias("has_nation"), J.has_path(x, t, "other").alias("has_other"),
        J.has_path(x, t, "someTags.2").alias("has_tag"), J.has_path(x, t, "someTags.9").alias("has_tag_9"), g("homePlace.segment", F.lit("unknown")).alias("segment"), J.paths(x, t).alias("pointers"), J.paths_to(t, "nationKey").alias("places"), J.pluck_deep(x, t, "nationKey").alias("plucked"),
        F.size(J.leaves(x, t)).alias("n_leaves"), F.get(J.leaves_with_paths(x, t), F.lit(0))["value"].alias("first_leaf"), F.size(J.recurse(x, t)).alias("n_all"),
    )


@query(
    "object_changes",
    """SELECT c_custkey, '{"fullName":"' || c_name || '","homePlace":{"nationKey":5,"emptyText":""' || seg || '},"someTags":[' || c_custkey || ',null,7]}' AS set_nation, '{"homePlace":{"nationKey":' || c_nationkey || ',"emptyText":""' || seg || '},"someTags":[' || c_custkey || ',null,7]}' AS without_name,
    '{"fullName":"' || c_name || '","homePlace":{"nationKey":' || c_nationkey || seg || '},"someTags":[' || c_custkey || ',7]}' AS no_empty, '{"fullName":"[REDACTED]","homePlace":{"nationKey":"[REDACTED]","emptyText":""' || seg || '},"someTags":[' || c_custkey || ',null,7]}' AS redacted,
    '{"full_name":"' || c_name || '","home_place":{"nation_key":' || c_nationkey || ',"empty_text":""' || seg || '},"some_tags":[' || c_custkey || ',null,7]}' AS snake, '{"Full-Name":"' || c_name || '","Home-Place":{"Nation-Key":' || c_nationkey || ',"Empty-Text":""' || replace(seg, 'segment', 'Segment') || '},"Some-Tags":[' || c_custkey || ',null,7]}' AS train,
    '{"fullName":"' || c_name || '","homePlace":{"nationKey":1,"emptyText":""' || seg || ',"new":true},"someTags":[' || c_custkey || ',null,7]}' AS merged, [c_custkey, 7] AS compacted, true AS same_shape, true AS equal_self, false AS equal_other,
    60.0 + CASE WHEN c_nationkey % 2 = 0 THEN 20 ELSE 0 END AS score, 5 AS n_flat, c_nationkey AS back, 'X' || c_name AS walked FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END AS seg FROM customer)""",
    lists="compacted",
)
def object_changes(spark, sf_dir):
    df, x, t = people(spark, sf_dir)
    texts = F.col("x").withField("homePlace.emptyText", F.lit(""))
    df = df.select("c_custkey", texts.alias("x"))
    t = df.schema["x"].dataType
    more = F.struct(F.struct(F.lit(1).alias("nationKey"), F.lit(True).alias("new")).alias("homePlace"))
    tm = df.select(more.alias("m")).schema["m"].dataType
    flat = J.flatten_keys(x, t)
    df = df.withColumn("flat", flat)
    tf = df.schema["flat"].dataType
    upper = J.walk(x, t, lambda v, k: F.concat(F.lit("X"), v) if k.typeName() == "string" else v)
    return df.select(
        "c_custkey", F.to_json(J.set_path(x, t, "/homePlace/nationKey", F.lit(5))).alias("set_nation"), F.to_json(J.delete_path(x, t, "fullName")).alias("without_name"), F.to_json(J.remove_empty(x, t)).alias("no_empty"), F.to_json(J.redact(x, t, ["fullName", "nationKey"])).alias("redacted"),
        F.to_json(J.styled_keys(x, t, "snake")).alias("snake"), F.to_json(J.styled_keys(x, t, "train")).alias("train"), F.to_json(J.deep_merge(x, t, more, tm)).alias("merged"), J.compact_deep(x["someTags"], t["someTags"].dataType).alias("compacted"), J.has_same_shape(t, t).alias("same_shape"),
        J.deep_equals(x, t, x, t).alias("equal_self"), J.deep_equals(x, t, more, tm).alias("equal_other"), J.quality(x, t)["score"].alias("score"), F.lit(len(tf.names)).alias("n_flat"), J.unflatten_keys(F.col("flat"), tf)["homePlace"]["nationKey"].alias("back"), upper["fullName"].alias("walked"),
    )


@query(
    "object_styles",
    """SELECT c_custkey, '{"fullName":1,"homePlace":' || c_nationkey || '}' AS camel, '{"full-name":1,"home-place":' || c_nationkey || '}' AS kebab, '{"FullName":1,"HomePlace":' || c_nationkey || '}' AS pascal, '{"FULL_NAME":1,"HOME_PLACE":' || c_nationkey || '}' AS shouty_snake, '{"FULL-NAME":1,"HOME-PLACE":' || c_nationkey || '}' AS shouty_kebab,
    27 + length(c_nationkey::VARCHAR) AS size, '{"type": "object", "properties": {"fullName": {"type": "number"}, "homePlace": {"type": "number"}}}' AS described, c_nationkey AS pointed, '{"fullName":1,"homePlace":' || c_nationkey || ',"more":2}' AS filled, ['homePlace', 'fullName'] AS flat_names FROM customer""",
    lists="flat_names",
)
def object_styles(spark, sf_dir):
    x = F.struct(F.lit(1).alias("fullName"), F.col("c_nationkey").alias("homePlace"))
    df = table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"))
    x, t = F.col("x"), df.schema["x"].dataType
    more = F.struct(F.lit(9).alias("fullName"), F.lit(2).alias("more"))
    tm = df.select(more.alias("m")).schema["m"].dataType
    styles = [F.to_json(J.styled_keys(x, t, s)).alias(s) for s in ("camel", "kebab", "pascal", "shouty_snake", "shouty_kebab")]
    return df.select(
        "c_custkey", *styles, J.estimate_size(x, t).alias("size"), F.lit(json.dumps(J.infer_schema(t))).alias("described"), J.json_pointer(F.parse_json(F.to_json(x)), "/homePlace").cast("int").alias("pointed"), F.to_json(J.defaults_deep(x, t, more, tm)).alias("filled"),
        F.reverse(F.array_sort(F.map_keys(J.flatten_array(x, t)))).alias("flat_names"),
    )


@query(
    "object_patches",
    """SELECT c_custkey, '{"name":"new","home":{"nation":' || c_nationkey || ',"more":[1,2]},"copied":' || c_nationkey || '}' AS patched, list_filter(['{"op":"replace","path":"/name","value":"x"}', CASE WHEN c_nationkey <> 3 THEN '{"op":"replace","path":"/home/nation","value":3}' END], lambda x: x IS NOT NULL) AS changes,
    'name:"' || c_name || '" home.nation:' || c_nationkey || ' tags.0:' || c_custkey AS flat FROM customer""",
    lists="changes",
)
def object_patches(spark, sf_dir):
    x = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("home"), F.lit(1).alias("gone"))
    c = table(spark, sf_dir, "customer")
    df = c.select("c_custkey", x.alias("x"))
    t = df.schema["x"].dataType
    other = F.struct(F.lit("x").alias("name"), F.struct(F.lit(3).alias("nation")).alias("home"), F.lit(1).alias("gone"))
    tagged = F.struct(F.col("x.name").alias("name"), F.col("x.home").alias("home"), F.array("c_custkey").alias("tags"))
    df = df.withColumns({"changes": J.json_diff(F.col("x"), other, t), "t": tagged})
    entries = F.array_sort(F.map_entries(J.flatten_array(F.col("t"), df.schema["t"].dataType)))
    df = df.withColumn("flat", F.array_join(F.transform(F.array(F.get(entries, F.lit(1)), F.get(entries, F.lit(0)), F.get(entries, F.lit(2))), lambda e: F.concat_ws(":", e["key"], e["value"])), " "))
    steps = [{"op": "test", "path": "/gone", "value": 1}, {"op": "replace", "path": "/name", "value": "new"}, {"op": "add", "path": "/home/more", "value": [1, 2]}, {"op": "copy", "from": "/home/nation", "path": "/copied"}, {"op": "remove", "path": "/gone"}]
    out = J.json_patch(df, "x", steps)
    return out.select("c_custkey", F.to_json("x").alias("patched"), "changes", "flat")
