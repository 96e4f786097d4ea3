"""Queries for building, searching, folding and reshaping arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from jotspark.functions import arrays as A
from jotspark.functions import higher as H
from jotspark.functions import maps as M
from jotspark.functions import sequences as Q
from jotspark.operators import tables as O
from jotspark.plans.columns import registry
from jotspark.plans.relational import table

QUERIES, ORACLE, query = registry()


@query(
    "array_building",
    """WITH p AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, [p_size, p_size % 7, 3, NULL] AS n FROM part)
    SELECT p_partkey, range(2, 20, 5) AS ranged, list_transform(list_zip(w[1:2], [p_size, 1]), lambda t: t[1] || ':' || t[2]) AS zipped, list_transform(w[1:2], lambda x, i: x || [p_size, 1][i]) AS combined, [[p_size, 1], [p_size % 7, 2]] AS turned, [p_size, p_size % 7, 1, 2] AS flat,
    list_contains(w, 'red') AS has_red, list_filter([CASE WHEN p_size = 3 THEN 0 END, CASE WHEN p_size % 7 = 3 THEN 1 END, 2], lambda x: x IS NOT NULL) AS threes, p_size IN (1, 2, 3) AND p_size % 7 IN (1, 2, 3) AS inside, CASE WHEN p_size % 10 IN (2, 4, 6) THEN p_size % 10 // 2 - 1 ELSE -(CASE WHEN p_size % 10 < 2 THEN 0 WHEN p_size % 10 < 4 THEN 1 WHEN p_size % 10 < 6 THEN 2 ELSE 3 END) - 1 END AS found,
    [p_size, p_size] AS repeated, [w[1]] || CASE WHEN len(w) >= 3 THEN [w[3]] ELSE [] END || CASE WHEN len(w) >= 5 THEN [w[5]] ELSE [] END AS odd, [p_size, 0, 0, NULL] AS filled, list_distinct([p_size]) AS one, p_size + p_size % 7 + 3 AS total FROM p""",
    lists="ranged zipped combined turned flat threes repeated odd filled one",
)
def array_building(spark, sf_dir):
    z = F.col("p_size")
    w, n = F.split("p_name", " "), F.array(z, z % 7, F.lit(3), F.lit(None).cast("int"))
    small = F.array(F.lit(1), F.lit(2), F.lit(3))
    return table(spark, sf_dir, "part").select(
        "p_partkey", Q.number_range(2, 20, 5).cast("array<bigint>").alias("ranged"), Q.zip_with(w, F.array(z, F.lit(1)), lambda x, y: F.concat_ws(":", x, y)).alias("zipped"), F.transform(Q.zip_arrays(w, F.array(z.cast("string"), F.lit("1"))), lambda p: F.array_join(p, "")).alias("combined"),
        Q.transpose(F.array(F.array(z, z % 7), F.array(F.lit(1), F.lit(2)))).alias("turned"), Q.flatten_deep(F.array(F.array(z, z % 7), F.array(F.lit(1), F.lit(2))), 1).alias("flat"), Q.includes(w, F.lit("red")).alias("has_red"),
        Q.indices_of(n, F.lit(3)).alias("threes"),
        Q.all_inside(F.array(z, z % 7), small).alias("inside"), Q.bsearch(F.array(F.lit(2), F.lit(4), F.lit(6)), z % 10).alias("found"), Q.repeat_array(z, 2).alias("repeated"), Q.every_nth(w, 2).alias("odd"), Q.fill(n, F.lit(0), 1, -1).alias("filled"), Q.union(F.array(z), F.array(z)).alias("one"),
        Q.fold(A.take(n, 3), F.lit(0), lambda s, x, i: s + x).alias("total"),
    )


@query(
    "array_folds",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(floor(x * 100) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) >= 8)
    SELECT vec_id, list_transform(range(1, 9), lambda i: list_sum(v[1:i])::BIGINT) AS running, list_transform(range(1, 9), lambda i: list_max(v[1:i])) AS highest, list_sum(list_transform(v, lambda x, i: x * (i - 1)))::BIGINT AS weighted, quantile_cont_.q AS p30,
    (SELECT count(*) FROM range(0, 60) r(i) WHERE (abs(v[1]) + 1) * pow(2, i) < 1000)::BIGINT * 0 + (abs(v[1]) + 1) * pow(2, greatest(0, ceil(log2(1000.0 / (abs(v[1]) + 1)))))::BIGINT AS doubled, list_transform(list_sort(list_distinct(v)), lambda x: x::VARCHAR || ':' || len(list_filter(v, lambda y: y = x))) AS counted
    FROM e, LATERAL (SELECT quantile_cont(u, 0.3) AS q FROM (SELECT unnest(v) AS u)) quantile_cont_""",
    lists="running highest counted",
)
def array_folds(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 8).select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 100)).alias("v"))
    v = F.col("v")
    counts = A.frequencies(v)
    return e.select(
        "vec_id", A.cumulative_sum(v, "long").alias("running"), Q.scan(v, F.lit(-10**9).cast("long"), lambda s, x: F.greatest(s, x)).alias("highest"), Q.fold(v, F.lit(0).cast("long"), lambda s, x, i: s + x * i).alias("weighted"), Q.percentile(v, 30).alias("p30"),
        Q.while_loop(F.abs(F.get(v, F.lit(0))) + 1, lambda x: x < 1000, lambda x: x * 2, most=12).alias("doubled"), F.transform(F.array_sort(F.array_distinct(v)), lambda x: F.concat(x.cast("string"), F.lit(":"), F.element_at(counts, x.cast("string")).cast("string"))).alias("counted"),
    )


@query(
    "array_runs",
    """WITH w AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: length(x)) AS v FROM part)
    SELECT p_partkey, list_transform(list_filter(range(1, len(v) + 1), lambda i: i = 1 OR v[i] <> v[i - 1]), lambda i: v[i]) AS run_keys, len(list_filter(range(1, len(v) + 1), lambda i: i = 1 OR v[i] <> v[i - 1])) AS runs, list_sum(v)::BIGINT AS total,
    list_transform(list_sort(list_distinct(v)), lambda x: x || '=' || len(list_filter(v, lambda y: y = x))) AS grouped, list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]) AS firsts, v[1:2] AS page, len(v) > 2 AS more, (len(v) + 1) // 2 AS pages, v[1:1] AS fitting FROM w""",
    lists="run_keys grouped firsts page fitting",
)
def array_runs(spark, sf_dir):
    v = F.col("v")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.split("p_name", " "), F.length).alias("v"))
    runs, page = Q.partition_by(v, lambda x: x), Q.paginate(v, 0, 2)
    groups = H.group_by(v, lambda x: x)
    return parts.select(
        "p_partkey", F.transform(runs, lambda r: F.get(r, F.lit(0))).alias("run_keys"), F.size(runs).cast("long").alias("runs"), F.aggregate(F.flatten(runs), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        F.transform(F.array_sort(F.array_distinct(v)), lambda x: F.concat_ws("=", x.cast("string"), F.size(F.element_at(groups, x.cast("string"))).cast("string"))).alias("grouped"), H.unique_by(v, lambda x: x).alias("firsts"), page["data"].alias("page"), page["has_next"].alias("more"),
        page["total_pages"].alias("pages"), F.flatten(F.slice(Q.chunk_by_size(v, 4), 1, 1)).alias("fitting"),
    )


@query(
    "map_reshaping",
    """SELECT c_custkey, ['NAME', 'SEG'] AS upper_names, ['c', c_mktsegment] AS first_values, ['seg'] AS kept_names, c_name AS pivoted, 2 AS entries, c_name || '!' AS marked FROM customer""",
    lists="upper_names kept_names first_values",
)
def map_reshaping(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment"))
    pairs = F.array(F.struct(F.lit("a").alias("k"), F.lit("x").alias("v")), F.struct(F.lit("a").alias("k"), F.col("c_name").alias("v")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", M.keys(Q.map_keys(m, F.upper)).alias("upper_names"), F.map_values(M.merge(m, F.create_map(F.lit("name"), F.lit("c")))).alias("_v"), M.keys(Q.with_entries(m, lambda k, v: F.when(k != "name", F.struct(k.alias("key"), v.alias("value"))))).alias("kept_names"),
        F.element_at(Q.pivot(pairs, lambda p: p["k"], lambda p: p["v"]), "a").alias("pivoted"), F.size(Q.unpivot(m)).alias("entries"), F.element_at(Q.map_values(m, lambda v: F.concat(v, F.lit("!"))), "name").alias("marked"),
    ).withColumn("first_values", F.reverse(F.col("_v"))).drop("_v")


@query("order_runs", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 1 ELSE 0 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM o) SELECT o_custkey, run::BIGINT AS run, any_value(o_orderstatus) AS o_orderstatus, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY o_custkey, run""")
def order_runs(spark, sf_dir):
    return O.runs(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@query("order_totals", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS total FROM orders")
def order_totals(spark, sf_dir):
    got = O.running(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], n=F.count(F.lit(1)), total=F.sum("o_totalprice"))
    return got.select("o_orderkey", "o_custkey", "n", F.round("total", 2).alias("total"))


@query("status_by_priority", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority""")
def status_by_priority(spark, sf_dir):
    return O.pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", F.count(F.lit(1)), ["F", "O", "P"]).fillna(0)


@query("customer_fields", "SELECT c_custkey, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer")
def customer_fields(spark, sf_dir):
    return O.unpivot(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"], "field", "value")


@query("either_key", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def either_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("one_key_only", "SELECT DISTINCT k FROM ((SELECT o_custkey % 40 AS k FROM orders EXCEPT SELECT p_size FROM part) UNION ALL (SELECT p_size FROM part EXCEPT SELECT o_custkey % 40 FROM orders))")
def one_key_only(spark, sf_dir):
    return O.xor(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("long").alias("k")), table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("k")))
