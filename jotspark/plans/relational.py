"""Table queries: filters, projections, grouping, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from jotspark.operators import tables

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL where it has one."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.max("l_extendedprice").alias("max_price"))
    )


@query("filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS amount FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_project(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("amount"))


@query("group_by_type", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def group_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("count_by_segment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def count_by_segment(spark, sf_dir):
    return tables.count_by(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("max_by_customer", "SELECT o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1")
def max_by_customer(spark, sf_dir):
    return tables.max_by(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), "o_totalprice", "o_custkey", "o_orderkey")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    return tables.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("unique_by_user", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def unique_by_user(spark, sf_dir):
    return tables.unique_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("lookup_join", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("difference_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def difference_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("intersection_keys", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersection_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query(
    "event_ranks",
    "SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, lag(value) OVER v AS before, lead(value) OVER v AS after FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC NULLS LAST), v AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def event_ranks(spark, sf_dir):
    v = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    r = tables.ranks_by_range(e, ["event_type"], "value", F.col("event_id"), descending=True)
    return r.select("event_id", "rank", "dense_rank", F.lag("value").over(v).alias("before"), F.lead("value").over(v).alias("after"))


@query("moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 4) AS moving_avg FROM orders")
def moving_average(spark, sf_dir):
    m = tables.moving_avg(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 3)
    return m.select("o_orderkey", F.round("moving_avg", 4).alias("moving_avg"))


@query(
    "price_statistics",
    "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, round(stddev_pop(p_retailprice), 4) AS stddev, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.75), 4) AS q3 FROM part GROUP BY 1",
)
def price_statistics(spark, sf_dir):
    p = "p_retailprice"
    quantile = lambda q: F.round(F.percentile(p, F.lit(q)), 4)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg(p), 4).alias("mean"), quantile(0.5).alias("median"), F.round(F.stddev_pop(p), 4).alias("stddev"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


@query("correlations", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def correlations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query(
    "price_histogram",
    "SELECT least(floor((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / ((SELECT (max(l_extendedprice) - min(l_extendedprice)) / 10 FROM lineitem))), 9)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1",
)
def price_histogram(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)


@query(
    "pivot_status",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
)
def pivot_status(spark, sf_dir):
    some = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s.lower())
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(some("F"), some("O"), some("P"))


@query("conversation_turns", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count("*").alias("n"))
    return g.select("conv_id", F.array_join("x.role", ",").alias("roles"), "n")
