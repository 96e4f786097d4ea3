"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from jotspark.functions import arrays as A
from jotspark.functions import strings as S
from jotspark.functions import values as V
from jotspark.plans.relational import table


def registry():
    """Queries by name, their SQL, and a decorator that adds to both; lists: names of array columns, which are given as JSON texts."""
    queries, oracle = {}, {}

    def query(name, sql, lists=""):
        def register(fn):
            def listed(spark, sf_dir):
                return fn(spark, sf_dir).withColumns({c: F.to_json(c) for c in lists.split()})

            queries[name] = listed if lists else fn
            oracle[name] = f"SELECT * REPLACE ({', '.join(f'to_json({c})::VARCHAR AS {c}' for c in lists.split())}) FROM ({sql})" if lists else sql
            return fn

        return register

    return queries, oracle, query


QUERIES, ORACLE, query = registry()


@query(
    "string_cases",
    r"""SELECT c_custkey, lower(replace(c_name, '#', '_')) AS snake, lower(replace(c_name, '#', '-')) AS kebab, reverse(c_name) AS rev,
    CASE WHEN length(c_name) <= 12 THEN c_name ELSE left(c_name, 9) || '...' END AS short,
    CASE WHEN length(c_mktsegment) >= 12 THEN c_mktsegment ELSE lpad(c_mktsegment, 12, '.') END AS padded,
    repeat('*', greatest(length(c_name) - 4, 0)::INT) || right(c_name, 4) AS hidden FROM customer""",
)
def string_cases(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.snake_case(n).alias("snake"), S.kebab_case(n).alias("kebab"), S.reverse_string(n).alias("rev"), S.truncate(n, 12).alias("short"), S.pad_left(F.col("c_mktsegment"), 12, ".").alias("padded"), S.obscure(n).alias("hidden")
    )


@query(
    "string_search",
    """SELECT p_partkey, nullif(instr(p_name, 'a'), 0) - 1 AS first_a, length(p_name) AS n, starts_with(p_type, 'S') AS s, p_name ILIKE '%b%' AS has_b,
    upper(left(p_name, 1)) || substr(p_name, 2) AS cap FROM part""",
)
def string_search(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.find_first(n, "a").alias("first_a"), F.length(n).alias("n"), F.col("p_type").startswith("S").alias("s"), n.ilike("%b%").alias("has_b"), S.capitalize(n).alias("cap"))


@query("fuzzy_pairs", "SELECT n_nationkey, levenshtein(n_name, 'FRANCE') AS d, round(1 - levenshtein(n_name, 'FRANCE') / greatest(length(n_name), 6)::DOUBLE, 6) AS s FROM nation")
def fuzzy_pairs(spark, sf_dir):
    a, b = F.col("n_name"), F.lit("FRANCE")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.levenshtein(a, b).alias("d"), F.round(S.normalized_levenshtein(a, b), 6).alias("s"))


@query("hashes", "SELECT s_suppkey, md5(s_name) AS md5, sha1(s_name) AS sha1, sha256(s_name) AS sha256, to_base64(encode(s_name)) AS b64, lower(to_hex(encode(s_name))) AS hex FROM supplier")
def hashes(spark, sf_dir):
    n = F.col("s_name").cast("binary")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.md5(n).alias("md5"), F.sha1(n).alias("sha1"), F.sha2(n, 256).alias("sha256"), F.base64(n).alias("b64"), F.lower(F.hex(n)).alias("hex"))


@query(
    "array_basics",
    "SELECT vec_id, embedding[1] AS a, embedding[-1] AS z, len(embedding) AS n, list_sum(list_transform(embedding[1:3], lambda x: x::DOUBLE)) AS head, len(embedding[3:]) AS rest, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS mean, round(list_sum(list_transform(embedding[1:len(embedding):3], lambda x: x::DOUBLE)), 9) AS thirds FROM embeddings",
)
def array_basics(spark, sf_dir):
    e = F.col("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.first(e).alias("a"), A.last(e).alias("z"), F.size(e).alias("n"), total(A.take(e, 3)).alias("head"), F.size(A.drop(e, 2)).alias("rest"), F.round(A.mean(e), 9).alias("mean"), F.round(total(A.slice_step(e, 0, None, 3)), 9).alias("thirds"))


@query(
    "dates",
    """SELECT o_orderkey, isodow(o_orderdate) >= 6 AS weekend, quarter(o_orderdate) AS quarter, date_trunc('month', o_orderdate)::TIMESTAMP AS month, epoch(o_orderdate)::BIGINT AS epoch,
    date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate, '%Y-%m-%d') AS text,
    (SELECT count(*) FROM range(TIMESTAMP '1990-01-01', o_orderdate::DATE::TIMESTAMP, INTERVAL 1 DAY) x(d) WHERE isodow(d) < 6) AS business FROM orders""",
)
def dates(spark, sf_dir):
    t, since = F.col("o_orderdate"), F.lit("1990-01-01").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", V.is_weekend(t).alias("weekend"), F.quarter(t).alias("quarter"), V.start_of("month", t).cast("timestamp_ntz").alias("month"), V.to_epoch(t).alias("epoch"), V.date_diff_days(t, since).alias("days"),
        F.date_format(t, "yyyy-MM-dd").alias("text"), V.business_days_between(since, t.cast("date")).alias("business"),
    )


@query(
    "geography",
    "SELECT s_suppkey, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(s_nationkey - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(s_nationkey)) * pow(sin(radians(s_suppkey % 90 - 20.0) / 2), 2))), 3) AS metres FROM supplier",
)
def geography(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(V.geo_distance(F.lit(10.0), F.lit(20.0), F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 90).cast("double")), 3).alias("metres"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok, json_keys(props) AS keys FROM events")
def json_fields(spark, sf_dir):
    v = F.col("v")  # parsed once
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v")).select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("ok"), keys.alias("keys"))


@query("url_hosts", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def url_hosts(spark, sf_dir):
    u = V.url_parse(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u["scheme"].alias("scheme"), u["host"].alias("host"))


@query(
    "word_counts",
    r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT AS n, length(text) AS chars, len(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')))::BIGINT AS kinds FROM documents",
)
def word_counts(spark, sf_dir):
    t = F.col("text")
    words = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    both = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("kinds"))
    once = table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.element_at(F.transform(F.array(words), both), 1).alias("x"))  # the text is split once
    return once.select("doc_id", F.col("x.n").cast("long").alias("n"), "chars", F.col("x.kinds").cast("long").alias("kinds"))


@query("network", "SELECT c_custkey, ((c_custkey * 7919) % 4294967296) AS n, ((c_custkey * 7919) % 4294967296) // 16777216 || '.' || ((c_custkey * 7919) // 65536 % 256) || '.' || ((c_custkey * 7919) // 256 % 256) || '.' || ((c_custkey * 7919) % 256) AS ip FROM customer")
def network(spark, sf_dir):
    ip = V.int_to_ip(F.col("c_custkey") * 7919 % 4294967296)
    return table(spark, sf_dir, "customer").select("c_custkey", V.ip_to_int(ip).alias("n"), ip.alias("ip"))
