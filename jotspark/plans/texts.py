"""Queries for formats, maps, array statistics, texts and ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from jotspark.functions import formats as X
from jotspark.functions import maps as M
from jotspark.functions import statistics as N
from jotspark.functions import texts as T
from jotspark.operators.search import bm25, term_counts
from jotspark.plans.relational import table

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def register(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return register


@query(
    "text_measures",
    r"""SELECT doc_id, length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS chars, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS marks,
    ceil(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 60 / 200.0)::BIGINT AS seconds FROM documents""",
)
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.char_count(t).cast("long").alias("chars"), F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("marks"), T.reading_time_seconds(t).alias("seconds"))


_TOKENS = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda w: lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'))), lambda w: w <> '')"


@query("term_counts", f"SELECT term, count(*)::BIGINT AS times, count(DISTINCT r)::BIGINT AS docs FROM (SELECT r, unnest(t) AS term FROM (SELECT row_number() OVER () AS r, {_TOKENS} AS t FROM documents)) GROUP BY term")
def all_terms(spark, sf_dir):
    return term_counts(table(spark, sf_dir, "documents"), "text")


@query(
    "bm25_search",
    f"""WITH d AS (SELECT item_id, {_TOKENS} AS t FROM benchmark), s AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d),
    q AS (SELECT unnest(['the', 'of', 'license']) AS w), f AS (SELECT item_id, w, len(t) AS n, len(list_filter(t, lambda x: x = w)) AS f FROM d, q),
    k AS (SELECT w, count(*) FILTER (f > 0) AS df FROM f GROUP BY w)
    SELECT item_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * f.n / m))), 6) AS score FROM f JOIN k USING (w), s WHERE f > 0 GROUP BY item_id""",
)
def bm25_search(spark, sf_dir):
    return bm25(table(spark, sf_dir, "benchmark"), "item_id", "text", ["the", "of", "license"]).select("item_id", F.round("score", 6).alias("score"))


@query(
    "escapes",
    """SELECT c_custkey, replace(replace('<' || c_name || '&', '&', '&amp;'), '<', '&lt;') AS html, chr(39) || c_name || chr(39) AS shell,
    rtrim(replace(replace(to_base64(encode(c_name)), '+', '-'), '/', '_'), '=') AS b64, c_name AS again FROM customer""",
)
def escapes(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.html_escape(F.concat(F.lit("<"), n, F.lit("&"))).alias("html"), T.shell_escape(n).alias("shell"), T.base64url_encode(n).alias("b64"), T.base64url_decode(T.base64url_encode(n)).alias("again"))


@query(
    "durations",
    """SELECT o_orderkey, o_orderkey % 60 AS m, (o_orderkey // 60) % 24 AS h, (o_orderkey * 60)::BIGINT AS seconds FROM orders""",
)
def durations(spark, sf_dir):
    s = F.col("o_orderkey") * 60
    return table(spark, sf_dir, "orders").select("o_orderkey", X.duration_part(s, "m").alias("m"), X.duration_part(s, "h").alias("h"), X.parse_duration(X.format_duration(s)).alias("seconds"))


@query(
    "colours",
    """SELECT c_custkey, printf('#%02x%02x%02x', 255 - c_custkey % 256, 255 - c_nationkey, 55) AS inverted,
    printf('#%02x%02x%02x', round((c_custkey % 256) / 2.0)::INT, round(c_nationkey / 2.0)::INT, 100) AS darker FROM customer""",
)
def colours(spark, sf_dir):
    c = X.rgb_to_hex(F.col("c_custkey") % 256, F.col("c_nationkey"), F.lit(200))
    return table(spark, sf_dir, "customer").select("c_custkey", X.color_invert(c).alias("inverted"), X.darken(c, 50).alias("darker"))


@query("conversions", "SELECT p_partkey, round(p_size * 0.0254 / 0.3048, 6) AS feet, round(p_size * 0.45359237, 6) AS kg, round((p_size - 32.0) * 5 / 9, 6) AS celsius FROM part")
def conversions(spark, sf_dir):
    s = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.convert(s, "in", "ft", X.LENGTH), 6).alias("feet"), F.round(X.convert(s, "lbs", "kg", X.MASS), 6).alias("kg"), F.round(X.convert_temperature(s, "F", "C"), 6).alias("celsius"))


@query("path_parts", r"SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base, starts_with(url, '/') AS absolute FROM pages")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.path_basename(u).alias("base"), X.path_is_absolute(u).alias("absolute"))


@query(
    "array_statistics",
    """SELECT vec_id, round(list_var_pop(e), 6) AS variance, round(list_median(e), 6) AS median, round(quantile_cont_, 6) AS q1, round(list_skewness_, 5) AS skew FROM (
    SELECT vec_id, e, (SELECT quantile_cont(x, 0.25) FROM (SELECT unnest(e) AS x)) AS quantile_cont_, (SELECT avg(pow((x - m) / s, 3)) FROM (SELECT unnest(e) AS x), (SELECT list_avg(e) AS m, list_stddev_pop(e) AS s)) AS list_skewness_
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
)
def array_statistics(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(N.variance(e), 6).alias("variance"), F.round(N.median(e), 6).alias("median"), F.round(N.quantile(e, 0.25), 6).alias("q1"), F.round(N.skew(e), 5).alias("skew"))


@query("object_keys", "SELECT event_id, list_sort(json_keys(props)) AS keys, len(json_keys(props))::BIGINT AS n FROM events")
def object_keys(spark, sf_dir):
    m = F.from_json("props", "map<string, string>")
    return table(spark, sf_dir, "events").select("event_id", M.keys(m).alias("keys"), F.size(M.omit(m, "none")).cast("long").alias("n"))
