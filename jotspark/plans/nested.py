"""Queries for functions of elements, places, versions and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from jotspark.functions import fuzzy as Z
from jotspark.functions import higher as H
from jotspark.functions import places as P
from jotspark.plans.relational import table

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def register(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return register


@query(
    "element_tests",
    """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, (list_position(list_transform(embedding, lambda x: x < 0), true) - 1)::BIGINT AS first_negative,
    len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <= 0)) = 0 AS all_positive, embedding[1] AS head, list_max(embedding) AS greatest,
    CASE WHEN list_position(list_transform(embedding, lambda x: x < 0), true) IS NULL THEN 0 ELSE len(embedding) - list_position(list_transform(embedding, lambda x: x < 0), true) + 1 END::BIGINT AS after FROM embeddings WHERE len(embedding) > 0""",
)
def element_tests(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").filter(F.size(e) > 0).select(
        "vec_id", H.count_where(e, lambda x: x > 0).alias("positive"), H.find_index(e, lambda x: x < 0).alias("first_negative"), H.every(e, lambda x: x > 0).alias("all_positive"),
        F.get(e, F.lit(0)).alias("head"), H.max_by(e, lambda x: x).alias("greatest"), F.size(H.drop_while(e, lambda x: x >= 0)).cast("long").alias("after"),
    )


@query(
    "word_pairs",
    r"""SELECT p_partkey, w[1] AS first_word, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS bigrams, len(w) * (len(w) - 1) // 2 AS pairs,
    array_to_string(list_filter(w, lambda x: lower(x) NOT IN ('red', 'blue')), ' ') AS kept FROM (SELECT p_partkey, string_split_regex(trim(p_name), '\s+') AS w FROM part)""",
)
def word_pairs(spark, sf_dir):
    w = F.split(F.trim("p_name"), r"\s+")
    two = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.concat_ws(" ", x, y))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(w, F.lit(0)).alias("first_word"), two.alias("bigrams"), F.size(H.pairs(w)).cast("long").alias("pairs"), Z.remove_words(F.col("p_name"), ["red", "blue"]).alias("kept"))


@query(
    "address_blocks",
    """SELECT c_custkey, '10.' || (n // 256 % 256) || '.' || (n % 256 // 16 * 16) || '.0' AS network, '10.' || (n // 256 % 256) || '.' || (n % 256 // 16 * 16 + 15) || '.255' AS broadcast, 20 AS prefix
    FROM (SELECT c_custkey, c_custkey::BIGINT AS n FROM customer)""",
)
def address_blocks(spark, sf_dir):
    n = F.col("c_custkey").cast("long")
    cidr = F.concat(F.lit("10."), (F.floor(n / 256) % 256).cast("string"), F.lit("."), (n % 256).cast("string"), F.lit(".77/20"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.cidr_network(cidr).alias("network"), P.cidr_broadcast(cidr).alias("broadcast"), P.cidr_prefix(cidr).alias("prefix"))


@query(
    "version_ranges",
    """SELECT p_partkey, CASE WHEN p_size > 20 THEN 2 ELSE 1 END = 1 AND p_size >= 5 AS caret, p_size = 7 AS tilde, p_size >= 10 AND p_size < 30 AS span FROM part""",
)
def version_ranges(spark, sf_dir):
    size = F.col("p_size")
    s = F.concat(F.when(size > 20, "2.").otherwise("1."), size.cast("string"), F.lit(".3"))
    t = F.concat(F.lit("0."), size.cast("string"), F.lit(".1"))
    return table(spark, sf_dir, "part").select("p_partkey", P.semver_satisfies(s, "^1.5.0").alias("caret"), P.semver_satisfies(t, "~0.7.0").alias("tilde"), P.semver_satisfies(t, ">=0.10.0, <0.30.0").alias("span"))


@query(
    "name_likeness",
    """SELECT s_suppkey, n_name, damerau_levenshtein(lower(n_name), lower(r_name)) AS edits, round(jaro_similarity(n_name, r_name), 9) AS jaro
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def name_likeness(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, r = F.col("n_name"), F.col("r_name")
    named = nations.select("n_nationkey", n, Z.osa_distance(F.lower(n), F.lower(r)).alias("edits"), F.round(Z.jaro(n, r), 9).alias("jaro"))
    return table(spark, sf_dir, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "edits", "jaro")


@query(
    "query_strings",
    """SELECT c_custkey, 'key=' || c_custkey || '&name=' || replace(c_name, '#', '%23') AS built, c_name AS name_again FROM customer""",
)
def query_strings(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("key"), F.col("c_custkey").cast("string"))
    built = P.query_string_build(m)
    return table(spark, sf_dir, "customer").select("c_custkey", built.alias("built"), F.element_at(P.query_string_parse(built), "name").alias("name_again"))
