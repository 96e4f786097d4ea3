"""Queries for times, sound codes, languages, ranked likeness and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from jotspark.functions import moments as T
from jotspark.functions import speech as P
from jotspark.operators import tables as O
from jotspark.plans.columns import registry
from jotspark.plans.relational import table

QUERIES, ORACLE, query = registry()


@query(
    "time_functions",
    """WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS t, epoch(o_orderdate::TIMESTAMP)::BIGINT AS e FROM orders)
    SELECT o_orderkey, e AS parsed, e AS parsed_form, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(t, '%Y-%m-%dT00:00:00Z') AS us_form, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS from_epoch, strftime(t, '%Y-%m-%dT%H:%M:%S.500Z') AS from_ms, e * 1000 AS to_ms, e + 7200 AS added, e - 604800 AS earlier,
    t < TIMESTAMP '1995-06-01' AS before, t > TIMESTAMP '1995-06-01' AS after, t BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' AS between_, t::DATE = DATE '1995-06-01' AS same_day, isodow(t) < 6 AS weekday, abs(date_diff('day', t::DATE, DATE '2000-01-01'))::BIGINT AS days,
    t > TIMESTAMP '2000-01-01' AS future, (t::DATE - 1)::VARCHAR || 'T00:00:00Z' AS yesterday, (t::DATE - 3)::VARCHAR || 'T00:00:00Z' AS three_days_ago, (t::DATE + 14)::VARCHAR || 'T00:00:00Z' AS in_two_weeks, (t::DATE + ((4 - (isodow(t) - 1) + 6)::INTEGER % 7 + 1)::INTEGER)::VARCHAR || 'T00:00:00Z' AS next_friday, NULL::VARCHAR AS unread,
    CASE WHEN t > TIMESTAMP '2000-01-01' THEN 'in ' ELSE '' END || CASE abs(date_diff('day', t::DATE, DATE '2000-01-01')) WHEN 0 THEN '0 second' WHEN 1 THEN '1 day' ELSE abs(date_diff('day', t::DATE, DATE '2000-01-01')) || ' day' END || CASE WHEN abs(date_diff('day', t::DATE, DATE '2000-01-01')) = 1 THEN '' ELSE 's' END || CASE WHEN t > TIMESTAMP '2000-01-01' THEN '' ELSE ' ago' END AS human FROM o""",
)
def time_functions(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("day", "o_orderdate").alias("t"))
    t = F.col("t")
    e, mid, day = F.unix_timestamp(t), F.lit("1995-06-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")
    gap = T.duration_since(t, day)
    natural = lambda s: T.parse_natural_date(F.lit(s), t)
    return d.select(
        "o_orderkey", T.parse_date(F.date_format(t, "yyyy-MM-dd HH:mm:ss")).alias("parsed"), T.parse_date(F.date_format(t, "dd.MM.yyyy HH:mm"), "dd.MM.yyyy HH:mm").alias("parsed_form"), T.parse_datetime(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"),
        T.parse_datetime(F.date_format(t, "MM/dd/yyyy")).alias("us_form"), T.from_epoch(e).alias("from_epoch"), T.from_epoch_ms(e * 1000 + 500).alias("from_ms"), T.to_epoch_ms(t).alias("to_ms"), T.date_add(e, 2, "h").alias("added"), T.date_add(e, -1, "w").alias("earlier"),
        T.is_before(t, mid).alias("before"), T.is_after(t, mid).alias("after"), T.is_between(t, F.lit("1994-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")).alias("between_"), T.is_same_day(t, mid).alias("same_day"), T.is_weekday(t).alias("weekday"), gap["days"].alias("days"),
        gap["is_future"].alias("future"), natural("yesterday").alias("yesterday"), natural("3 days ago").alias("three_days_ago"), natural("in 2 weeks").alias("in_two_weeks"), natural("next friday").alias("next_friday"), natural("soon").alias("unread"), T.relative_time(t, day).alias("human"),
    )


@query(
    "language_names",
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'the colour of the part is ' WHEN 1 THEN 'die Farbe von dem Teil ist nicht ' WHEN 2 THEN 'la couleur de cette pièce est dans ' WHEN 3 THEN 'el color de los coches por ' ELSE 'xyz ' END || p_name AS s FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'English' WHEN 1 THEN 'Deutsch' WHEN 2 THEN 'Français' WHEN 3 THEN 'Español' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'deu' WHEN 2 THEN 'fra' WHEN 3 THEN 'spa' END AS iso, p_partkey % 5 < 4 AS sure,
    list_filter(string_split(s, ' '), lambda w: lower(w) NOT IN ('the', 'of', 'is', 'la')) AS kept, p_partkey % 5 = 0 AS first_is_stop, 'couleur de piece' AS plain FROM t""",
    lists="kept",
)
def language_names(spark, sf_dir):
    k = F.col("p_partkey") % 5
    s = F.concat(F.when(k == 0, "the colour of the part is ").when(k == 1, "die Farbe von dem Teil ist nicht ").when(k == 2, "la couleur de cette pièce est dans ").when(k == 3, "el color de los coches por ").otherwise("xyz "), F.col("p_name"))
    words = F.split("s", " ")
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select(
        "p_partkey", P.detect_language(F.col("s")).alias("name"), P.detect_language_iso(F.col("s")).alias("iso"), F.coalesce(P.detect_language_confidence(F.col("s")) > 0.5, F.lit(False)).alias("sure"), F.filter(P.remove_stopwords(words), lambda w: w != "la").alias("kept"),
        P.is_stopword(F.get(words, F.lit(0))).alias("first_is_stop"), P.remove_accents(F.lit("couleur de pièce")).alias("plain"),
    )


@query(
    "ranked_names",
    """WITH n AS (SELECT n_nationkey, n_name, lower(n_name) AS v FROM nation)
    SELECT n_nationkey, CASE WHEN v = 'nation_1' THEN 'exact' WHEN starts_with(v, 'nation_1') THEN 'prefix' WHEN contains(v, 'nation_1') THEN 'contains' WHEN jaro_winkler_similarity(v, 'nation_1') > 0.8 THEN 'fuzzy' ELSE 'none' END AS kind,
    CASE WHEN v = 'nation_1' THEN 1000 WHEN starts_with(v, 'nation_1') THEN 800 WHEN contains(v, 'nation_1') THEN 600 WHEN jaro_winkler_similarity(v, 'nation_1') > 0.8 THEN 400 ELSE 0 END AS score,
    round(1 - damerau_levenshtein(v, 'nation_1') / greatest(length(v), 8), 9) AS likeness, list_filter(range(0, length(v)), lambda i: substr(v, i + 1, 1) IN ('a', 'i')) AS places FROM n""",
    lists="places",
)
def ranked_names(spark, sf_dir):
    from jotspark.functions.fuzzy import osa_distance

    n = F.col("n_name")
    m, v, q = P.fuzzy_match(n, "nation_1"), F.lower(n), F.lit("nation_1")
    return table(spark, sf_dir, "nation").select("n_nationkey", m["match_type"].alias("kind"), P.fuzzy_score(n, "nation_1").alias("score"), F.round(P.normalized_damerau_levenshtein(v, q, osa_distance(v, q)), 9).alias("likeness"), F.transform(P.extract_all(v, ["a", "i"]), lambda x: x["start"]).alias("places"))


@query("made_ids", "SELECT s_suppkey, true AS uuid_ok, true AS nanoid_ok, true AS ulid_ok, true AS int_ok, true AS choice_ok, 6 AS shuffled, 2 AS sampled FROM supplier")
def made_ids(spark, sf_dir):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", P.uuid().rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("uuid_ok"), P.nanoid().rlike("^[A-Za-z0-9_-]{21}$").alias("nanoid_ok"), P.ulid().rlike("^[0-9A-HJKMNP-TV-Z]{26}$").alias("ulid_ok"), P.random_int(2, 4).between(2, 4).alias("int_ok"),
        P.random_choice(a).isin(1, 2, 3).alias("choice_ok"), F.aggregate(P.shuffle(a), F.lit(0), lambda s, x: s + x).alias("shuffled"), F.size(P.sample(a, 2)).alias("sampled"),
    )


@query("page_of_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_orders(spark, sf_dir):
    return O.paginate(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, 20, F.desc("o_totalprice"), "o_orderkey")


@query(
    "searched_parts",
    """WITH s AS (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS b FROM part), m AS (SELECT *, CASE WHEN n = 'red' THEN 1000 WHEN starts_with(n, 'red') THEN 800 WHEN contains(n, 'red') THEN 600 WHEN jaro_winkler_similarity(n, 'red') > 0.8 THEN 400 ELSE 0 END AS x,
    CASE WHEN b = 'red' THEN 500 WHEN starts_with(b, 'red') THEN 400 WHEN contains(b, 'red') THEN 300 WHEN jaro_winkler_similarity(b, 'red') > 0.8 THEN 200 ELSE 0 END AS y FROM s) SELECT p_partkey, greatest(x, y) AS score, CASE WHEN x >= y THEN 'p_name' ELSE 'p_brand' END AS matched FROM m WHERE greatest(x, y) > 0""",
)
def searched_parts(spark, sf_dir):
    from jotspark.operators.search import fuzzy_search

    return fuzzy_search(table(spark, sf_dir, "part"), "Red", {"p_name": 10, "p_brand": 5}).select("p_partkey", "score", "matched")
