"""Queries that hold many small functions against SQL: arrays, maps, texts, statistics, checks, matches, places and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from jotspark.functions import arrays as A
from jotspark.functions import formats as X
from jotspark.functions import fuzzy as Z
from jotspark.functions import higher as H
from jotspark.functions import maps as M
from jotspark.functions import places as L
from jotspark.functions import statistics as N
from jotspark.functions import strings as S
from jotspark.functions import texts as T
from jotspark.functions import values as V
from jotspark.functions.speech import is_ipv6
from jotspark.operators import tables as O
from jotspark.plans.columns import registry
from jotspark.plans.relational import table

QUERIES, ORACLE, query = registry()


@query(
    "array_shapes",
    """WITH p AS (SELECT p_partkey, [p_size, p_size % 5, p_size % 5, p_size % 3] AS v FROM part)
    SELECT p_partkey, [v[1:3], v[4:4]] AS chunks, [v[1:2], v[2:3], v[3:4]] AS windows, v[2:] AS tail, v[1:3] AS butlast, list_filter(v, lambda x, i: i = 1 OR x <> v[i - 1]) AS deduped, v[3:] || v[1:2] AS rotated, [v[1], 0, v[2], 0, v[3], 0, v[4]] AS spaced, v || v AS cycled,
    [[v[1], 1], [v[1], 2], [v[2], 1], [v[2], 2]] AS crossed, [v[1], v[4]] AS pulled, [list_filter(v, lambda x: x > 2), list_filter(v, lambda x: x <= 2)] AS parts, list_filter(v, lambda x: x <= 2) AS rejected, v[3] AS indexed, v[1]::VARCHAR AS zipped, list_filter(v, lambda x: x NOT IN (0)) AS no_zero_all,
    list_sort(v) AS ordered, list_min(v) AS least, len(list_filter(v, lambda x: x > 40)) > 0 AS some_big, len(list_filter(v, lambda x: x > 40)) = 0 AS none_big, list_filter(v, lambda x: x > 2)[1] AS found, list_sort(list_transform(v, lambda x: len(list_filter(v, lambda y: y > x)) + 1)) AS ranked, [v[1], v[1] + 1, v[2], v[2] + 1, v[3], v[3] + 1, v[4], v[4] + 1] AS mapped,
    [NULL, v[1], v[2], v[3]] AS lagged, [v[2], v[3], v[4], NULL] AS led, [v[1], 9, v[2], v[3], v[4]] AS interleaved, CASE WHEN v[1] <= 2 THEN [] WHEN v[2] <= 2 THEN v[1:1] WHEN v[4] <= 2 THEN v[1:3] ELSE v END AS taken FROM p""",
    lists="chunks windows tail butlast deduped rotated spaced cycled crossed pulled parts rejected no_zero_all ordered ranked mapped lagged led interleaved taken",
)
def array_shapes(spark, sf_dir):
    z = F.col("p_size")
    v = F.col("v")
    big = lambda x: x > 2
    return table(spark, sf_dir, "part").select("p_partkey", F.array(z, z % 5, z % 5, z % 3).alias("v")).select(
        "p_partkey", A.chunk(v, 3).alias("chunks"), A.pairwise(v).alias("windows"), A.tail(v).alias("tail"), A.butlast(v).alias("butlast"), A.dedupe(v).alias("deduped"), A.rotate(v, 2).alias("rotated"), H.interpose(v, 0).alias("spaced"), H.cycle(v, 2).alias("cycled"),
        H.cartesian(F.slice(v, 1, 2), F.array(F.lit(1), F.lit(2))).alias("crossed"), H.pull_at(v, 0, -1).alias("pulled"), H.partition(v, big).alias("parts"), H.reject(v, big).alias("rejected"), A.index_at(v, 2).alias("indexed"), F.element_at(H.zipmap(F.array(F.lit("a"), F.lit("b")), v), "a").cast("string").alias("zipped"),
        H.compact(F.transform(v, lambda x: F.nullif(x, F.lit(0)))).alias("no_zero_all"), H.order_by(v, lambda x: x).alias("ordered"), H.min_by(v, lambda x: x).alias("least"), H.some(v, lambda x: x > 40).alias("some_big"), H.none(v, lambda x: x > 40).alias("none_big"), H.find(v, big).alias("found"),
        F.array_sort(H.rank(v)).alias("ranked"), H.flat_map(v, lambda x: F.array(x, x + 1)).alias("mapped"), H.lag(v).alias("lagged"), H.lead(v).alias("led"), H.interleave(v, F.array(F.lit(9))).alias("interleaved"), H.take_while(v, big).alias("taken"),
    )


@query(
    "map_shapes",
    """SELECT c_custkey, ['a', 'b'] AS names, c_name AS from_items, 'fallback' AS defaulted, ['b'] AS picked, [c_name, c_mktsegment] AS inverted, ['b', 'x'] AS renamed, ['b'] AS no_nulls, ['c'] AS added, ['a'] AS removed, ['b'] AS changed, ['b', 'z'] AS patched,
    repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked, 100.0 * (2 + CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END) / 3 AS complete, ['a:' || c_name, 'b:' || c_mktsegment] AS item_texts FROM customer""",
    lists="names picked renamed no_nulls added removed changed patched item_texts inverted",
)
def map_shapes(spark, sf_dir):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    d = F.create_map(F.lit("a"), n, F.lit("b"), m)
    e = F.create_map(F.lit("b"), F.lit("other"), F.lit("c"), n)
    pairs = F.array(F.struct(F.lit("a").alias("key"), F.lit("old").alias("value")), F.struct(F.lit("a").alias("key"), n.alias("value")))
    diff = M.diff(d, e)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", M.keys(d).alias("names"), F.element_at(M.from_items(pairs), "a").alias("from_items"), F.element_at(M.defaults(d, F.create_map(F.lit("q"), F.lit("fallback"))), "q").alias("defaulted"), M.keys(M.pick(d, "b", "zz")).alias("picked"), M.keys(M.invert(d)).alias("_inv"),
        M.keys(M.rename_keys(d, {"a": "x"})).alias("renamed"), M.keys(M.remove_nulls(F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), n))).alias("no_nulls"), diff["added"].alias("added"), diff["removed"].alias("removed"), diff["changed"].alias("changed"),
        M.keys(M.merge_patch(d, F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("z"), n))).alias("patched"), M.mask(n).alias("masked"), M.completeness(n, m, F.when(F.col("c_nationkey") % 2 == 0, m)).alias("complete"), F.transform(M.items(d), lambda x: F.concat_ws(":", x["key"], x["value"])).alias("item_texts"),
    ).withColumn("inverted", F.when(F.get("_inv", F.lit(0)).startswith("Customer"), F.col("_inv")).otherwise(F.reverse("_inv"))).drop("_inv")


@query(
    "text_shapes",
    r"""WITH p AS (SELECT p_partkey, p_name, p_brand, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])) AS w FROM part)
    SELECT p_partkey, array_to_string(w, '') AS pascal, lower(array_to_string(w, '')[1]) || array_to_string(w, '')[2:] AS camel, array_to_string(w, '-') AS train, array_to_string(w, ' ') AS title, upper(array_to_string(w, '_')) AS shouty_snake, upper(array_to_string(w, '-')) AS shouty_kebab,
    false AS blank, p_name AS spaces, rpad(p_brand, 12, '.') AS padded, repeat(' ', (20 - length(p_brand)) // 2) || p_brand || repeat(' ', 20 - length(p_brand) - (20 - length(p_brand)) // 2) AS centered, substr(p_brand, 7) AS no_prefix, left(p_name, length(p_name) - length(string_split(p_name, ' ')[-1])) AS no_suffix, regexp_replace(p_name, '[aeiou]+', '#', 'g') AS redacted,
    array_to_string(string_split(p_name, ' '), '+') AS imploded, string_split(p_name, ' ') AS words, length(p_name) - strpos(reverse(p_name), 'e') AS last_e, list_filter(range(0, length(p_name)), lambda i: substr(p_name, i + 1, 1) = 'e') AS all_e, left(p_name, 4) AS cut, p_name AS plain_regex,
    len(string_split(p_name, ' ')) AS n_words, list_transform(string_split(p_name, ' '), lambda x: lower(x)) AS tokens, list_transform(range(1, len(string_split(p_name, ' ')) - 1), lambda i: array_to_string(string_split(p_name, ' ')[i:i + 2], ' ')) AS triples, len(regexp_extract_all(p_name, 'e')) AS e_count, contains(p_name, 'red') OR contains(p_name, 'blue') AS any_colour,
    contains(p_name, 'red') AND contains(p_name, 'blue') AS both_colours, list_filter(['red', 'blue'], lambda x: contains(p_name, x)) AS colours, len(list_filter(['red', 'blue'], lambda x: contains(p_name, x))) AS n_colours, replace(replace(p_name, 'red', 'R'), 'blue', 'B') AS replaced, regexp_extract(p_name, 'e(.*?)e', 1) AS between_e, p_brand LIKE 'Brand#1%' AS brand_1 FROM p WHERE regexp_matches(p_name, '^[a-z ]+$') AND regexp_matches(p_name, 'e.*e')""",
    lists="words all_e tokens triples colours",
)
def text_shapes(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    w = F.split(n, " ")
    return table(spark, sf_dir, "part").filter(n.rlike("^[a-z ]+$") & n.rlike("e.*e")).select(
        "p_partkey", S.pascal_case(n).alias("pascal"), S.camel_case(n).alias("camel"), S.train_case(n).alias("train"), S.title_case(n).alias("title"), S.shouty_snake_case(n).alias("shouty_snake"), S.shouty_kebab_case(n).alias("shouty_kebab"), S.is_blank(n).alias("blank"),
        S.normalize_whitespace(F.replace(F.concat(F.lit(" "), n), F.lit(" "), F.lit("  "))).alias("spaces"), S.pad_right(b, 12, ".").alias("padded"), S.center(b, 20).alias("centered"), S.ltrimstr(b, "Brand#").alias("no_prefix"), F.concat(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.lit(" ")).alias("no_suffix"),
        S.redact_pattern(n, "[aeiou]+", "#").alias("redacted"), S.implode(w, "+").alias("imploded"), S.words(n).alias("words"), T.find_last(n, "e").alias("last_e"), Z.indices(n, "e").alias("all_e"), Z.abbreviate(n, 4, "long suffix").alias("cut"), Z.escape_regex(n).alias("plain_regex"), T.word_count(n).alias("n_words"), T.tokens(n).alias("tokens"),
        T.ngrams(n, 3).alias("triples"), F.element_at(Z.char_frequencies(n), "e").alias("e_count"), T.match_any(n, ["red", "blue"]).alias("any_colour"), T.match_all(n, ["red", "blue"]).alias("both_colours"), T.match_which(n, ["red", "blue"]).alias("colours"), T.match_count(n, ["red", "blue"]).alias("n_colours"),
        Z.replace_many(n, {"red": "R", "blue": "B"}).alias("replaced"), T.extract_between(n, "e", "e").alias("between_e"), b.startswith("Brand#1").alias("brand_1"),
    )


@query(
    "array_measures",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) >= 12),
    s AS (SELECT vec_id, v, list_avg(v) AS m, list_stddev_pop(v) AS sd, list_min(v) AS low, list_max(v) AS high, list_median(v) AS mid FROM e)
    SELECT vec_id, round(list_sum(v), 9) AS total, list_transform(v, lambda x: round((x - m) / sd * 1e5)::BIGINT) AS scores, list_transform(v, lambda x: round((x - low) / (high - low) * 1e5)::BIGINT) AS unit, round(list_median(list_transform(v, lambda x: abs(x - mid))), 9) AS mad, round(list_var_pop(v), 9) AS var, round(sd, 9) AS sd,
    round(list_avg(list_transform(v, lambda x: pow((x - m) / sd, 3))), 6) AS skewness, round(quantile_.q1, 9) AS q1, round(quantile_.q3, 9) AS q3, list_transform(range(1, 11), lambda i: round((v[i] + v[i + 1] + v[i + 2]) / 3 * 1e5)::BIGINT) AS moving, list_transform(range(2, 13), lambda i: round((v[i] - v[i - 1]) / v[i - 1] * 100)::BIGINT) AS rates, round(list_avg(list_transform(range(1, 13), lambda i: (v[i] - m) * (i - 6.5))), 7) AS with_place,
    round(v[3] * 0.25 + v[2] * 0.1875 + v[1] * 0.5625, 9) AS third_ewma FROM s, LATERAL (SELECT quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.75) AS q3 FROM (SELECT unnest(v) AS u)) quantile_""",
    lists="scores unit moving rates",
)
def array_measures(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 12).select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("v"))
    v = F.col("v")
    r = lambda a, k=1e5: F.transform(a, lambda x: F.round(x * k).cast("long"))
    q = N.quartiles(v)
    return e.select(
        "vec_id", F.round(N.total(v), 9).alias("total"), r(N.z_scores(v)).alias("scores"), r(N.normalize(v)).alias("unit"), F.round(N.mad(v), 9).alias("mad"), F.round(N.variance(v), 9).alias("var"), F.round(N.stddev(v), 9).alias("sd"), F.round(N.skew(v), 6).alias("skewness"),
        F.round(N.quantile(v, 0.25), 9).alias("q1"), F.round(q["q3"], 9).alias("q3"), F.slice(r(N.moving_average(v, 3)), F.greatest(F.size(N.moving_average(v, 3)) - 9, F.lit(1)), F.lit(10)).alias("moving"), r(N.rate_of_change(v), 1).alias("rates"),
        F.round(N.covariance(v, F.transform(v, lambda x, i: i.cast("double"))), 7).alias("with_place"), F.round(F.get(N.ewma(v, 0.25), F.lit(2)), 9).alias("third_ewma"),
    )


@query(
    "format_checks",
    """WITH t AS (SELECT c_custkey, c_custkey % 9 AS k FROM customer),
    s AS (SELECT c_custkey, k, CASE k WHEN 0 THEN 'a' || c_custkey || '@mail.org' WHEN 1 THEN '10.0.' || c_custkey % 300 || '.1' WHEN 2 THEN '2024-02-' || (20 + c_custkey % 14) WHEN 3 THEN '{"a":' || c_custkey || '}' WHEN 4 THEN '4111 1111 1111 1111' WHEN 5 THEN 'https://x.org/' || c_custkey WHEN 6 THEN 'deadBEEF' WHEN 7 THEN '+49 30 ' || 1000000 + c_custkey ELSE '2001:db8::' || c_custkey % 10000 END AS s FROM t)
    SELECT c_custkey, k = 0 AS email, k = 1 AND c_custkey % 300 <= 255 AS ipv4, k = 8 AS ipv6, k = 2 AND 20 + c_custkey % 14 <= 29 AS iso_date, k IN (3) AS json_object, k = 5 AS url, k = 6 AS hex, coalesce(k = 4, false) AS card, k = 7 AS phone, false AS jwt, false AS uuid,
    CASE WHEN k = 1 AND c_custkey % 300 <= 255 THEN true WHEN k = 1 THEN NULL END AS private, CASE WHEN k = 1 AND c_custkey % 300 <= 255 THEN c_custkey % 300 < 128 WHEN k = 1 THEN NULL END AS in_block, 'Latin' AS script, '2024.1.' || c_custkey || '' AS joined FROM s""",
)
def format_checks(spark, sf_dir):
    c = F.col("c_custkey")
    k, text = c % 9, c.cast("string")
    s = F.when(k == 0, F.concat(F.lit("a"), text, F.lit("@mail.org"))).when(k == 1, F.concat(F.lit("10.0."), (c % 300).cast("string"), F.lit(".1"))).when(k == 2, F.concat(F.lit("2024-02-"), (c % 14 + 20).cast("string"))).when(k == 3, F.concat(F.lit('{"a":'), text, F.lit("}")))
    s = s.when(k == 4, "4111 1111 1111 1111").when(k == 5, F.concat(F.lit("https://x.org/"), text)).when(k == 6, "deadBEEF").when(k == 7, F.concat(F.lit("+49 30 "), (c + 1000000).cast("string"))).otherwise(F.concat(F.lit("2001:db8::"), (c % 10000).cast("string")))
    x = F.col("s")
    ip = F.when(k == 1, x)
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("s")).select(
        "c_custkey", V.is_email(x).alias("email"), Z.is_ipv4(x).alias("ipv4"), is_ipv6(x).alias("ipv6"), Z.is_iso_date(x).alias("iso_date"), (Z.is_json(x) & x.startswith("{")).alias("json_object"), T.is_url(x).alias("url"), (T.is_hex(x) & x.rlike("[a-f]")).alias("hex"),
        F.when(k == 4, V.luhn_check(x)).otherwise(False).alias("card"), (T.is_phone(x) & x.contains(" ")).alias("phone"), T.is_jwt(x).alias("jwt"), V.is_uuid(x).alias("uuid"), V.is_private_ip(ip).alias("private"), V.cidr_contains("10.0.0.0/17", ip).alias("in_block"), Z.detect_script(F.lit("abc")).alias("script"),
        F.concat_ws(".", F.lit("2024"), F.lit("1"), text).alias("joined"),
    )


@query(
    "format_values",
    """SELECT p_partkey, p_size * 90 AS parsed, CASE WHEN p_size * 90 >= 3600 THEN (p_size * 90 // 3600) || 'h' ELSE '' END || CASE WHEN p_size * 90 % 3600 >= 60 THEN (p_size * 90 % 3600 // 60) || 'm' ELSE '' END || CASE WHEN p_size * 90 % 60 > 0 THEN (p_size * 90 % 60) || 's' ELSE '' END AS added, p_size * 1500.0 AS bytes,
    p_size AS minor, p_size || '.' || 3 AS rest, CASE WHEN p_size > 20 THEN 1 WHEN p_size < 20 THEN -1 ELSE 0 END AS compared, true AS valid, '/data/part' AS directory, 'p' || p_partkey || '.tar' AS stem, '.gz' AS ext, '/data/part/x' AS joined, lower(printf('#%02x%02x%02x', 255 - p_size, 255, 0)) AS inverted, p_size AS red,
    round(p_size * 1.609344, 6) AS km, round(p_size * 0.45359237, 6) AS kg, round(p_size * 3.785411784, 6) AS litres, round(p_size * 1.8 + 32, 6) AS fahrenheit, p_size || '.00 KB' AS shown FROM part""",
)
def format_values(spark, sf_dir):
    z = F.col("p_size")
    text = z.cast("string")
    version = F.concat(F.lit("1."), text, F.lit(".3"))
    path = F.concat(F.lit("/data/part/p"), F.col("p_partkey").cast("string"), F.lit(".tar.gz"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.parse_duration(F.concat(text, F.lit("m "), (z * 30).cast("string"), F.lit("s"))).alias("parsed"), X.duration_add(F.concat(text, F.lit("m")), F.concat((z * 30).cast("string"), F.lit("s"))).alias("added"), X.parse_bytes(F.concat((z * 1.5).cast("string"), F.lit(" kb"))).alias("bytes"),
        L.semver_part(version, "minor").alias("minor"), F.concat_ws(".", L.semver_part(version, "minor").cast("string"), L.semver_part(version, "patch").cast("string")).alias("rest"), X.semver_compare(version, F.lit("1.20.3")).alias("compared"), X.semver_is_valid(version).alias("valid"),
        X.path_dirname(path).alias("directory"), X.path_stem(path).alias("stem"), X.path_ext(path).alias("ext"), L.path_join(F.lit("/data"), F.lit("part/"), F.lit("x")).alias("joined"), X.color_invert(X.rgb_to_hex(z, F.lit(0), F.lit(255))).alias("inverted"), X.hex_to_rgb(X.rgb_to_hex(z, F.lit(0), F.lit(255)))["r"].alias("red"),
        F.round(X.convert(z, "mi", "km", X.LENGTH), 6).alias("km"), F.round(X.convert(z, "lbs", "kg", X.MASS), 6).alias("kg"), F.round(X.convert(z, "gal", "l", X.VOLUME), 6).alias("litres"), F.round(X.convert_temperature(z, "C", "F"), 6).alias("fahrenheit"), V.format_bytes(z * 1000).alias("shown"),
    )


@query(
    "event_distances",
    """WITH e AS (SELECT event_id, (event_id % 170 - 85.0) AS lat, (user_id % 350 - 175.0) AS lon FROM events), d AS (SELECT *, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 50) / 2), 2) + cos(radians(50)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2))) AS km FROM e)
    SELECT event_id, round(km, 5) AS km, round(km * 0.621371192237334, 3) AS miles, km * 1000 <= 3000000 AS near, lat BETWEEN 40 AND 60 AND lon BETWEEN -10 AND 30 AS boxed FROM d""",
)
def event_distances(spark, sf_dir):
    lat, lon, a, b = F.col("event_id") % 170 - 85.0, F.col("user_id") % 350 - 175.0, F.lit(50.0), F.lit(10.0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(L.geo_distance_km(lat, lon, a, b), 5).alias("km"), F.round(L.geo_distance_miles(lat, lon, a, b), 3).alias("miles"), L.geo_in_radius(lat, lon, 50.0, 10.0, 3_000_000).alias("near"), X.geo_in_bbox(lat, lon, 40.0, -10.0, 60.0, 30.0).alias("boxed")
    )


@query("exact_quartiles", "SELECT p_brand, count(*) AS n, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.5), 4) AS q2, round(quantile_cont(p_retailprice, 0.75), 4) AS q3 FROM part GROUP BY p_brand")
def exact_quartiles(spark, sf_dir):
    q = O.exact_quantiles(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return q.select("p_brand", "n", *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")])


@query("price_outliers", "WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN q USING (o_orderstatus) WHERE o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)")
def price_outliers(spark, sf_dir):
    return O.outliers_iqr(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", 0.5).select("o_orderkey")


@query("names_apart", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name < 'B')")
def names_apart(spark, sf_dir):
    few = table(spark, sf_dir, "region").filter("r_name < 'B'").select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf_dir, "nation").join(few, "n_regionkey", "left_anti").select("n_nationkey")


@query("field_profile", """SELECT 'c_custkey' AS field, count(*) AS n, 0 AS nulls, min(c_custkey)::VARCHAR AS least, max(c_custkey)::VARCHAR AS highest FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), 0, min(c_mktsegment), max(c_mktsegment) FROM customer
    UNION ALL SELECT 'even', count(*) FILTER (c_custkey % 2 = 0), count(*) FILTER (c_custkey % 2 = 1), ((min(c_custkey) + 1) // 2 * 2)::VARCHAR, (max(c_custkey) // 2 * 2)::VARCHAR FROM customer""")
def field_profile(spark, sf_dir):
    k = F.col("c_custkey")
    return O.profile(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(k % 2 == 0, k).alias("even"))).select("field", "n", "nulls", "least", "highest")


@query("version_choices", "SELECT p_partkey, p_size BETWEEN 5 AND 5 OR p_size > 30 AS either, true AS any_one, p_size = 7 AS wild, p_size >= 9 AS caret_wild, false AS other FROM part")
def version_choices(spark, sf_dir):
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".3"))
    w = L.semver_satisfies
    return table(spark, sf_dir, "part").select("p_partkey", w(v, "=1.5.3 || >1.30.3").alias("either"), w(v, "1.x").alias("any_one"), w(v, "1.7.*").alias("wild"), w(v, "^1.9").alias("caret_wild"), w(v, "2.*.x").alias("other"))
