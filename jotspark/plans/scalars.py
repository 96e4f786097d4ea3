"""Queries for numbers, types, bits, texts, CSV texts and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from jotspark.functions import scalars as S
from jotspark.functions import strings as N
from jotspark.plans.columns import registry
from jotspark.plans.relational import table

QUERIES, ORACLE, query = registry()


@query(
    "number_functions",
    """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_extendedprice / 7)::BIGINT AS up, floor(l_extendedprice / 7)::BIGINT AS down, round(sin(l_quantity), 9) AS sine, round(cos(l_quantity), 9) AS cosine, round(tan(l_discount), 9) AS tangent,
    round(asin(l_discount), 9) AS arcsine, round(acos(l_discount), 9) AS arccosine, round(atan(l_quantity), 9) AS arctangent, round(atan2(l_quantity - 25, l_discount), 9) AS angle, round(sqrt(l_quantity), 9) AS root, round(pow(l_quantity, 3), 3) AS cube, round(ln(l_quantity), 9) AS natural,
    round(ln(l_quantity) / ln(2), 9) AS binary_log, round(radians(l_quantity), 9) AS rad, round(degrees(l_discount), 9) AS deg, sign(l_quantity - 25)::BIGINT AS sgn, l_quantity + l_tax AS added, l_quantity - l_tax AS taken, l_quantity * l_tax AS times,
    l_extendedprice / l_quantity AS parts, l_orderkey % 7 AS remainder, -l_orderkey % 7 AS negative_remainder, printf('%.2f', l_extendedprice) AS fixed, format('{:,.0f}', floor(l_extendedprice)) AS grouped, printf('%.1fk', floor(l_extendedprice / 1000)) AS thousands, NULL::DOUBLE AS outside FROM lineitem""",
)
def number_functions(spark, sf_dir):
    q, p, d, k = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey"))
    r = lambda x, n=9: F.round(x, n)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(q - 25).alias("a"), F.ceil(p / 7).alias("up"), F.floor(p / 7).alias("down"), r(F.sin(q)).alias("sine"), r(F.cos(q)).alias("cosine"), r(F.tan(d)).alias("tangent"), r(S.asin(d)).alias("arcsine"), r(S.acos(d)).alias("arccosine"), r(F.atan(q)).alias("arctangent"),
        r(F.atan2(q - 25, d)).alias("angle"), r(S.sqrt(q)).alias("root"), r(F.pow(q, 3), 3).alias("cube"), r(S.log(q)).alias("natural"), r(S.log(q, 2)).alias("binary_log"), r(F.radians(q)).alias("rad"), r(F.degrees(d)).alias("deg"), S.sign(q - 25).alias("sgn"), (q + F.col("l_tax")).alias("added"),
        (q - F.col("l_tax")).alias("taken"), (q * F.col("l_tax")).alias("times"), S.divide(p, q).alias("parts"), S.mod(k, F.lit(7)).cast("long").alias("remainder"), S.mod(-k, F.lit(7)).cast("long").alias("negative_remainder"), S.to_fixed(p, 2).alias("fixed"), S.format_number(F.floor(p)).alias("grouped"),
        S.format_number(F.floor(p / 1000) * 1000, 1, "k").alias("thousands"), S.acos(q + 1).alias("outside"),
    )


@query(
    "bit_functions",
    "SELECT o_orderkey, o_orderkey & 255 AS both, o_orderkey | 4096 AS either, xor(o_orderkey, 12345) AS one, ~o_orderkey AS inverted, (o_orderkey & 65535) << 3 AS wider, o_orderkey >> 2 AS narrower FROM orders",
)
def bit_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", k.bitwiseAND(255).alias("both"), k.bitwiseOR(4096).alias("either"), k.bitwiseXOR(12345).alias("one"), F.bitwise_not(k).alias("inverted"), S.bit_shift_left(k.bitwiseAND(65535), 3).alias("wider"), S.bit_shift_right(k, 2).alias("narrower"))


@query(
    "type_functions",
    r"""WITH t AS (SELECT c_custkey, c_acctbal, CASE c_custkey % 8 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN 'Yes' WHEN 2 THEN 'off' WHEN 3 THEN 'null' WHEN 4 THEN '' WHEN 5 THEN '007' WHEN 6 THEN c_acctbal::VARCHAR ELSE c_name END AS s FROM customer)
    SELECT c_custkey, CASE WHEN regexp_matches(s, '^-?(0|[1-9]\d*)(\.\d+)?$') THEN s::DOUBLE END AS number, c_custkey::VARCHAR AS text, s <> '' AS truth, c_acctbal <> 0 AS number_truth, s = '' AS is_empty, 'number' AS kind_number, 'string' AS kind_text, true AS text_is_string, false AS text_is_array,
    len([s])::BIGINT AS listed, CASE WHEN trim(lower(s)) IN ('null') THEN NULL ELSE s END AS no_nulls, CASE WHEN lower(s) = 'yes' THEN true WHEN lower(s) = 'off' THEN false END AS booleans, CASE WHEN regexp_matches(trim(s), '^-?(0|[1-9]\d*)(\.\d+)?$') THEN trim(s)::DOUBLE END AS numbers,
    CASE WHEN s = 'Yes' THEN 'true' WHEN s = 'off' THEN 'false' WHEN regexp_matches(trim(s), '^-?(0|[1-9]\d*)(\.\d+)?$') THEN trim(s)::DOUBLE::VARCHAR WHEN s <> 'null' THEN s END AS parsed, coalesce(nullif(s, ''), 'none') AS first_of, CASE WHEN s <> '' THEN 'full' ELSE 'bare' END AS chosen FROM t""",
)
def type_functions(spark, sf_dir):
    k, b, text = F.col("c_custkey"), F.col("c_acctbal"), T.StringType()
    kind = k % 8
    s = F.when(kind == 0, " 12.5 ").when(kind == 1, "Yes").when(kind == 2, "off").when(kind == 3, "null").when(kind == 4, "").when(kind == 5, "007").when(kind == 6, b.cast("string")).otherwise(F.col("c_name"))
    parsed = S.auto_parse(F.col("s"))
    number = F.try_variant_get(parsed, "$", "double")
    shown = F.when(F.schema_of_variant(parsed).isin("VOID"), None).when(F.schema_of_variant(parsed).isin("BOOLEAN", "STRING"), F.try_variant_get(parsed, "$", "string")).otherwise(number.cast("string"))
    c = F.col("s")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", s.alias("s")).select(
        "c_custkey", S.to_number(c, text).alias("number"), S.to_text(k, T.LongType()).alias("text"), S.to_boolean(c, text).alias("truth"), S.to_boolean(b, T.DoubleType()).alias("number_truth"), S.is_empty(c, text).alias("is_empty"), S.type_of(b, T.DoubleType()).alias("kind_number"),
        S.type_of(c, text).alias("kind_text"), S.is_type(c, text, "string").alias("text_is_string"), S.is_type(c, text, "array").alias("text_is_array"), F.size(S.to_array(c, text)).cast("long").alias("listed"), S.parse_nulls(c).alias("no_nulls"), S.parse_booleans(c).alias("booleans"),
        S.parse_numbers(c).alias("numbers"), shown.alias("parsed"), F.coalesce(F.nullif(c, F.lit("")), F.lit("none")).alias("first_of"), S.if_(c, text, F.lit("full"), F.lit("bare")).alias("chosen"),
    )


@query(
    "text_functions",
    r"""SELECT p_partkey, upper(p_name) AS upper_name, lower(p_type) AS lower_type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled, substr(p_name, 3, 4) AS middle, right(p_name, 5) AS ending, repeat(p_brand, 2) AS twice,
    replace(p_name, 'a', '<&>') AS replaced, replace(replace(replace(replace(p_name, 'a', '<&>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, p_name AS unescaped, contains(p_name, 'red') AS has_red, contains(p_name, 'e') AS inside_e, ends_with(p_type, 'L') AS ends_l, list_transform(string_split(left(p_name, 3), ''), lambda c: unicode(c)) AS codes,
    ltrim('  ' || p_name) AS left_trimmed, rtrim(p_name || '  ') AS right_trimmed, printf('%s has %d', p_name, p_size) AS printed, p_name || ' (' || p_brand || ')' AS formatted, 'Part ' || p_name || ', size ' || p_size AS filled, replace(p_name, ' ', chr(10)) AS wrapped, p_name || ' aeon' AS plain,
    regexp_matches(p_name, '^[a-m]') AS early, regexp_replace(p_name, '[aeiou]', '*', 'g') AS consonants, string_split_regex(p_name, '[ e]') AS split_parts, regexp_extract_all(p_name, '[aeiou]+') AS vowels, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS human, lower(p_brand) || '-' || upper(p_brand) AS cases FROM part WHERE regexp_matches(p_name, '[aeiou]')""",
    lists="codes split_parts vowels",
)
def text_functions(spark, sf_dir):
    n, b, z = F.col("p_name"), F.col("p_brand"), F.col("p_size")
    marked = F.replace(n, F.lit("a"), F.lit("<&>"))
    return table(spark, sf_dir, "part").filter(n.rlike("[aeiou]")).select(
        "p_partkey", F.upper(n).alias("upper_name"), F.lower("p_type").alias("lower_type"), S.title(n).alias("titled"), S.substr(n, 2, 4).alias("middle"), S.substr(n, -5).alias("ending"), F.repeat(b, F.lit(2)).alias("twice"), marked.alias("replaced"), S.escape(marked).alias("escaped"),
        F.replace(S.unescape(S.escape(marked)), F.lit("<&>"), F.lit("a")).alias("unescaped"), F.contains(n, F.lit("red")).alias("has_red"), S.inside(F.lit("e"), n).alias("inside_e"), F.col("p_type").endswith("L").alias("ends_l"), S.explode_text(F.left(n, F.lit(3))).alias("codes"),
        S.trim_left(F.concat(F.lit("  "), n)).alias("left_trimmed"), S.trim_right(F.concat(n, F.lit("  "))).alias("right_trimmed"), F.format_string("%s has %d", n, z).alias("printed"), S.format_text("{0} ({brand})", n, brand=b).alias("formatted"),
        S.template("Part {{name}}, size {{ size }}", {"name": n, "size": z}, strict=True).alias("filled"), S.wrap(n, 1).alias("wrapped"), S.deburr(F.concat(n, F.lit(" æon"))).alias("plain"), n.rlike("^[a-m]").alias("early"), F.regexp_replace(n, "[aeiou]", "*").alias("consonants"),
        S.regex_split(n, "[ e]").alias("split_parts"), S.regex_extract(n, "[aeiou]+").alias("vowels"), N.capitalize(F.lower(n)).alias("human"), F.concat(F.lower(b), F.lit("-"), F.upper(b)).alias("cases"),
    )


@query(
    "encoded_texts",
    r"""SELECT s_suppkey, url_encode(s_name || ' é+') AS url, s_name || ' é+' AS back, s_name AS again, s_name AS unhexed, 'https://h' || s_suppkey || '.org/a?q=1' AS built FROM supplier""",
)
def encoded_texts(spark, sf_dir):
    n = F.col("s_name")
    odd = F.concat(n, F.lit(" é+"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", S.url_encode(odd).alias("url"), S.url_decode(S.url_encode(odd)).alias("back"), F.decode(F.unbase64(F.base64(n.cast("binary"))), "UTF-8").alias("again"), F.decode(F.unhex(F.hex(n.cast("binary"))), "UTF-8").alias("unhexed"),
        S.url_build(F.lit("https"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.lit(".org")), F.lit("/a"), F.lit("q=1")).alias("built"),
    )


@query(
    "keyed_hashes",
    """SELECT c_custkey, sha256(from_hex('373925' || repeat('5c', 61)) || from_hex(sha256(from_hex('5d534f' || repeat('36', 61)) || encode(c_name)))) AS hmac256, md5(from_hex('373925' || repeat('5c', 61)) || from_hex(md5(from_hex('5d534f' || repeat('36', 61)) || encode(c_name)))) AS hmac_md5,
    sha1(from_hex('373925' || repeat('5c', 61)) || from_hex(sha1(from_hex('5d534f' || repeat('36', 61)) || encode(c_name)))) AS hmac_sha1 FROM customer""",
)
def keyed_hashes(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", S.hmac(n, "key", "sha256").alias("hmac256"), S.hmac(n, "key", "md5").alias("hmac_md5"), S.hmac(n, "key", "sha1").alias("hmac_sha1"))


@query(
    "csv_texts",
    r"""SELECT c_custkey, '"' || c_name || ',x",' || c_mktsegment AS row_text, c_name || chr(9) || c_mktsegment AS tabbed, c_name || ',1' || chr(10) || c_mktsegment || ',"a""b"' AS rows_text, 'name,seg' || chr(10) || c_name || ',' || c_mktsegment AS table_text, [[c_name || ',x', c_mktsegment]] AS read_back FROM customer""",
    lists="read_back",
)
def csv_texts(spark, sf_dir):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    row = F.array(F.concat(n, F.lit(",x")), m)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.to_csv(row).alias("row_text"), S.to_csv(F.array(n, m), "\t").alias("tabbed"), S.to_csv_rows(F.array(F.array(n, F.lit("1")), F.array(m, F.lit('a"b')))).alias("rows_text"),
        S.to_csv_table(F.array(F.struct(n.alias("name"), m.alias("seg"))), ["name", "seg"]).alias("table_text"), S.from_csv(S.to_csv(row)).alias("read_back"),
    )
