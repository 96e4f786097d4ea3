from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jotspark.functions import fuzzy as Z
from jotspark.functions import higher as H
from jotspark.functions import places as P

L = F.lit


def one(spark, *columns):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return r[0] if len(columns) == 1 else list(r)


def ints(*values):
    return F.array(*[L(v) for v in values]).cast("array<int>")


def test_element_tests(spark):
    a, no, none = ints(3, None, 1, 4, 1), F.array().cast("array<int>"), L(None).cast("array<int>")
    big = lambda x: x > 2
    assert one(spark, H.find_index(a, big), H.find(a, lambda x: x == 9), H.count_where(a, big), H.every(a, big), H.some(no, big), H.none(no, big)) == [0, None, 2, False, False, True]
    assert one(spark, H.take_while(a, big), H.drop_while(a, big), H.drop_while(no, big), H.take_while(none, big), H.partition(a, big)) == [[3], [None, 1, 4, 1], [], None, [[3, 4], [None, 1, 1]]]


def test_keys_of_elements(spark):
    a = ints(11, 2, 21, 13)
    ten = lambda x: F.pmod(x, L(10))
    assert one(spark, H.order_by(a, ten), H.order_by(a, ten, True), H.min_by(a, ten), H.max_by(a, ten), H.unique_by(a, ten)) == [[11, 21, 2, 13], [13, 2, 11, 21], 11, 13, [11, 2, 13]]
    assert one(spark, H.group_by(a, ten), H.count_by(a, ten), H.index_by(a, ten)) == [{"1": [11, 21], "2": [2], "3": [13]}, {"1": 2, "2": 1, "3": 1}, {"1": 21, "2": 2, "3": 13}]
    assert one(spark, H.rank(ints(5, 9, 9, 1)), H.dense_rank(ints(5, 9, 9, 1))) == [[3, 1, 1, 4], [2, 1, 1, 3]]


def test_rearranged(spark):
    a = ints(1, 2, 3)
    assert one(spark, H.lag(a), H.lead(a), H.interpose(a, 0), H.interleave(a, ints(7, 8)), H.cycle(ints(1), 2)) == [[None, 1, 2], [2, 3, None], [1, 0, 2, 0, 3], [1, 7, 2, 8, 3], [1, 1]]
    assert one(spark, H.cartesian(ints(1, 2), ints(3)), H.pairs(a), H.pull_at(a, -1, 0, 9), H.zipmap(F.array(L("a"), L("b"), L("a")), a)) == [[[1, 3], [2, 3]], [[1, 2], [1, 3], [2, 3]], [3, 1, None], {"b": 2, "a": 3}]


def test_places(spark):
    cell = one(spark, P.geohash_decode(L("ezs42")))
    assert cell["lat"] == pytest.approx(42.605, abs=1e-3) and cell["lon"] == pytest.approx(-5.603, abs=1e-3)
    middle = one(spark, P.geo_midpoint(L(0.0), L(170.0), L(0.0), L(-170.0)))
    assert middle["lat"] == pytest.approx(0) and abs(middle["lon"]) == pytest.approx(180)
    assert one(spark, P.geohash_decode(L("a")), P.cidr_network(L("192.168.77.9/20")), P.cidr_broadcast(L("192.168.77.9/20")), P.cidr_prefix(L("1.2.3.4/33"))) == [None, "192.168.64.0", "192.168.79.255", None]
    assert one(spark, P.path_join(L("a/"), L("b")), P.path_join(L("a"), L("/b")), P.color_mix(L("#ff0000"), L("#0000ff")), P.color_mix(L("red"), L("#0000ff"))) == ["a/b", "/b", "#800080", None]
    assert one(spark, P.query_string_parse(L("?a=1&b=x%20y&a=2&c"))) == {"b": "x y", "a": "2", "c": ""}


@pytest.mark.parametrize("version, wanted, ok", [("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.3.0", "^0.2.1", False), ("0.2.9", "^0.2.1", True), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", ">=1.2.0, <2.0.0", True), ("1.0.0", "=1.0.1", False)])
def test_version_ranges(spark, version, wanted, ok):
    assert one(spark, P.semver_satisfies(L(version), wanted)) is ok


def test_likeness(spark):
    null = L(None).cast("string")
    assert one(spark, Z.osa_distance(L("ca"), L("abc")), Z.osa_distance(L("teh"), L("the")), Z.osa_distance(null, L("a")), Z.jaro(L(""), L("")), Z.jaro(L(""), L("a"))) == [3, 1, None, 1.0, 0.0]
    assert one(spark, Z.jaro(L("MARTHA"), L("MARHTA")), Z.jaro_winkler(L("MARTHA"), L("MARHTA")), Z.jaro(L("DIXON"), L("DICKSONX"))) == pytest.approx([0.944444, 0.961111, 0.766667], abs=1e-5)
    assert one(spark, Z.match_rating_codex(L("Catherine")), Z.sounds_like(L("Robert"), L("Rupert"))) == ["CTHRN", True]


def test_text_measures(spark):
    assert one(spark, Z.word_frequencies(L("A b, a")), Z.char_frequencies(L("aab")), Z.remove_words(L("the  cat The end"), ["the"]), Z.indices(L("aaa"), "aa"), Z.indices(L(""), "a")) == [{"a": 2, "b": 1}, {"a": 2, "b": 1}, "cat end", [0, 1], []]
    assert [tuple(x) for x in one(spark, Z.match_positions(L("xyz"), ["z", "q"]))] == [("z", 2)]
    assert one(spark, Z.replace_many(L("a-b"), {"a": "1", "-": "+"}), Z.escape_regex(L("a.b")), Z.abbreviate(L("abcdefgh"), 6), Z.detect_script(L("привет a")), Z.detect_script(L("1"))) == ["1+b", r"a\.b", "abc...", "Cyrillic", None]


def test_checks(spark):
    assert one(spark, Z.is_base64(L("YWI=")), Z.is_base64(L("YW=")), Z.is_ipv4(L("1.2.3.4")), Z.is_ipv4(L("1.2.3.256")), Z.is_iso_date(L("2024-02-30")), Z.is_iso_date(L("2024-02-29")), Z.is_json(L("{")), Z.is_json(L("[1]"))) == [True, False, True, False, False, True, False, True]
    token = L("eyJhbGciOiJub25lIn0.eyJhIjoxfQ.")
    assert one(spark, Z.jwt_part(token, 0), Z.jwt_part(token, 1), Z.jwt_part(L("x"), 0)) == ['{"alg":"none"}', '{"a":1}', None]
    assert one(spark, Z.ulid_timestamp(L("01ARZ3NDEKTSV4RRFFQ69G5FAV")), Z.ulid_timestamp(L("x"))) == [1469922850259, None]
    now = L(datetime(2024, 1, 4))
    assert one(spark, Z.time_ago(L(datetime(2024, 1, 1)), now), Z.time_ago(L(datetime(2024, 1, 4, 1)), now), Z.time_ago(now, now)) == ["3 days ago", "in 1 hour", "0 seconds ago"]
