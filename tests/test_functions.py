import numpy as np
import pytest
from pyspark.sql import functions as F

from jotspark.functions import formats as X
from jotspark.functions import maps as M
from jotspark.functions import statistics as N
from jotspark.functions import texts as T
from jotspark.operators.search import bm25, term_counts


def one(spark, *columns):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return r[0] if len(columns) == 1 else list(r)


def test_durations_and_sizes(spark):
    L = F.lit
    assert one(spark, X.parse_duration(L("1h 30m")), X.parse_duration(L("2 weeks")), X.parse_duration(L("90")), X.parse_duration(L("5 parsecs")), X.parse_duration(L(""))) == [5400, 1209600, 90, None, None]
    assert one(spark, X.format_duration(L(93784)), X.format_duration(L(0)), X.duration_add(L("1h"), L("30m")), X.duration_subtract(L("1m"), L("1h"))) == ["1d2h3m4s", "0s", "1h30m", "0s"]
    assert one(spark, X.parse_bytes(L("1.5 KB")), X.parse_bytes(L("2kib")), X.parse_bytes(L("3 xb"))) == [1500.0, 2048.0, None]


def test_versions_sort(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.0.10", "1.2.0"]
    pairs = [X.semver_compare(F.lit(a), F.lit(b)) for a, b in zip(order, order[1:])]
    assert one(spark, *pairs) == [-1] * len(pairs)
    assert one(spark, X.semver_compare(F.lit("1.0.0"), F.lit("v1.0.0")), X.semver_compare(F.lit("x"), F.lit("1.0.0"))) == [0, None]


def test_paths(spark):
    p = F.lit("/a/b.c/d.tar.gz/")
    assert one(spark, X.path_basename(p), X.path_dirname(p), X.path_ext(p), X.path_stem(p)) == ["d.tar.gz", "/a/b.c", ".gz", "d.tar"]
    assert one(spark, X.path_ext(F.lit("/.profile")), X.path_stem(F.lit("/"))) == ["", None]


def test_colours(spark):
    c = F.lit("#ff0000")
    assert one(spark, X.color_invert(c), X.color_complement(c), X.color_grayscale(c), X.lighten(c, 50), X.darken(F.lit("#fff"), 100), X.lighten(F.lit("red"), 5)) == ["#00ffff", "#00ffff", "#4c4c4c", "#ff8080", "#000000", None]


def test_geography(spark):
    got = one(spark, X.geohash_encode(F.lit(57.64911), F.lit(10.40744), 11), X.geohash_encode(F.lit(91.0), F.lit(0.0)), X.geo_bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(9.0)))
    assert got[:2] == ["u4pruydqqvj", None] and got[2] == pytest.approx(90)


def test_maps(spark):
    a, b = F.create_map(*map(F.lit, ["x", 1, "y", 2])), F.create_map(*map(F.lit, ["y", 3, "z", 4]))
    assert one(spark, M.merge(a, b), M.defaults(a, b), M.pick(a, "x"), M.omit(a, "x")) == [{"x": 1, "y": 3, "z": 4}, {"x": 1, "y": 2, "z": 4}, {"x": 1}, {"y": 2}]
    assert one(spark, M.rename_keys(a, {"x": "y"}), M.invert(a), M.keys(b)) == [{"y": 2}, {"1": "x", "2": "y"}, ["y", "z"]]
    d = one(spark, M.diff(a, b))
    assert (d.added, d.removed, d.changed) == (["z"], ["x"], ["y"])
    nulls = F.create_map(F.lit("x"), F.lit(None).cast("int"), F.lit("z"), F.lit(9))
    assert one(spark, M.merge_patch(a, nulls), M.mask(F.lit("123456")), M.mask(F.lit("12"))) == [{"y": 2, "z": 9}, "**3456", "**"]


def test_statistics(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    a, e = F.array(*map(F.lit, v)), F.array().cast("array<double>")
    z = (np.array(v) - np.mean(v)) / np.std(v)
    got = one(spark, N.variance(a), N.quantile(a, 0.3), N.trend_slope(a), N.skew(a), N.kurtosis(a), N.mad(a))
    assert got == pytest.approx([np.var(v), np.quantile(v, 0.3), np.polyfit(range(6), v, 1)[0], (z**3).mean(), (z**4).mean() - 3, np.median(abs(np.array(v) - 3.5))])
    assert one(spark, N.z_scores(a)) == pytest.approx(list(z))
    assert one(spark, N.variance(e), N.quantile(e, 0.5), N.trend_slope(e), N.skew(e), N.moving_average(e, 2), N.rate_of_change(e), N.ewma(e, 0.5)) == [None, None, 0.0, None, [], [], []]
    assert one(spark, N.moving_average(a, 3))[:3] == [None, None, pytest.approx(8 / 3)]
    assert one(spark, N.ewma(F.array(F.lit(2.0), F.lit(4.0)), 0.5), N.rate_of_change(F.array(F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(5.0))), N.correlation(a, a)) == [[2.0, 3.0], [50.0, -100.0, 0.0], pytest.approx(1.0)]


def test_texts(spark):
    s = F.lit("One [two] three. Four [five]!\n\nEnd")
    assert one(spark, T.sentence_count(s), T.paragraph_count(s), T.word_count(s), T.sentence_count(F.lit(" ")), T.sentence_count(F.lit("x"))) == [2, 2, 6, 0, 1]
    assert one(spark, T.extract_between(s, "[", "]"), T.extract_between(s, "<", "]"), T.find_last(s, "["), T.find_last(s, "<")) == ["two", None, 22, None]
    assert one(spark, T.ngrams(F.lit("a b c"), 2), T.tokens(F.lit("A-b, 'c' ..")), T.split_keep(F.lit("a,b,,c"), ",")) == [[["a", "b"], ["b", "c"]], ["ab", "c"], ["a", ",", "b", ",", ",", "c"]]
    assert one(spark, T.match_any(s, ["x", "two"]), T.match_all(s, ["x", "two"]), T.match_which(s, ["x", "two"]), T.match_count(F.lit("aaa.b"), ["aa", "."])) == [True, False, ["two"], 2]
    assert one(spark, T.html_unescape(T.html_escape(F.lit("<a href='x'>&\"")))) == "<a href='x'>&\""
    assert one(spark, T.base64url_decode(T.base64url_encode(F.lit("ü?>~")))) == "ü?>~"
    assert one(spark, T.sorensen_dice(F.lit("night"), F.lit("nacht")), T.sorensen_dice(F.lit("aaa"), F.lit("aa")), T.sorensen_dice(F.lit(""), F.lit("a"))) == [0.25, pytest.approx(2 / 3), 0.0]


def test_search(spark):
    df = spark.createDataFrame([(1, "red fox and red hen"), (2, "a red hen"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.score for r in bm25(df, "id", "text", ["fox", "red"]).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]
    assert bm25(df.limit(0), "id", "text", ["fox"]).count() == 0
    assert {tuple(r) for r in term_counts(df, "text").collect()} == {("red", 3, 2), ("fox", 1, 1), ("and", 1, 1), ("hen", 2, 2), ("a", 1, 1)}
