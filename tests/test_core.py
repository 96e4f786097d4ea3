import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jotspark.functions import arrays as A
from jotspark.functions import strings as S
from jotspark.functions import values as V
from jotspark.plans.catalog import ORACLE, QUERIES
from jotspark.sources import files
from jotspark.streaming import events

SF = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return str([cell(y) for y in x])
    if pd.isna(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas().astype(object), con.execute(ORACLE[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_strings(spark):
    s = F.lit("helloWorld HTTPServer_name")
    assert one(spark, S.snake_case(s)) == "hello_world_http_server_name"
    assert one(spark, S.camel_case(s)) == "helloWorldHttpServerName"
    assert one(spark, S.train_case(F.lit("a_b"))) == "A-B"
    assert one(spark, S.center(F.lit("ab"), 5, "*")) == "*ab**"
    assert one(spark, S.hamming(F.lit("abc"), F.lit("abd"))) == 1
    assert one(spark, S.semver_parse(F.lit("1.2.3-rc1"))).minor == 2
    assert one(spark, S.semver_parse(F.lit("1.2"))) is None


@pytest.mark.parametrize("start,stop,step", [(0, None, 1), (1, 4, 1), (-3, None, 1), (None, None, -1), (4, 0, -2), (None, -2, 2), (9, None, 1)])
def test_slices(spark, start, stop, step):
    a = [3, 1, 4, 1, 5, 9]
    assert one(spark, A.slice_step(F.array(*map(F.lit, a)), start, stop, step)) == a[start:stop:step]


def test_arrays(spark):
    a = F.array(*map(F.lit, [1, 1, 2, 3]))
    assert one(spark, A.chunk(a, 3)) == [[1, 1, 2], [3]]
    assert one(spark, A.sliding_window(a, 2)) == [[1, 1], [1, 2], [2, 3]]
    assert one(spark, A.dedupe(a)) == [1, 2, 3]
    assert one(spark, A.rotate(a, 1)) == [1, 2, 3, 1]
    assert one(spark, A.frequencies(a)) == {"1": 2, "2": 1, "3": 1}


def test_values(spark):
    assert one(spark, V.is_private_ip(F.lit("192.168.3.4"))) and not one(spark, V.is_private_ip(F.lit("8.8.8.8")))
    assert one(spark, V.ip_to_int(F.lit("1.2.3.4"))) == 16909060
    assert one(spark, V.ip_to_int(F.lit("1.2.3.400"))) is None
    assert one(spark, V.format_bytes(F.lit(1500))) == "1.50 KB"


def test_files_and_stream(spark, tmp_path):
    df = spark.range(3).select("id", F.struct((F.col("id") * 2).alias("b")).alias("a"))
    for kind in ("parquet", "ndjson", "csv"):
        files.write(df, str(tmp_path / f"x.{kind}"), kind)
        assert files.read(spark, str(tmp_path / f"x.{kind}")).count() == 3
    assert "a.b" in files.read(spark, str(tmp_path / "x.csv")).columns
    lines = spark.readStream.text(str(tmp_path / "x.ndjson"))
    q = events.parsed_lines(lines, "id long, a struct<b: long>").writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("parsed").count() == 3
