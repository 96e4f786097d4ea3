import math

import duckdb
import numpy as np

from jotspark.llm import top_k as module
from jotspark.llm.top_k import Lists, Rows, top_k


def brute(rows, picked, k):
    """rows: (id, vector); picked: positions of the queries. Exact integers, clamped to 64 bits."""
    v = {n: [int(math.floor(y * 1024)) if abs(y) < 2**43 else int(y) * 1024 for y in x] for n, (i, x) in enumerate(rows) if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    out = []
    for q in picked:
        if q in v:
            score = lambda n: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[n], strict=False))))
            best = sorted((-score(n), rows[n][0], n) for n in v if n != q)[:k]
            out += [(rows[q][0], r, i, -s) for r, (s, i, _) in enumerate(best, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 5)
    monkeypatch.setattr(module, "TILE", 2)
    monkeypatch.setattr(module, "HEAD", 9)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=7)]) for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [None] * 7), (2002, [float("nan")] * 7), (2003, [float("inf")] + [0.0] * 6), (None, [1.0] * 7), (20, [2.0, 3.0])]
    rows += [(10, rows[3][1]), (10, rows[3][1]), (30, rows[30][1])]  # rows of one id
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<float>, key string, score double").repartition(3)
    picked = [n for n, (i, _) in enumerate(rows) if i is not None and i % 10 == 0]
    assert found(top_k(df, df.vec_id % 10 == 0, k=5)) == brute(rows, picked, 5)
    assert found(top_k(df, df.vec_id % 10 == 0, k=5, lists=3)) == brute(rows, picked, 5)


def test_components_beyond_doubles_and_longs(spark):
    rows = [(0, [1e20, -3.5]), (1, [2e20, 1.0]), (2, [-1e20, 2.0]), (3, [1.5, 2.5]), (4, [3e15, 0.1]), (5, [4e6, -4e6]), (6, [1e308, 1e308]), (7, [-1e308, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(top_k(df, df.vec_id >= 0, k=4)) == brute(rows, range(8), 4)


def test_other_queries_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert found(top_k(df, df.vec_id >= 0, k=10)) == [(0, 1, 1, 1024 * 1024), (1, 1, 0, 1024 * 1024)]
    assert len(found(top_k(df, df))) == 4  # other rows: none is a query's own
    assert top_k(df.limit(0), df.limit(0).vec_id >= 0).count() == 0
    assert top_k(df, df.vec_id > 5).count() == 0


def test_phases_touch_what_they_need():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 16)) * np.exp(rng.normal(size=(6000, 1)))
    index = Lists(Rows(x.ravel(), np.full(6000, 16), 16), 2)
    q = Rows(rng.normal(size=3 * 16), np.full(3, 16), 16).y
    cut = np.array([np.sort(s)[-10] for _, s in index.heads(q, 10)])
    assert index.touched[0] == 3 * 2 * module.HEAD
    got = list(index.above(q, cut))
    for i in range(3):
        scores = index.rows.y @ q[i]
        want = np.flatnonzero(scores >= cut[i])
        assert len(want) >= 10 and sorted(got[i][0]) == want.tolist() and (np.sort(got[i][1]) == np.sort(scores[want])).all()
    assert index.touched[1] < 0.7 * 3 * 2 * 6000 and index.touched[2] < 0.1 * 3 * 6000


def test_sql_on_fixture():
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.execute("insert into embeddings values (0, [1.0, 2.0]), (100, [0.5, 0.25]), (7, NULL), (8, [NULL, 1])")
    assert sorted(con.execute(module.ORACLE).fetchall()) == [(0, 1, 100, 1024 * 512 + 2048 * 256), (100, 1, 0, 1024 * 512 + 2048 * 256)]
