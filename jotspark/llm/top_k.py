"""Exact top-k inner products by the three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jotspark.llm.common import stored, table

#: Queries that are sent to all tasks at once, queries scored side by side, and entries of a list that phase one scores in a batch of vectors.
BLOCK, TILE, HEAD = 8192, 128, 512
#: Products of whole numbers in doubles are exact while no sum can pass this.
EXACT = float(2**53)
LOW, HIGH = -(2**63), 2**63 - 1


def whole(vectors: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """vec_id and x (doubles) of the rows that take part: those with an id and a vector without null or non-finite components."""
    x = F.transform(F.col(vec_col), lambda y: y.cast("double"))
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), *more)


def integers(x: np.ndarray) -> list[int]:
    """floor(1024 * x) without a bound: a double of 2^43 or more is a whole number itself."""
    return [int(math.floor(y * 1024)) if abs(y) < 2**43 else int(y) * 1024 for y in x.tolist()]


class Rows:
    """Vectors as whole numbers: `y` (rows x dim) holds those whose products doubles can hold, `big` the integers of the others by row."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, dim: int):
        n = len(sizes)
        self.y = np.zeros((n, dim))
        at = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) if n else np.zeros(0, int)
        row = np.repeat(np.arange(n), sizes)
        self.y[row, at] = flat
        limit = math.sqrt(EXACT / max(1, dim)) / 1024 - 1
        over = np.flatnonzero(np.abs(self.y).max(1, initial=0.0) > limit)
        self.big = {int(i): integers(self.y[i]) for i in over}
        self.y[over] = 0.0
        self.y = np.floor(self.y * 1024)

    def integers(self, i: int) -> list[int]:
        return self.big.get(i) or [int(v) for v in self.y[i]]


def ranked(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, then keys."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((keys[at], ids[at], -scores[at]))][:k]
    return np.lexsort((keys, ids, -scores))[:k]


class Lists:
    """The score lists of a batch of vectors: runs of components, each with its entries by falling length, so that what can
    reach a score in a list is a head of it (Cauchy-Schwarz)."""

    def __init__(self, rows: Rows, lists: int):
        self.rows, dim = rows, rows.y.shape[1]
        cuts = np.linspace(0, dim, lists + 1).astype(int)
        self.runs = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.order, self.length, self.sorted = [], [], []
        for a, b in self.runs:
            length = np.sqrt((rows.y[:, a:b] ** 2).sum(1))
            order = np.argsort(-length, kind="stable")
            self.order.append(order)
            self.length.append(length[order])
            self.sorted.append(np.ascontiguousarray(rows.y[order, a:b]))
        self.touched = np.zeros(3, np.int64)  # entries scored in each phase

    def heads(self, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phase one, of each query: entries that are among the k best of a list's first HEAD, and their whole scores."""
        tops = []
        for (a, b), order, own in zip(self.runs, self.order, self.sorted, strict=True):
            part = q[:, a:b] @ own[:HEAD].T
            self.touched[0] += part.size
            n = min(k, part.shape[1])
            tops.append(order[np.argpartition(-part, n - 1, 1)[:, :n]] if n else np.zeros((len(q), 0), int))
        for i, x in enumerate(q):
            at = np.unique(np.concatenate([t[i] for t in tops]))
            yield at, self.rows.y[at] @ x

    def above(self, q: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phases two and three, of each query: what reaches cut in all has cut / lists or more in one list. Only entries that can are
        read, only those that do are collected, and only their remaining scores are resolved."""
        found: list[list[np.ndarray]] = [[] for _ in q]
        for (a, b), order, length, own in zip(self.runs, self.order, self.length, self.sorted, strict=True):
            each = cut / len(self.runs)
            mine = np.sqrt((q[:, a:b] ** 2).sum(1))
            need = np.where(each > 0, each / np.maximum(mine, 1e-300), -1.0) * (1 - 1e-9)
            reach = np.searchsorted(-length, -need, side="right")  # of each query: how many of the list's entries can
            far = int(reach.max(initial=0))
            if far:
                part = q[:, a:b] @ own[:far].T
                self.touched[1] += int(reach.sum())
                who, at = np.nonzero((part >= each[:, None]) & (np.arange(far) < reach[:, None]))
                for i, x in zip(*self.split(who, order[at]), strict=True):
                    found[i].append(x)
        for i, x in enumerate(q):
            at = np.unique(np.concatenate(found[i])) if found[i] else np.zeros(0, int)
            self.touched[2] += len(at)
            score = self.rows.y[at] @ x
            yield at[score >= cut[i]], score[score >= cut[i]]

    @staticmethod
    def split(who: np.ndarray, at: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
        return who[first].tolist(), np.split(at, first[1:]) if len(first) else []


class Best:
    """The k best entries of each query that a task has met: score, vec_id and key."""

    def __init__(self, n: int, k: int):
        self.k, self.of = k, [(np.zeros(0, np.int64),) * 3 for _ in range(n)]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        scores, ids, keys = (np.concatenate(x) for x in zip(self.of[i], (scores, ids, keys), strict=True))
        at = ranked(ids, keys, scores, self.k)
        self.of[i] = scores[at], ids[at], keys[at]


def clamped(total: int) -> int:
    return max(LOW, min(HIGH, total))


def top_k(vectors: DataFrame, queries: Column | DataFrame, k: int = 10, lists: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Returns query_id, rank, vec_id and score: the k highest integer inner products of each query, ties to smaller vec_id.

    queries: a condition that picks rows of vectors, which never find themselves; or other rows of the same columns, which find
    all vectors. Rows count by themselves, not by their ids: rows of one id are queries each and may find each other; their results
    stand under one query_id. Components are floor(1024 * x); missing trailing ones count as 0; a score beyond 64 bits is the nearest end
    of their range. Rows with a null id, or null or non-finite vectors, take no part; with fewer than k candidates all are
    returned; an empty table gives no rows.

    Components are cut into `lists` runs, and each run's products are one score list. (1) Each task gathers, for each query, the
    best entries from the heads of its lists, with whole scores; the k-th best of all is a safe cutoff t. (2) t goes back to all
    tasks, which collect the entries of t / lists or more in a list, reading only those whose length lets them get there. (3)
    The remaining scores of these are resolved, and the k best of t or more returned. Queries are taken in blocks of about
    BLOCK, so that what is sent to the tasks is bounded; vectors are neither copied nor shuffled, but read twice a block.
    """
    if isinstance(queries, DataFrame):
        v = whole(vectors, id_col, vec_col).withColumn("is_query", F.lit(False))
        v = v.unionByName(whole(queries, id_col, vec_col).withColumn("is_query", F.lit(None).cast("boolean")))  # null: a query, no candidate
    else:
        v = whole(vectors, id_col, vec_col, F.coalesce(queries, F.lit(False)).alias("is_query"))
    v = stored(v.withColumn("key", F.monotonically_increasing_id()))
    dims = v.agg(F.max(F.size("x")), F.sum((F.col("is_query").isNull() | F.col("is_query")).cast("long"))).first()
    dim, blocks = dims[0] or 0, max(1, math.ceil((dims[1] or 0) / BLOCK))
    asked = v.filter(F.col("is_query").isNull() | F.col("is_query")).select("key", "vec_id", "x")
    out = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key").toArrow()  # about BLOCK rows
        found = searched(v, own, dim, k, lists)
        out = found if out is None else out.unionByName(found)
    return out


def searched(v: DataFrame, own: pa.Table, dim: int, k: int, lists: int) -> DataFrame:
    """The top k of the queries in own (key, vec_id, x)."""
    spark = v.sparkSession
    q_keys, q_ids = own["key"].to_numpy(), own["vec_id"].to_numpy()
    sent = spark.sparkContext.broadcast((q_keys, q_ids, *parts(own["x"].combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.float64())))))
    all_rows = v.filter(F.col("is_query").isNotNull()).select("x", "vec_id", "key")
    kind = "q long, query_id long, vec_id long, key long, score long"

    def scan(cuts=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, names, flat, sizes = sent.value
            q = Rows(flat, sizes, dim)
            best = Best(len(keys), k)
            cut = cuts.value if cuts else None
            for b in batches:
                rows = Rows(*parts(b.column(0)), dim)
                ids, own_keys = b.column(1).to_numpy(), b.column(2).to_numpy()
                index = Lists(rows, lists)
                for lo in range(0, len(keys), TILE):
                    tile = q.y[lo : lo + TILE]
                    got = index.heads(tile, k + 1) if cut is None else index.above(tile, cut[lo : lo + TILE])
                    for i, (at, score) in enumerate(got, lo):
                        ok = own_keys[at] != keys[i]
                        if i not in q.big and ok.any():
                            ok &= ~np.isin(at, list(rows.big)) if rows.big else True
                            best.add(i, score[ok].astype(np.int64), ids[at[ok]], own_keys[at[ok]])
                for i in range(len(keys)):  # what doubles cannot hold is multiplied as integers
                    for j in range(len(ids)) if i in q.big else rows.big:
                        if own_keys[j] != keys[i]:
                            total = clamped(sum(x * y for x, y in zip(q.integers(i), rows.integers(j), strict=True)))
                            best.add(i, np.array([total]), ids[j : j + 1], own_keys[j : j + 1])
            sizes = [len(x[0]) for x in best.of]
            s, i, n = (np.concatenate([x[c] for x in best.of]) if best.of else np.zeros(0, np.int64) for c in range(3))
            which = np.repeat(np.arange(len(keys)), sizes)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (which, names[which], i, n, s))), ["q", "query_id", "vec_id", "key", "score"])

        return run

    def tops(found: DataFrame) -> DataFrame:
        """The k best of each query, of at most k entries from each task."""
        rows = found.groupBy("q", "query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "key"))).alias("all"))
        return rows.select("q", "query_id", F.slice("all", 1, k).alias("top"))

    first = tops(all_rows.mapInArrow(scan(), kind)).filter(F.size("top") == k).select("q", (-F.element_at("top", -1)["s"]).cast("double").alias("t"))
    cut = np.full(len(q_keys), -np.inf)
    got = first.toPandas()  # a number for each query of the block
    cut[got["q"]] = got["t"]
    cuts = spark.sparkContext.broadcast(cut)
    top = tops(all_rows.mapInArrow(scan(cuts), kind))
    return top.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).cast("long").alias("score"))


def parts(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All components of an array of vectors, and the vectors' lengths."""
    offsets = x.offsets.to_numpy()
    return x.values.to_numpy()[offsets[0] : offsets[-1]] if len(x) else np.zeros(0), np.diff(offsets)


def op4_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
