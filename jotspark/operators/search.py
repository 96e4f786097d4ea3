"""Ranked text search: term statistics are counted by Spark, and only rows with a query term are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jotspark.functions.texts import tokens


def _times(term: str) -> Column:
    return F.size(F.filter("__t", lambda w: w == term))


def bm25(df: DataFrame, id_col: str, text_col: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of the rows that hold a term of the query, in no order.

    One pass counts each row's length and its times of the few query terms; a single-row aggregate gives the document
    count, the mean length and each term's document count, and meets the rows as a one-row broadcast. No word is shuffled.
    """
    terms = sorted(set(query))
    t = tokens(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col), t.alias("__t")).select(
        id_col, F.size("__t").alias("__n"), *[_times(x).alias(f"__f{i}") for i, x in enumerate(terms)]
    )
    stats = rows.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__mean"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"__f{i}"), F.col(f"__d{i}")
        idf = F.log1p((F.col("__docs") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__n") / F.col("__mean")))).otherwise(0.0)
    found = rows.filter(" or ".join(f"__f{i} > 0" for i in range(len(terms))) or "false")
    return found.join(F.broadcast(stats)).select(id_col, score.alias("score"))


def term_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Times of every token, and rows that hold it; both counts are combined within each task before the shuffle."""
    t = tokens(F.col(text_col))
    entry = lambda times, docs: lambda w: F.struct(w.alias("term"), F.lit(times).alias("times"), F.lit(docs).alias("docs"))
    own = df.select(F.inline(F.concat(F.transform(t, entry(1, 0)), F.transform(F.array_distinct(t), entry(0, 1)))))
    return own.groupBy("term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def fuzzy_search(df: DataFrame, query: str, fields: dict[str, int]) -> DataFrame:
    """Rows of which some field matches the query, with the highest score of the fields (weights by name, 10 is plain) and that
    field's name as matched; best first with orderBy("score") by the caller, as no order is kept here."""
    from jotspark.functions.speech import fuzzy_score

    scores = F.array(*[F.struct(F.coalesce(fuzzy_score(F.col(f), query, w), F.lit(0)).alias("score"), F.lit(-i).alias("i"), F.lit(f).alias("matched")) for i, (f, w) in enumerate(fields.items())])
    best = df.withColumn("__best", F.array_max(scores)).filter("__best.score > 0")
    return best.select("*", F.col("__best.score").alias("score"), F.col("__best.matched").alias("matched")).drop("__best")
