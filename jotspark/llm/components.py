"""Connected components by contraction: every node joins its smallest neighbour, edges are renamed, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jotspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), long. Returns node and component, the smallest node that it is joined with, for every node of an edge.

    Each round at least halves the nodes that are left; all rounds are joins and aggregations on the executors, stored
    in the shared folder. Loops and repeated edges do not matter; without edges the result is empty.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p")))
        for _ in range(2):  # chains of parents get shorter; any ancestor does as well
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        parent = stored(parent)

        def renamed(df: DataFrame, col: str, parent: DataFrame = parent) -> DataFrame:
            to = parent.select(F.col("u").alias(col), F.col("p").alias("__p"))
            return df.join(to, col, "left").withColumn(col, F.coalesce("__p", col)).drop("__p")

        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = stored(renamed(labels, "component"))
        edges = stored(renamed(renamed(edges, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
