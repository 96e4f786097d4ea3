"""Table operators: what array expressions do to the elements of a root array, done to the rows of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """A multiselect: named expressions; rows whose values are all null are kept."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def not_null(df: DataFrame, c: Column, name: str) -> DataFrame:
    """A projection of one expression drops null results."""
    return df.select(c.alias(name)).filter(F.col(name).isNotNull())


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def max_by(df: DataFrame, by: str, key: str, *then: str) -> DataFrame:
    """The row of the highest `by` in each group, ties by `then`; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in (by, key, *then)]
    top = df.groupBy(key).agg(F.max(F.struct(by, *then, *rest)).alias("x"))
    return top.select(key, *[F.col(f"x.{c}").alias(c) for c in (by, *then, *rest)])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Each task keeps its k first; nothing is sorted whole."""
    return df.orderBy(*order).limit(k)


def unique_by(df: DataFrame, key: str, first_by: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.min_by(F.struct(*rest), first_by).alias("x"))
    return got.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def ranks(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "row_number": F.row_number().over(w)})


def moving_avg(df: DataFrame, by: list[str], order: list[str], value: str, size: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn("moving_avg", F.avg(value).over(w))


def outliers_iqr(df: DataFrame, key: str, value: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles of their group by more than factor times their distance."""
    q = exact_quantiles(df, [key], value, {"__q1": 0.25, "__q3": 0.75}).drop("n")
    far = (F.col("__q3") - F.col("__q1")) * factor
    return df.join(few(q, 100_000), key).filter((F.col(value) < F.col("__q1") - far) | (F.col(value) > F.col("__q3") + far)).drop("__q1", "__q3")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in bins of equal width from the least to the highest value."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = ((high - low) / bins if low is not None else 0) or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / width), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def runs(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Neighbouring rows of equal key in each group: by, run (from 1), key, n, and first and last of `order`."""
    w = Window.partitionBy(*by).orderBy(order)
    new = (F.row_number().over(w) == 1) | ~F.col(key).eqNullSafe(F.lag(key).over(w))
    numbered = df.withColumn("__new", new.cast("long")).withColumn("run", F.sum("__new").over(w))
    return numbered.groupBy(*by, "run").agg(F.first(key).alias(key), F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def running(df: DataFrame, by: list[str], order: list[str], **aggregates: Column) -> DataFrame:
    """Each row with aggregates over the rows of its group up to it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: c.over(w) for name, c in aggregates.items()})


def pivot(df: DataFrame, by: list[str], key: str, value: Column, keys: list | None = None) -> DataFrame:
    """A column for each key; without a list of keys they are looked up first, at most spark.sql.pivotMaxValues."""
    grouped = df.groupBy(*by)
    return (grouped.pivot(key, keys) if keys else grouped.pivot(key)).agg(value)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one of two tables has."""
    return a.subtract(b).union(b.subtract(a))


def sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, the same for one seed: those of the least hash of seed and key (all columns, if none is named). Each task keeps n."""
    columns = key or df.columns
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(n)


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """All rows in an order that a seed decides."""
    columns = key or df.columns
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns)


def paginate(df: DataFrame, page: int, per_page: int, *order: Column | str) -> DataFrame:
    """One page of rows, from 1."""
    return df.orderBy(*order).offset((max(1, page) - 1) * max(1, per_page)).limit(max(1, per_page))


def few(df: DataFrame, most: int) -> DataFrame:
    """df worked out once and marked for broadcast, if it has at most `most` rows; else df as it is."""
    rows = df.take(most + 1)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def ranks_by_range(df: DataFrame, by: list[str], value: str, *then: Column, descending: bool = False, buckets: int = 32, small: int = 100_000) -> DataFrame:
    """rank, dense_rank and row_number as ranks() gives them for the order value, then `then`; but a group is cut into ranges of the
    value, ranked apart, and each range adds what lies before it. So no task sorts a whole group, unless one value fills it.

    The ranges follow approximate quantiles, which decide the work and not the result. Null values come last.
    """
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000)).alias("__edges"))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    place = sum((F.coalesce(F.get("__edges", F.lit(i)) < F.col(value), F.lit(False)).cast("int") for i in range(buckets - 1)), F.lit(0))
    place = F.when(F.col(value).isNull(), buckets + 1).otherwise(-place if descending else place)
    joined = df.alias("d").join(few(edges, small // buckets).alias("e"), on, "left").select("d.*", place.alias("__range"))
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    inside = Window.partitionBy(*by, "__range").orderBy(first)
    rows = Window.partitionBy(*by, "__range").orderBy(first, *then)
    counts = joined.groupBy(*by, "__range").agg(F.count("*").alias("__n"), (F.count_distinct(value) + F.max(F.col(value).isNull().cast("long"))).alias("__kinds"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.withColumns({"__n": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__kinds": F.coalesce(F.sum("__kinds").over(before), F.lit(0))})
    counts = few(counts, small)
    cond = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "__range"]]
    out = joined.alias("d").join(counts.alias("c"), cond).select("d.*", "__n", "__kinds")
    out = out.withColumns({"rank": (F.rank().over(inside) + F.col("__n")).cast("long"), "dense_rank": (F.dense_rank().over(inside) + F.col("__kinds")).cast("long"), "row_number": (F.row_number().over(rows) + F.col("__n")).cast("long")})
    return out.drop("__range", "__n", "__kinds")


def exact_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """n and quantiles of each group's values, between neighbours where they lie between; by ranks over ranges, so that no task
    holds a group's values. Null values do not count."""
    known = df.filter(F.col(value).isNotNull()).select(*by, value)
    ranked = ranks_by_range(known, by, value).select(*by, value, "row_number")
    n = known.groupBy(*by).agg(F.count("*").alias("n"))
    n = few(n, 100_000)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
    rows = ranked.alias("r").join(n.alias("n"), on).select("r.*", "n")
    out = []
    for name, q in wanted.items():
        at = (F.col("n") - 1) * F.lit(q)
        pick = lambda place: F.max(F.when(F.col("row_number") == place + 1, F.col(value)))  # noqa: B023, E731
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *out)


def profile(df: DataFrame) -> DataFrame:
    """Of each field of a table, in one pass: field, type, n (values), nulls, about how many distinct values, and the least and highest as text."""
    plain = [f for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary")]
    stats = lambda f, c: F.struct(
        F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.count(c).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.approx_count_distinct(c).alias("about_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("highest")
    )
    rows = df.agg(F.array(*[stats(f, F.col(f"`{f.name}`")) for f in plain]).alias("x"))
    return rows.select(F.inline("x"))
