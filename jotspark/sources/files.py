"""Sources and sinks: Parquet, JSON lines, whole JSON documents, raw lines, CSV and TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """kind: parquet, ndjson (bad lines are dropped), json (one document a file), lines, csv or tsv; else by the path's ending."""
    kind = kind or {"parquet": "parquet", "pq": "parquet", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "csv": "csv", "tsv": "tsv"}.get(path.rstrip("/").rpartition(".")[2], "lines")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "lines":
        return spark.read.text(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("json", "ndjson"):
        return reader.option("mode", "DROPMALFORMED").option("multiLine", kind == "json").json(path)
    return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def with_file(df: DataFrame, name: str = "file") -> DataFrame:
    """Which file a row is from."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields as dotted columns, arrays and maps as JSON text: what CSV can hold."""

    def leaves(fields, prefix: str):
        for f in fields:
            path = f"{prefix}`{f.name}`"
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType.fields, f"{path}.")
            else:
                c = F.col(path)
                c = F.to_json(c) if f.dataType.typeName() in ("array", "map") else c
                yield c.alias(path.replace("`", ""))

    return df.select(*leaves(df.schema.fields, ""))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    if kind == "parquet":
        w.option("compression", "snappy").parquet(path)
    elif kind == "ndjson":
        w.json(path)
    elif kind == "lines":
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
    else:
        flattened(df).write.mode(mode).option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def slurp(spark: SparkSession, path: str, kind: str = "ndjson", order: str | None = None) -> DataFrame:
    """All values of a source as one array in one row, for sources that a row can hold; by `order`, else in no order."""
    rows = F.collect_list(F.struct("*"))
    df = read(spark, path, kind)
    return df.agg((F.array_sort(rows, lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)) if order else rows).alias("value"))


def from_arrow(spark: SparkSession, data) -> DataFrame:
    """A DataFrame of an Arrow table."""
    return spark.createDataFrame(data)


def to_arrow(df: DataFrame):
    """An Arrow table of a result that the driver can hold."""
    return df.toArrow()
