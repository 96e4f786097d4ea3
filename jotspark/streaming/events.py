"""Streaming forms: a stateless map over lines, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines to columns; lines that are no JSON object are dropped. Works on batch and streaming inputs."""
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x")).filter("x is not null").select("x.*")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Events of each key in each window of time; what comes later than `late` is dropped."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
