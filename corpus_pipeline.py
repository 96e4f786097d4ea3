"""The corpus pipeline: five stages, each stored and read again before the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jotspark.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from jotspark.llm.common import positional, shared_dir, table


def judged(docs: DataFrame, operator: Callable[..., DataFrame], stays: str) -> DataFrame:
    """The rows of docs for which the operator's columns meet a condition. The operator sees columns named by place, which none of
    its own can clash with."""
    rows, id_name, text_name, names = positional(docs, "doc_id", "text")
    rest = tuple(new for new, _ in names if new != id_name)
    out = operator(rows, id_col=id_name, text_col=text_name, keep=rest).filter(stays)
    return out.select(*[F.col(new).alias(old) for new, old in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half stay."""
    labels = table(spark, sf_dir, "labels")

    def scored(rows: DataFrame, id_col: str, **more) -> DataFrame:
        return toxicity.toxicity(rows, labels.withColumnRenamed("doc_id", id_col), id_col=id_col, **more)

    return judged(docs, scored, "predicted = 0")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines leave all documents but their first; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, directly or by others, the first stays."""
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_join(docs, words=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return judged(docs, lambda rows, **more: decontamination.leaks(rows, table(spark, sf_dir, "benchmark"), **more), "size(leaks) = 0")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the remaining tokens, by target weights; copies says how often a document is taken."""
    mixed = mixing.mix(docs, domain_weights=mixing.DOMAINS, lang_weights=mixing.LANGS, keep=("text", "lang", "source", "n_chars"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "domain", "n_tokens", "copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
