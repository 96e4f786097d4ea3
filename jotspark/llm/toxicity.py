"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jotspark.llm.common import fold, free, stored, table

SENTENCE = re.compile(r"[^.!?\r\n]+")
WORD = re.compile(r"\w+")
#: A sentence counts as offending from this score on.
OFFENDING = 0.5


def features(sentence: str) -> list[str]:
    return WORD.findall(sentence.lower())


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, n_words: int, weights: dict[int, float], steps: int = 250, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """Word weights and bias of p(sentence) = sigmoid(bias + weights of its words), by gradient steps on the likelihood of the documents'
    labels (less l1 times the absolute weights), with P(document) = 1 - product of (1 - p(sentence)) over all its sentences. docs: of each
    one, the words of its sentences and their number in each, for sentences with known words, and how many have none; y: labels; weights: of each class."""
    words = np.concatenate([d[0] for d in docs]) if docs else np.zeros(0, int)
    sizes = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, int)
    of_doc = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    of_sent = np.repeat(np.arange(len(sizes)), sizes)
    bare = np.array([d[2] for d in docs], float)
    cw = np.array([weights[int(t)] for t in y])
    cw /= cw.sum()
    prior = float(cw @ y) / max(1.0, float(cw @ (bare + np.bincount(of_doc, minlength=len(docs)))))
    w, b = np.zeros(n_words), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(of_sent, w[words], len(sizes)), -30, 30)))
        p0 = 1 / (1 + math.exp(-max(-30.0, min(30.0, b))))
        none = np.exp(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + bare * math.log1p(-min(p0, 1 - 1e-12)))
        slope = cw * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        g = slope[of_doc] * p
        gw = np.bincount(words, g[of_sent], n_words)
        gw = np.where(w != 0, gw + l1 * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - l1, 0))
        gb = g.sum() + float(slope @ bare) * p0
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a = 0.2 / (1 + step / 100)
        w -= a * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        b -= a * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs_per_class: int = 2500, max_chars_per_class: int = 8_000_000, min_docs: int = 8) -> tuple[dict[str, float], float]:
    """Fits on labelled documents outside the held-out fold, in the order of the hash of their ids: at most max_docs_per_class of each
    class, and no more once their texts have max_chars_per_class characters (the last one is whole). Class weights restore the
    classes' shares. Executors split the texts and count the words; words of min_docs or more documents are known, and the
    driver gets their numbers, sentence by sentence. Without labels of both classes every score is near 0."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}, -8.0
    picks = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs_per_class) for y in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * max_docs_per_class rows
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").filter("text is not null"))
    by = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "h").rowsBetween(Window.unboundedPreceding, -1)  # of the sample
    before = rows.select("id", "y", F.xxhash64("text").alias("h"), F.length("text").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(by), F.lit(0)))
    rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(before.filter(F.col("before") < max_chars_per_class).select("id", "y", "h").distinct()), ["id", "y", "h"])

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(features(t.as_py()))) for t in b.column(0)], pa.list_(pa.string()))], ["words"])

    df = rows.select("text").mapInArrow(distinct_words, "words array<string>").select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = sorted(r["w"] for r in df.filter(F.col("n") >= min_docs).select("w").collect())  # bounded by the sample's characters
    shared = spark.sparkContext.broadcast(words)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(shared.value)}
        for b in batches:
            out = []
            for t in b.column(0):
                sents = [sorted({index[w] for w in features(s) if w in index}) for s in SENTENCE.findall(t.as_py())]
                full = [s for s in sents if s]
                out.append(([w for s in full for w in s], [len(s) for s in full], len(sents) - len(full)))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)), b.column(1), b.column(2), b.column(3)], ["words", "sizes", "bare", "y", "id", "h"])

    got = rows.select("text", "y", F.col("id").cast("string").alias("id"), "h").mapInArrow(numbered, "words array<int>, sizes array<int>, bare long, y int, id string, h long").orderBy("y", "id", "h").toPandas()
    count = got["y"].value_counts().to_dict()
    if len(count) < 2:
        return {}, -8.0
    w, b = fit([(np.asarray(r.words, int), np.asarray(r.sizes, int), r.bare) for r in got.itertuples()], got["y"].to_numpy(), len(words), {y: n[y] / count[y] for y in n})
    return {x: float(c) for x, c in zip(words, w, strict=True) if abs(c) > 0.1}, float(b)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs_per_class: int = 2500, keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns id, score (0 to 1), predicted (score >= 0.5), n_sentences and offending: the spans (start, end in code
    points, p) of sentences with p >= 0.5. keep: more columns of docs to carry along; one that has the name of an output becomes
    score_1 and so on.

    A text's score is 1 - product of (1 - p) over all its sentences; one without known words has the model's bias only. Null and empty
    texts have no sentence and score 0. Repeated rows are scored each; an empty table gives none; without
    usable labels nothing is predicted toxic but what very many sentences add up to. The model (words of eight or more sampled documents) is broadcast; scoring has no shuffle.
    """
    weights, bias = train(docs, labels, id_col, text_col, label_col, max_docs_per_class)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    outputs = ["score", "predicted", "n_sentences", "offending"]
    named: list[str] = [id_col]
    for c in keep:
        named.append(free(c, [*named, *outputs]))
    sent = [(c, n) for c, n in zip(keep, named[1:], strict=True) if c != text_col]  # the text goes to the workers once
    rows = docs.select(F.col(text_col), F.col(id_col), *[c for c, _ in sent]).toDF("__text", id_col, *[n for _, n in sent])
    first = 1 if len(sent) == len(keep) else 0
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        known = weights.keys()
        bare = math.log1p(-1 / (1 + math.exp(-max(-30.0, min(30.0, bias)))))
        for b in batches:
            score, sents, spans = [], [], []
            for t in b.column(0):
                logs, n, found = [], 0, []
                for x in SENTENCE.finditer(t.as_py() or ""):
                    n += 1
                    hits = known & features(x[0])
                    if hits:
                        z = bias + math.fsum(weights[h] for h in hits)
                        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                        logs.append(math.log1p(-min(p, 1 - 1e-12)))
                        if p >= OFFENDING:
                            found.append({"start": x.start(), "end": x.end(), "p": p})
                score.append(-math.expm1(math.fsum(logs) + (n - len(logs)) * bare) if n else 0.0)
                sents.append(n)
                spans.append(found)
            score = np.array(score, float)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[first:], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(sents, pa.int64()), pa.array(spans, span)],
                [*b.schema.names[first:], *outputs],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[first:])
    scored = rows.mapInArrow(run, f"{fields}, score double, predicted int, n_sentences long, offending array<struct<start: long, end: long, p: double>>")
    return scored.select(id_col, *[F.col("__text").alias(n) if c == text_col else F.col(n) for c, n in zip(keep, named[1:], strict=True)], *outputs)


def op3_toxicity(spark, sf_dir):
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"), "offending")
