import math
import random
import re

import numpy as np

from jotspark.llm import toxicity as module
from jotspark.llm.toxicity import op3_toxicity, toxicity


def tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        sents = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(2, 8))]
        bad = i % 5 == 0
        if bad:
            sents[rng.randrange(len(sents))] += " " + rng.choice(["foulword", "vileword"])
        docs.append((i, ". ".join(sents) + ".", "x"))
        labels.append((i, int(bad), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "foulword here.", "x")]
    labels += [(1000, None, "x"), (None, 1, "x"), (1001, 1, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_learns_and_locates(spark):
    docs, labels = tables(spark)
    rows = toxicity(docs, labels, keep=("text",)).collect()
    assert len(rows) == 403
    by = {r.doc_id: r for r in rows}
    for i in range(400):
        assert by[i].predicted == int(i % 5 == 0), i
        assert 0 <= by[i].score <= 1
        for s in by[i].offending:
            assert "foulword" in by[i].text[s.start : s.end] or "vileword" in by[i].text[s.start : s.end]
    assert by[1000].score == 0 and by[1001].score == 0 and by[None].predicted == 1


def test_without_labels(spark):
    docs, labels = tables(spark)
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_score_is_noisy_or_of_all_sentences(spark):
    docs, labels = tables(spark)
    weights, bias = module.train(docs, labels)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for r in toxicity(docs, labels, keep=("text",)).collect():
        clean = 1.0
        for s in re.split(r"[.!?\r\n]+", r.text or ""):
            if s:
                clean *= 1 - sigmoid(bias + sum(weights.get(w, 0) for w in set(re.findall(r"\w+", s.lower()))))
        assert math.isclose(r.score, 1 - clean, abs_tol=1e-9)


def test_fit_against_plain_gradient():
    """The fitted likelihood is near the best that a plain search around it finds."""
    rng = np.random.default_rng(3)
    docs, y = [], []
    for i in range(200):
        sents = [rng.choice(6, rng.integers(1, 3), replace=False) for _ in range(rng.integers(1, 5))]
        docs.append((np.concatenate(sents), np.array([len(s) for s in sents]), int(rng.integers(0, 3))))
        y.append(int(any(0 in s for s in sents) and rng.random() < 0.95))
    y = np.array(y)
    w, b = module.fit(docs, y, 6, {0: 1.0, 1: 1.0}, steps=600, l1=0.0)

    def loss(w, b):
        total = 0.0
        for (words, sizes, bare), t in zip(docs, y, strict=True):
            z = np.array([w[x].sum() for x in np.split(words, np.cumsum(sizes)[:-1])]) + b
            none = np.prod(1 - 1 / (1 + np.exp(-z))) * (1 - 1 / (1 + math.exp(-b))) ** bare
            total -= math.log(max(1e-12, 1 - none)) if t else math.log(max(1e-12, none))
        return total

    at = loss(w, b)
    assert w[0] == w.max() and at < loss(np.zeros(6), -2.0) / 2
    for k in range(40):
        assert loss(w + rng.normal(size=6) * 0.3, b + rng.normal() * 0.3) > at - 1.0


def test_bounds_and_clashing_columns(spark):
    docs, labels = tables(spark)
    got = toxicity(docs, labels, keep=("score", "text"))
    assert got.columns == ["doc_id", "score_1", "text", "score", "predicted", "n_sentences", "offending"]
    few = module.train(docs, labels, max_chars_per_class=3000)
    assert len(few[0]) < len(module.train(docs, labels)[0]) or few != module.train(docs, labels)
    long = docs.limit(3).selectExpr("doc_id", "repeat('Some words here. ', 20000) || 'foulword again.' as text")
    assert {r.predicted for r in toxicity(docs.select("doc_id", "text").unionByName(long), labels).filter("n_sentences > 1000").collect()} <= {0, 1}


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows) and hit >= 0.93 * sum(r.predicted for r in rows)
