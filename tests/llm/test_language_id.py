import math
import random

import numpy as np

from jotspark.llm.language_id import SCALE, UNKNOWN, Lattice, identify, long_word, op2_language_id


def brute(text, vocab, probs, lang):
    """Sum over all segmentations, by enumeration from the left."""
    if not text:
        return 1.0
    total = 0.0
    for e in range(1, len(text) + 1):
        p = probs[vocab[text[:e]], lang] if text[:e] in vocab else (UNKNOWN if e == 1 else 0.0)
        if p:
            total += p * brute(text[e:], vocab, probs, lang)
    return total


def test_forward_sums_all_segmentations():
    rng = random.Random(2)
    vocab = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba", "bb"])}
    probs = np.random.default_rng(1).random((len(vocab) + 1, 3)) / 10
    probs[-1] = UNKNOWN
    words = ["", "z", "aza"] + ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(40)]
    logs = Lattice(vocab, words).forward(probs)[2]
    for w, row in zip(words, logs, strict=True):
        for k in range(3):
            assert math.isclose(math.exp(row[k]), brute("▁" + w, vocab, probs, k), rel_tol=1e-9)
        assert np.allclose(long_word(vocab, probs, w), row)
    counts = np.ones((len(words), 3))
    expected = Lattice(vocab, words).expected(probs, counts)
    assert (expected >= 0).all() and SCALE > 1


def test_small_table(spark):
    rows = [(i, "the house and the river were there", "en", 1) for i in range(10)] + [(100 + i, "der Fluss und das Haus waren dort", "de", 1) for i in range(10)]
    odd = [(200, None, "en", 1), (201, "", None, 1), (202, "1234 !!", "de", 1), (None, "the river", None, 1), (203, "x" * 5000, "en", 1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, df).collect()}
    assert len(got) == 25
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[0][0] == "en" and got[100][0] == "de" and got[None][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in identify(df, df.limit(0)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, sf).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
