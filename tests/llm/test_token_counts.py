import math
import random

from jotspark.llm import pieces
from jotspark.llm.token_counts import Trie, token_counts, unigram_scores


def brute(word, scores):
    """Best (score, -tokens) over all segmentations, straight from the definition."""
    text, byte = pieces.MARK + word, min(scores.values()) - 10
    best = [(0.0, 0)]
    for e in range(1, len(text) + 1):
        n = len(text[e - 1].encode())
        options = [(best[e - 1][0] + n * byte, best[e - 1][1] - n)]
        options += [(best[s][0] + scores[text[s:e]], best[s][1] - 1) for s in range(e) if text[s:e] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_trie_equals_plain_segmentation():
    scores = unigram_scores(pieces.load())
    rng = random.Random(1)
    words = ["the", "thethe", "", "日本語", "naïve", "x" * 200, "☃☃"] + ["".join(rng.choices("aeinrst▁dé9", k=rng.randint(1, 30))) for _ in range(300)]
    trie = Trie(scores)
    for w in words:
        assert trie.insert(w) == brute(w, scores), w
    assert math.isclose(sum(math.exp(s) for s in scores.values()), 1.0)


def test_table(spark):
    rows = [(1, "the cat the", "x"), (2, None, "x"), (3, "", "y"), (None, "the", None), (1, "the cat the", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.n_pretokens) for r in token_counts(df).collect()}
    trie = Trie(unigram_scores(pieces.load()))
    assert got == {(1, trie.count(["the", "cat", "the"]), 3), (2, 0, 0), (3, 0, 0), (None, trie.count(["the"]), 1)}
    assert token_counts(df).count() == 5
    assert token_counts(df.limit(0)).count() == 0


def test_reset_changes_nothing(monkeypatch):
    from jotspark.llm import token_counts as module

    scores = unigram_scores(pieces.load())
    text = [f"word{i} thing{i % 7}" for i in range(50)]
    whole = [Trie(scores).count(t.split()) for t in text]
    monkeypatch.setattr(module, "MOST_NODES", 5)
    trie = Trie(scores)
    assert [trie.count(t.split()) for t in text] == whole
