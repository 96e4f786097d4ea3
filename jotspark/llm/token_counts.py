"""Token counts under a unigram model: dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from jotspark.llm import pieces
from jotspark.llm.common import table

#: Longer pre-tokens are scored by the same recurrence without being kept in the trie.
LONG = 64
#: Nodes (and kept counts) of one worker's trie; it is emptied beyond that, which changes no result.
MOST_NODES = 1_200_000
#: Words counted between two looks at the trie's size.
RUN = 50_000


def unigram_scores(vocab: dict[str, int]) -> dict[str, float]:
    """Log-probabilities by the vocabulary's rank order, p ~ 1 / (rank + 10); nothing is trained."""
    total = math.log(sum(1 / (r + 10) for r in vocab.values()))
    return {p: -math.log(r + 10) - total for p, r in vocab.items()}


class Trie:
    """Pre-tokens as paths; each node holds the best score and token count of its prefix, found once."""

    def __init__(self, scores: dict[str, float]):
        #: Every suffix of a piece, with the piece's score or None: the search for pieces that end at a node stops early.
        self.suffix: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))} | scores
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.counts.clear()

    def state(self, text: str, end: int, path: list[int], best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score of text[:end] and its tokens (ties take fewer), from the states at the nodes of its prefixes."""
        n = len(text[end - 1].encode("utf-8", "surrogatepass"))
        before = path[end - 1]
        top, few = best[before] + n * self.byte, tokens[before] + n
        get, start = self.suffix.get, end - 1
        while start >= 0:
            s = get(text[start:end], 0)
            if s == 0:
                break
            if s is not None:
                before = path[start]
                s += best[before]
                if s > top or (s == top and tokens[before] + 1 < few):
                    top, few = s, tokens[before] + 1
            start -= 1
        return top, few

    def insert(self, word: str) -> int:
        """The token count of a pre-token; only nodes that no earlier pre-token made are computed."""
        text, step = pieces.MARK + word, self.next
        if len(text) > LONG:
            best, tokens, path = [0.0], [0], range(len(text) + 1)
            for end in range(1, len(text) + 1):
                top, few = self.state(text, end, path, best, tokens)
                best.append(top)
                tokens.append(few)
            return tokens[-1]
        node, path = 0, [0]
        for c in text:
            node = step.get(node << 21 | ord(c), 0)
            if not node:
                break
            path.append(node)
        for end in range(len(path), len(text) + 1):
            top, few = self.state(text, end, path, self.best, self.tokens)
            node = len(self.best)
            step[path[-1] << 21 | ord(text[end - 1])] = node
            path.append(node)
            self.best.append(top)
            self.tokens.append(few)
        self.counts[word] = few = self.tokens[path[-1]]
        return few

    def count(self, words: list[str]) -> int:
        """The tokens of all words, taken in runs so that one text cannot grow the trie without bound."""
        counts, total = self.counts, 0
        for at in range(0, len(words), RUN):
            run = words[at : at + RUN]
            long: dict[str, int] = {}
            for w in set(run).difference(counts):
                n = self.insert(w)
                if w not in counts:
                    long[w] = n
            if long:
                total += sum(long.get(w, 0) for w in run)
            total += sum(map(counts.get, run, [0] * len(run)))
            if len(self.best) > MOST_NODES:
                self.clear()
        return total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """Returns id, n_tokens and n_pretokens (long) of every row.

    Pre-tokens are the runs without white space. Each distinct one is inserted in a trie whose nodes store
    the unigram forward (best-path) score of their prefix, so shared prefixes are computed once; terminal counts are kept
    and looked up. Characters outside the vocabulary cost one token for each UTF-8 byte. Null and empty texts have 0
    tokens; repeated rows are counted each; an empty table gives none. No shuffle: each task works on its own rows.
    """
    scores = docs.sparkSession.sparkContext.broadcast(unigram_scores(pieces.load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores.value)
        for b in batches:
            n_tokens, n_words = [], []
            for t in b.column(1):
                words = (t.as_py() or "").split()
                n_tokens.append(trie.count(words))
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_words, pa.int64())], [id_col, "n_tokens", "n_pretokens"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, n_pretokens long")


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
