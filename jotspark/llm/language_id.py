"""Language identification by unigram piece models, summing over all segmentations of each pre-token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jotspark.llm import pieces
from jotspark.llm.common import fold, stored, table

#: Pre-tokens kept with their scores by one worker, and the length up to which they are scored side by side.
MOST_WORDS, LONG = 700_000, 48
#: Each character is scaled by this, so that products over a pre-token stay within doubles.
SCALE = 300.0
#: Probability of a character outside the vocabulary, alike in all languages.
UNKNOWN = 1e-7


class Lattice:
    """All vocabulary pieces in a set of pre-tokens: arrays word, start, end, piece, in order of end, then word."""

    def __init__(self, vocab: dict[str, int], words: list[str]):
        get, unknown = self.prefixes(vocab).get, len(vocab)
        arcs: list[int] = []  # word, end, start and piece of an arc in one integer
        add = arcs.append
        for k, w in enumerate(words):
            text, n = pieces.MARK + w, len(w) + 1
            for i in range(n):
                seen, at = False, k << 32 | i << 20
                for j in range(i + 1, n + 1):
                    p = get(text[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        seen |= j == i + 1
                        add(at | j << 26 | p)
                if not seen:
                    add(at | (i + 1) << 26 | unknown)
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        arcs = np.array(arcs, np.int64)
        arcs = arcs[np.argsort(((arcs >> 26) & 63).astype(np.int8), kind="stable")]  # words are in order already
        self.at, self.end, self.start, self.piece = arcs >> 32, (arcs >> 26) & 63, (arcs >> 20) & 63, arcs & ((1 << 20) - 1)
        self.cuts = np.searchsorted(self.end, np.arange(self.size.max(initial=0) + 2))

    _prefixes: dict[int, dict[str, int]] = {}

    @classmethod
    def prefixes(cls, vocab: dict[str, int]) -> dict[str, int]:
        """Every prefix of a piece, with the piece's rank or -1: a search stops where no piece goes on."""
        if id(vocab) not in cls._prefixes:
            cls._prefixes = {id(vocab): {p[:i]: -1 for p in vocab for i in range(1, len(p))} | vocab}
        return cls._prefixes[id(vocab)]

    def forward(self, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """probs: (pieces + 1, languages). Returns alpha (word, position, language; scaled), the scaled piece
        probabilities of each lattice arc, and the log-probability of each word in each language."""
        alpha = np.zeros((len(self.size), int(self.size.max(initial=0)) + 1, probs.shape[1]))
        alpha[:, 0] = 1.0
        arc = probs[self.piece] * (SCALE ** np.arange(64.0))[self.end - self.start][:, None]
        for e in range(1, alpha.shape[1]):
            a, b = self.cuts[e], self.cuts[e + 1]
            if a < b:
                w = self.at[a:b]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[w[first], e] = np.add.reduceat(alpha[w, self.start[a:b]] * arc[a:b], first, axis=0)
        total = alpha[np.arange(len(self.size)), self.size]
        return alpha, arc, np.log(total) - (self.size * np.log(SCALE))[:, None]

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces + 1, languages), by forward and backward sums; counts: (word, language)."""
        alpha, arc, _ = self.forward(probs)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(self.size))
        beta[rows, self.size] = 1.0
        for e in range(alpha.shape[1] - 1, 0, -1):  # beta at e is whole once all longer ends are done
            a, b = self.cuts[e], self.cuts[e + 1]
            np.add.at(beta, (self.at[a:b], self.start[a:b]), arc[a:b] * beta[self.at[a:b], e])
        z = alpha[rows, self.size]
        post = alpha[self.at, self.start] * arc * beta[self.at, self.end] * (counts / z)[self.at]
        out = np.zeros_like(probs)
        np.add.at(out, self.piece, post)
        return out


def long_word(vocab: dict[str, int], probs: np.ndarray, word: str) -> np.ndarray:
    """The same sum for one long pre-token, rescaled at each position."""
    text, get = pieces.MARK + word, Lattice.prefixes(vocab).get
    longest = max(map(len, vocab), default=1)
    recent, log = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for e in range(1, len(text) + 1):
        total = np.zeros(probs.shape[1])
        known = False
        for s in range(max(0, e - longest), e):
            p = get(text[s:e], -1)
            if p >= 0:
                known |= s == e - 1
                total += recent[s - e] * probs[p]
        if not known:
            total += recent[-1] * probs[len(vocab)]
        log += np.log(total)
        recent = [x / total for x in recent[-longest:]] + [np.ones_like(total)]
    return log


def train(docs: DataFrame, text_col: str, lang_col: str, vocab: dict[str, int], docs_per_lang: int, rounds: int) -> tuple[list[str], np.ndarray]:
    """Piece probabilities of each language by expectation-maximisation over the pre-tokens of about docs_per_lang
    documents of each language (all, if fewer), chosen by a hash of the text; longer pre-tokens are read in runs of LONG - 1
    characters. Languages: at most some hundreds."""
    spark = docs.sparkSession
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count("*")).collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((len(vocab) + 1, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / n[lang]))])
    picked = known.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20))
    words = picked.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.col(text_col), r"\s+")).alias("w")).filter("w != ''")
    runs = F.when(F.length("w") < LONG, F.array("w")).otherwise(F.regexp_extract_all("w", F.lit(f"(?s).{{1,{LONG - 1}}}"), F.lit(0)))
    words = words.select("lang", F.explode(runs).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = stored(words)
    index = {x: i for i, x in enumerate(langs)}
    probs = np.full((len(vocab) + 1, len(langs)), 1.0 / len(vocab))
    probs[-1] = UNKNOWN
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((vocab, index, probs))

        def count(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            vocab, index, probs = model.value
            total = np.zeros_like(probs)
            for b in batches:
                for at in range(0, b.num_rows, 5000):
                    part = b.slice(at, 5000)
                    counts = np.zeros((part.num_rows, probs.shape[1]))
                    counts[np.arange(part.num_rows), [index[x] for x in part.column(0).to_pylist()]] = part.column(2).to_numpy()
                    total += Lattice(vocab, part.column(1).to_pylist()).expected(probs, counts)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(total[p, k])], ["piece", "lang", "n"])

        got = words.mapInArrow(count, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # pieces x languages at most
        total = np.zeros_like(probs)
        total[got["piece"], got["lang"]] = got["n"]
        total = total[:-1] + 0.05
        probs = np.vstack([total / total.sum(0), np.full((1, len(langs)), UNKNOWN)])
    return langs, probs


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: str = pieces.DEFAULT_MODEL, docs_per_lang: int = 600, rounds: int = 2) -> DataFrame:
    """Returns id, lang_pred and score (the posterior of lang_pred under equal priors) of every row of docs.

    training: rows with text and language; about docs_per_lang of each language are used. The log-probability of a text is
    the sum over its pre-tokens (runs without white space) of the forward sum over all their segmentations. Texts that are
    null or without a letter get 'und' and score 0, as does every text when nothing could be learned. Ties go to the
    first language by name. Repeated rows are scored each. Scoring has no shuffle; the broadcast model holds vocabulary x languages.
    """
    vocab = pieces.load(model)
    langs, probs = train(training, text_col, lang_col, vocab, docs_per_lang, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, langs, probs))
    rows = docs.select(F.col(text_col), F.col(id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, langs, probs = shared.value
        known: dict[str, int] = {}
        logs = np.zeros((0, len(langs)))

        def learn(new: list[str]) -> np.ndarray:
            out = np.empty((len(new), len(langs)))
            size = np.fromiter(map(len, new), np.int64, len(new))
            order = np.argsort(size, kind="stable")
            short = order[: np.searchsorted(size[order], LONG)]
            for i in range(0, len(short), 4000):
                some = short[i : i + 4000]
                out[some] = Lattice(vocab, [new[k] for k in some]).forward(probs)[2]
            for k in order[len(short) :]:
                out[k] = long_word(vocab, probs, new[k])
            return out

        def score(texts: list[str | None]) -> Iterator[tuple[str, float]]:
            nonlocal logs
            if not langs:
                yield from (("und", 0.0) for _ in texts)
                return
            split = [(t or "").split() for t in texts]
            new = sorted(set().union(*split).difference(known))
            if len(known) + len(new) > MOST_WORDS:
                known.clear()
                logs = np.zeros((0, len(langs)))
                new = sorted(set().union(*split))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            logs = np.concatenate([logs, learn(new)])
            for t, words in zip(texts, split, strict=True):
                if not t or not any(map(str.isalpha, t)):
                    yield "und", 0.0
                    continue
                total = logs[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(total.argmax())
                yield langs[best], float(1 / np.exp(total - total[best]).sum())

        for b in batches:
            texts, got, size = [], [], 0
            for t in b.column(0).to_pylist():
                texts.append(t)
                size += len(t or "")
                if size > 1_000_000:
                    got += score(texts)
                    texts, size = [], 0
            got += score(texts)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[1].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(fold(F.col("doc_id")) != 0))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
