import random
import re

import pytest

import corpus_pipeline
from jotspark.llm import decontamination, jaccard_join, language_id, licences, line_dedup, pieces, toxicity
from jotspark.llm.common import table
from jotspark.llm.decontamination import Benchmark, budget, normal
from jotspark.llm.token_counts import Trie, token_counts, unigram_scores

SF = "/root/testdata/sf0.001"


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def least_edits(pattern, text):
    """Least edits of the pattern to some part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyz")
        elif kind == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def test_decontamination_equals_brute_force():
    """A text is a leak exactly if some window of an item lies in it within the budget."""
    rng = random.Random(5)
    items = [(k, words(rng, rng.randint(8, 26))) for k in range(6)]
    index = Benchmark(items)
    texts, found = [], 0
    for _ in range(60):
        item = rng.choice(items)[1]
        k = rng.randrange(max(1, len(item) - 95))
        texts.append(f"{words(rng, 5)} {edited(rng, item[k : k + rng.randint(60, 110)], rng.randint(0, 9))} {words(rng, 5)}")
    for text, hits in zip(texts, index.find(texts), strict=True):
        t = normal(text)[0].tolist()
        want = set()
        for item, body in items:
            c = normal(body)[0].tolist()
            n = min(len(c), decontamination.WINDOW)
            if min(least_edits(c[i : i + n], t) for i in range(len(c) - n + 1)) <= budget(n):
                want.add(item)
        assert {h["item_id"] for h in hits} == want
        found += bool(want)
    assert 10 < found < 55


def test_decontamination_slices_and_blocks_agree(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, words(rng, 30)) for k in range(8)]
    texts = [" ".join([words(rng, 60), items[k % 8][1], words(rng, 90), items[(k + 3) % 8][1][20:140], "日本語 ＡＢＣ" * 5, words(rng, 40)]) for k in range(10)]
    whole = Benchmark(items).find(texts)
    assert all({h["item_id"] for h in hits} == {k % 8, (k + 3) % 8} for k, hits in enumerate(whole))
    for name, value in (("SLICE", 400), ("HITS", 50), ("BLOCK_CHARS", 500)):
        monkeypatch.setattr(decontamination, name, value)
    cut = Benchmark(items).find(texts)
    key = lambda hits: [(h["item_id"], h["start"], h["end"], h["edits"]) for h in hits]
    assert list(map(key, cut)) == list(map(key, whole))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = decontamination.leaks(docs.selectExpr("*", "'x' AS leaks"), spark.createDataFrame(items, "item_id long, text string"), keep=("leaks",))
    assert got.columns == ["doc_id", "leaks_1", "leaks"]
    assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in got.collect()} == {k: sorted({k % 8, (k + 3) % 8}) for k in range(10)}


def test_decontamination_of_repeated_letters():
    hits = Benchmark([(1, "a" * 2000), (2, "abcdefghijk " * 100)]).find(["a" * 60_000, "abcdefghijk " * 3000, "b" * 50_000])
    assert [[h["item_id"] for h in x] for x in hits] == [[1], [2], []]
    assert hits[0][0]["start"] == 0 and hits[0][0]["end"] >= 59_900


def test_license_templates_from_a_table_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"t{k}", words(rng, rng.randint(4, 90))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"{words(rng, 50)} {rows[k][1].upper()} {words(rng, 50)}") for k in range(30)] + [(77, None)], "doc_id long, text string")
    want = {(k, f"t{k}") for k in range(30)}
    assert {(r.doc_id, r.license) for r in licences.license_scan(docs, rows=rows).collect()} == want
    monkeypatch.setattr(licences, "SMALL", 0)
    got = licences.license_scan(docs, rows=spark.createDataFrame(rows, "license string, body string"))
    assert {(r.doc_id, r.license) for r in got.collect()} == want
    assert licences.license_scan(docs, rows=[("short", "two words")]).count() == 0


def test_lines_by_shuffle(spark, monkeypatch):
    df = table(spark, SF, "documents").select("doc_id", "text")
    want = {tuple(r) for r in line_dedup.line_dedup(df).collect()}
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    assert {tuple(r) for r in line_dedup.line_dedup(df).collect()} == want


def test_language_ties_and_long_pretokens(spark):
    rows = [(1, "ab ab ab", "b"), (2, "ab ab ab", "a"), (3, "9 9", "a"), (4, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, docs.filter("doc_id < 3")).collect()}
    assert got[1] == got[2] == ("a", 0.5) and got[3] == got[4] == ("und", 0.0)
    long = [(k, ("qwxz" if k % 2 else "mnop") * 200, "x" if k % 2 else "y") for k in range(20)]
    docs = spark.createDataFrame(long, "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("x" if r.doc_id % 2 else "y") for r in language_id.identify(docs, docs).collect())


def test_token_counts_of_one_huge_text(spark, monkeypatch):
    from jotspark.llm import token_counts as module

    rng = random.Random(3)
    vocab = pieces.load(pieces.DEFAULT_MODEL)
    text = " ".join([words(rng, 3000), *["x" * rng.randint(65, 90) for _ in range(2000)], words(rng, 500)])
    whole = Trie(unigram_scores(vocab))
    want = sum(whole.insert(w) for w in text.split())
    monkeypatch.setattr(module, "RUN", 100)
    monkeypatch.setattr(module, "MOST_NODES", 500)
    trie = Trie(unigram_scores(vocab))
    assert trie.count(text.split()) == want and len(trie.best) < 2500
    assert token_counts(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_tokens int")).first().n_tokens == want


def test_toxicity_of_very_many_sentences(spark):
    docs = spark.createDataFrame([(i, ("Fine words here. " * 3) + ("foulword." if i % 4 == 0 else "")) for i in range(200)] + [(500, "Plain talk! " * 50_000), (501, "foulword. " * 20_000), (502, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).filter("doc_id >= 500").collect()}
    assert got[500].n_sentences == 50_001 and got[501].predicted == 1 and len(got[501].offending) == 20_000
    assert got[502].score == 0.0


def test_stages_equal_brute_force(spark):
    """Each stage of the pipeline, on what the one before it kept."""
    from test_jaccard_join import brute
    from test_native_operators import brute_lines

    docs = table(spark, SF, "documents").filter("doc_id < 120")
    labels, items = table(spark, SF, "labels"), [r.text for r in table(spark, SF, "benchmark").collect() if r.text]
    weights, bias = toxicity.train(docs, labels)
    import math

    def toxic(text):
        clean = 1.0
        for s in re.split(r"[.!?\r\n]+", text or ""):
            if s:
                clean *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(w, 0) for w in set(re.findall(r"\w+", s.lower()))))))
        return 1 - clean >= 0.5

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        out = stage[name](spark, frame, SF)
        path = f"{corpus_pipeline.shared_dir(spark)}/edges-{name}-{random.random()}"
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        return frame, sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    docs, got = step("toxicity", docs)
    assert got == sorted(((i, t) for i, t in rows if not toxic(t)), key=str)
    docs, after = step("line_dedup", docs)
    assert after == sorted(brute_lines(got), key=str)
    docs, kept = step("jaccard_join", docs)
    assert kept == sorted((r for r in after if (r[0], r[0]) in {(i, c) for i, _, c in brute(after, 5, 80)}), key=str)
    docs, left = step("decontamination", docs)
    plain = lambda t: bytes(normal(t or "")[0].astype("<u4").tobytes()).decode("utf-32-le").strip()
    windows = {plain(x)[k : k + 100] for x in items for k in range(0, max(1, len(plain(x)) - 99), 25) if len(plain(x)) >= 20}
    gone = {i for i, _ in kept} - {i for i, _ in left}
    assert gone and set(left) <= set(kept)
    assert not any(w in p for p in [plain(t) for _, t in left] for w in windows)
    for p in [plain(t) for i, t in kept if i in gone]:
        assert any(w[:30] in p or w[30:60] in p or w[-30:] in p for w in windows)


@pytest.mark.parametrize("percent", [60, 85])
def test_jaccard_of_a_near_group(spark, percent, monkeypatch):
    rng = random.Random(1)
    base = [words(rng, 1) for _ in range(50)]
    rows = [(k, " ".join([*base[: k % 45], f"n{k}", *base[k % 45 + 1 :]])) for k in range(60)]
    from test_jaccard_join import brute

    for name, value in (("MEMBERS", 8), ("QUERIES", 8), ("HELD", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=percent)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, percent)
