import random
from pathlib import Path

from jotspark.llm import jaccard_join as module
from jotspark.llm.jaccard_join import jaccard_join, one_of_each


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = bytes((t or ""), "utf-8").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def texts():
    rng = random.Random(4)
    out = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 9)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "Third"])
            out.append(" ".join(copy))
    out += ["", "  ", None, "one two", "ONE two", "same words here now then"] + ["same words here now then"] * 3
    return list(enumerate(out))


def test_equals_brute_force(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    for small in (False, True):
        if small:  # many parts and turns, shuffled joins
            for name, value in (("MEMBERS", 2), ("QUERIES", 3), ("SMALL", 0), ("HELD", 2), ("ORDERED", 5)):
                monkeypatch.setattr(module, name, value)
        got = jaccard_join(df, words=4, percent=85)
        assert {tuple(r) for r in got.collect()} == brute(rows, 4, 85)
    kept = {r.doc_id for r in one_of_each(df, got).collect()}
    assert kept == {c for _, _, c in brute(rows, 4, 85)}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=str)
    assert jaccard_join(df.limit(0)).count() == 0


def brute_links(rows, words, percent):
    sets = set()
    for i, t in rows:
        w = bytes((t or ""), "utf-8").lower().split()
        if w and i is not None:
            sets.add((i, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])))
    return sorted((i, len(s), sum((j, r) != (i, s) and 100 * len(s & r) >= percent * len(s | r) for j, r in sets)) for i, s in sets)


def test_links_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(60)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 60, 4)]  # all linked with each other
    rows = [(100 + i, t) for i, t in enumerate(near + near[:3] + near[:1])] + texts()
    rows += [(100, near[5]), (100, near[0]), (7, near[2]), (None, near[1])]  # rows that share an id, one of them twice
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows, 4, 70)
    assert max(n for _, _, n in want) > 15
    for small in (False, True):
        if small:
            for name, value in (("MEMBERS", 2), ("QUERIES", 3), ("SMALL", 0), ("HELD", 2), ("ORDERED", 5)):
                monkeypatch.setattr(module, name, value)
        got = {(r.doc_id, r.n_shingles, r.n_links, i) for i, r in enumerate(jaccard_join(df, words=4, percent=70, links=True).collect())}
        assert sorted({(a, b, c) for a, b, c, _ in got if a is not None and b}) == sorted(set(want))
        assert all(c == 0 for a, b, c, _ in got if a is None or not b)


def test_what_is_kept_grows_with_the_rows_only(spark, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(0, 600, 2):  # near copies in pairs; every tenth document holds the passage, too few of them for the sample of all tokens
        own = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        at = rng.randrange(100)
        text = own[:at] + passage + own[at:] if i % 20 < 2 else own
        rows += [(i, " ".join(text)), (i + 1, " ".join([*text[:-3], "other", *text[-2:]]))]
    kept, plain = [], module.stored

    def counted(df):
        out = plain(df)
        kept.append((out.agg({"df": "max"}).first()[0] if "df" in out.columns else 0, sum(Path(x.removeprefix("file://")).stat().st_size for x in out.inputFiles())))
        return out

    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SAMPLE", 12), ("SMALL", 0), ("stored", counted)):
        monkeypatch.setattr(module, name, value)
    got = jaccard_join(df, words=4, percent=85, links=True).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in got} == {(i, i - i % 2, 1) for i in range(600)}
    first = 600 * 31 + 60 * 9  # first tokens of all sets
    assert max(n for n, _ in kept) == 2  # tokens of the passage, which thirty pairs share, are not among the first
    assert sum(b for _, b in kept) < 5 * 8 * first  # some numbers for a first token; the whole sets are not kept
