import hashlib
import math
import random
import re

import duckdb
import pytest

import corpus_pipeline
from jotspark.llm import common, decontamination, licences, line_dedup, mixing, pii
from jotspark.llm.decontamination import Benchmark, banded, normal
from jotspark.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def odd(spark, extra=()):
    rows = [(1, None, "en", "src1", 9), (2, "", None, None, 9), (None, "a b", "en", "src1", 9), (3, "x y z " * 3000, "en", "src1", 9), (3, "x y z " * 3000, "en", "src1", 9), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start int")


def test_odd_rows(spark):
    df = odd(spark)
    bench = spark.createDataFrame([(1, None), (None, "abc"), (2, "short"), (3, "x y z " * 20)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(df, bench, keep=("start",)).filter("size(leaks) > 0").collect()} == {3}
    assert line_dedup.line_dedup(df).count() == 5
    assert pii.pii(df).filter("spans = ''").count() == 5
    assert licences.license_scan(df).count() == 0
    assert {r.n_tokens for r in mixing.mix(df, share=1.0).collect()} == {0, 2, 9000}
    for f in (line_dedup.line_dedup, pii.pii, licences.license_scan, mixing.mix):
        assert f(df.limit(0)).count() == 0
    assert decontamination.leaks(df.limit(0), bench.limit(0)).count() == 0


def edits(pattern, text):
    """Least edits of the pattern to some part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_and_search():
    item = "The quick brown foxes jump over many lazy dogs near the old river bank while seven birds sing at dawn"
    index = Benchmark([(7, item)])
    for text, found in ((item, True), ("noise " * 50 + item.upper() + "!", True), (item.replace("foxes", "foxxs").replace("river", "rivr"), True), (item[:40], False), ("other words here " * 30, False)):
        hits = index.find(["padding text", text])[1]
        assert bool(hits) == found, text
        for h in hits:
            assert h["edits"] == edits(normal(item)[0][:100].tolist(), normal(text)[0].tolist())
    p, t = normal("abcdefghij")[0], normal("xxabcdzfghijyy")[0]
    assert banded(p, t, -3, 8, 3)[:1] == (edits(p.tolist(), t.tolist()),)


def test_quotes_from_any_place_and_short_items():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    item = " ".join(word() for _ in range(70))
    index = Benchmark([(7, item), (8, "Forty-Two!"), (9, "..")])
    pad = " ".join(word() for _ in range(40))
    for k in range(0, len(item) - 100, 13):  # a quote as long as a window, from any place on
        hits = index.find(["x", f"{pad} {item[k : k + 100]} {pad}"])[1]
        assert [h["item_id"] for h in hits] == [7] and hits[0]["edits"] == 0, k
        assert abs(hits[0]["start"] - len(pad) - 1) <= 15 and abs(hits[0]["end"] - len(pad) - 101) <= 15
    assert not index.find([f"{pad} {item[20:105]} {pad}"])[0]
    hits = index.find([f"{item} {pad} {item[50:250]} {pad} {item[100:300].replace('a', 'a', 1)}"])[0]  # all copies, and all of each
    assert [h["item_id"] for h in hits] == [7, 7, 7] and hits[0]["start"] == 0 and abs(hits[0]["end"] - len(item)) <= 15
    assert all(h["end"] - h["start"] >= 190 for h in hits)
    hits = index.find(["forty two, not forty twos; FORTY -- TWO"])[0]
    assert [(h["item_id"], h["start"], h["end"]) for h in hits] == [(8, 0, 9), (8, 27, 39)]


def base(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    num = lambda s: re.sub("[^0-9]", "", s)
    tests = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(num(x)) <= 19 and luhn(num(x)), "phone": lambda x: 8 <= len(num(x)) <= 15}
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in pats for m in re.finditer(pats[k], t) if tests[k](m[0]))


def test_base_spans(spark):
    texts = ["a@b.c_x@y.z 1.2.3.4.5.6.7.8 é😀 me@x.org", "+1 (555) 010-9999 4111 1111 1111 1111 256.1.1.1 001.002.003.004", "@@ a@ a@b a@b. a.b@c.d.e..f", "4111-1111-1111-1111-2 \u0001 +12 3 +1--------2345678", "1" * 3000, "a." * 3000 + "@b.c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii(df).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:60]
        assert set(want.split(",")) <= {*r.spans.split(","), ""}


def test_base_phones_with_long_separators(spark):
    texts = ["call +49 - 30 - 12 - 34 - 56 now", "+33 - 612 - 345 - 678", "+1 ((2)) ((3)) ((4)) ((5)) ((6)) ((7)) ((8))", "+12 ... 34 ... 56 ... 78", "1+ 2 - - 3", "+1 - - - 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii(df).collect():
        want = base(texts[r.doc_id])
        assert (r.base_sha256, r.n_phone) == (hashlib.sha256(want.encode()).hexdigest(), want.count("phone")), texts[r.doc_id]


def test_base_spans_of_random_texts(spark):
    rng = random.Random(11)
    parts = ["+1", "+", "4111111111111111", "4111-1111", " 1111 1111", "1.2.3.4", "256.1.1.1", ".", "-", " ", "a@b.c", "@x", "me", "(030)", "12", "7", "00", "_", "%", "\n", "é", "5555 5555 5555 4444", "--", "+49 - 30 - 12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(10_000)]
    for r in pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        kinds = [s.split(":") for s in r.spans.split(",") if s]
        assert set(want.split(",")) <= {*r.spans.split(","), ""}
        for k in pii.KINDS:
            own = [(int(a), int(b)) for kind, a, b in kinds if kind == k]
            assert own == sorted(own)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@host.org +49 30 {1000000 + i}" for i in range(30_000))  # about 1 MB
    r = pii.pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == r.n_phone == 30_000 and r.base_sha256 == hashlib.sha256(base(text).encode()).hexdigest()


def test_altered_formats_are_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    rows, altered = [], {}
    for i in range(3000):
        kind, filler = i % 5, f"{word()} {word()} "
        if kind == 0:
            x = f"mail {word()}@{word()}.org" if i % 3 else f"write {word()} [at] {word()} [dot] org"
        elif kind == 1:
            x = f"call +49 {num(3)} {num(7)}" if i % 3 else f"phone 0049 {num(3)} {num(7)}"
        elif kind == 2:
            x = f"order 20{num(2)}-0{num(1)}-1{num(1)} version {num(1)}.{num(2)}"
        elif kind == 3:
            x = f"item {num(9)} of {num(8)}"
        else:
            x = f"host 10.{i % 250}.3.{i % 200}"
        if kind < 2 and not i % 3:
            altered[i] = "email" if kind == 0 else "phone"
        rows.append((i, filler + x + " " + filler))
    found = {r.doc_id: r.spans for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    caught = {k: [k2 in found[i] for i, k2 in altered.items() if k2 == k] for k in ("email", "phone")}
    assert sum(caught["email"]) >= 0.9 * len(caught["email"]) and sum(caught["phone"]) >= 0.9 * len(caught["phone"])
    wrong = [i for i in found if i % 5 in (2, 3) and found[i]]
    assert len(wrong) <= 0.05 * 1200, len(wrong)


def test_full_length_templates(spark):
    words = [f"w{k}" for k in range(3000)]
    rows = [("long", " ".join(words)), ("mid", " ".join(words[:258])), ("odd", " ".join(words[1000:1259])), ("five", "a b c d e")]
    other = " ".join(f"x{k}" for k in range(700))
    texts = [f"{other} {b} {other}" for _, b in rows] + [other, " ".join(words[:2500]), " ".join(words[:2300])]
    got = licences.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rows=rows).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert found == {(0, "long"), (0, "mid"), (0, "odd"), (1, "mid"), (2, "odd"), (3, "five"), (5, "long"), (5, "mid"), (5, "odd"), (6, "mid"), (6, "odd")}
    assert {(r.license, r.n_shared, r.n_template) for r in got if r.doc_id == 0} == {("long", 2998, 2998), ("mid", 256, 256), ("odd", 257, 257)}


def brute_lines(rows, min_docs=3):
    """A log-template tree by plain loops: rows of (id, text) with the recurring lines taken out."""
    mask = lambda line: " ".join("<*>" if re.search("[0-9]", w) else w for w in line.split())
    docs, n = {}, {}
    for i, t in rows:
        for m in {mask(x) for x in t.split("\n")} if t is not None else ():
            if len(m.split()) >= 5:
                docs.setdefault(m, set()).add((i, t))
                n[m] = n.get(m, 0) + 1
    leaf = lambda m: (len(m.split()), *m.split()[:3])
    leaves = {}
    for m in docs:
        leaves.setdefault(leaf(m), []).append(m)
    first = {m: min(i for i, _ in d) for m, d in docs.items() if n[m] >= min_docs or len(m.split()) >= 50 and n[m] >= 2}
    for own in leaves.values():
        total, count = sum(n[m] for m in own), {}
        for m in own:
            for at in enumerate(m.split()):
                count[at] = count.get(at, 0) + n[m]
        families, level = {}, min_docs
        while level <= max(total, min_docs):
            for m in own:
                path = tuple(w if count[k, w] >= level else "<*>" for k, w in enumerate(m.split()))
                if "<*>" in path and sum(w != "<*>" for w in path) >= 0.6 * len(path):
                    families.setdefault(path, set()).add(m)
            level *= 3
        for group in families.values():
            seen = set().union(*(docs[m] for m in group))
            if len(own) > 1 and len(seen) >= min_docs:
                for m in group:
                    first[m] = min(first.get(m, math.inf), *(i for i, _ in seen))
    keep = lambda i, line: first.get(mask(line), i) == i
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t in rows]


def test_lines(spark):
    rows = [(i, f"header of the common page\nown line number {i} with words\nthe user named {'abcdefgh'[i]}x logged in from the office network today") for i in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == "" for i in range(1, 6))


def test_families_of_one_leaf(spark):
    names = "anna bert cleo dora emil fred gina hugo ines jens kurt lena mona nils olga paul rosa sven tina udo".split()
    rows = [(i, f"the user {n}x signed in to the main office network early today") for i, n in enumerate(names)]
    rows += [(20 + i, f"the user {n}y bought some large green apples from our new shop") for i, n in enumerate(names)]
    rows = [(i, t.replace("the user ", "the user named ").replace(" early", "")) if i < 20 else (i, t.replace("the user ", "the user named ").replace(" new", "")) for i, t in rows]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i not in (0, 20)) for i in range(40)}


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    fields = lambda k: rng.choice(["red", "blue", "green", "x7", *[f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz"]][:k])
    shapes = ["we saw the {} bird in our {} garden at noon", "we saw the {} fox near some {} river at dusk", "we saw the small dog run past {} and away", "one two {} four five", "a b c"]
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(i, "\n".join([rng.choice(shapes).format(fields(30), fields(5)) for _ in range(rng.randint(0, 9))] + [passage] * (i in (3, 9)))) for i in range(70)]
    rows += [rows[5], rows[6], (6, rows[7][1]), (100, None), (101, ""), (102, "\n\n  \n")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, n_dropped string, __doc int, leaf string")
    out = line_dedup.line_dedup(df)
    assert out.columns == ["doc_id", "text", "n_dropped", "__doc", "leaf", "n_dropped_1"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(brute_lines(rows), key=str)
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", rows)
    assert sorted(con.execute(line_dedup.oracle("d", "doc_id, CASE WHEN text IS NULL THEN NULL ELSE kept END AS text")).fetchall(), key=str) == sorted(brute_lines(rows), key=str)


def test_tokens_of_small_leaves_are_not_dealt_out(spark, monkeypatch):
    sizes = []

    def stored(df):
        out = common.stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    rest = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, f"the long line named {'abcdefgh'[i % 8]}{'xyz'[i // 8]} {rest}") for i in range(24)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i > 0) for i in range(24)}
    assert max(sizes) <= len(rows)


@pytest.mark.parametrize("pairs", [0, 1500, 10**9])
def test_lines_counted_in_rows_and_by_joins(spark, monkeypatch, pairs):
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    rng = random.Random(8)
    shapes = ["we saw the {} bird in our {} garden at noon", "we saw the {} fox near some {} river at dusk", "they sold {} apples and bread {} today", "all of us went {} by train", "<*> of us {} went by <*> {}"]
    colours = ["red", "blue", "7", *[c * 3 for c in "abcdefghijklmnopqrst"]]
    rows = [(i, "\n".join(rng.choice(shapes).format(rng.choice(colours), rng.choice(colours[:4])) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [rows[5], (6, rows[7][1]), (100, None), (101, "")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows), key=str)


def test_very_many_lines(spark):
    text = "\n".join(f"line of many number {i} here" for i in range(40_000))
    out = line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text), (3, text), (4, "x")], "doc_id long, text string"))
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {1: 0, 2: 40_000, 3: 40_000, 4: 0}


def test_leaf_without_tokens_equals_sql(spark):
    rows = [(1, None, "it", "src9"), (2, "", "it", "src9"), (3, "", None, None), (4, "a b c", "en", "src1"), (5, None, "en", "src1"), (6, "d e " * 20, "de", "src2"), (7, "f", "de", "src2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into d values (?, ?, ?, ?)", rows)
    got = corpus_pipeline.mixing.mix(df, domain_weights=mixing.DOMAINS, lang_weights=mixing.LANGS).select("doc_id", "domain", "leaf_lang", "leaf_source", "n_tokens", "copies").collect()
    assert {1, 2, 3} <= {r.doc_id for r in got}
    assert sorted(map(tuple, got)) == sorted(con.execute(mixing.oracle("d")).fetchall())


def test_budget_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "e", 1000)]
    got = {r.source: r.alloc for r in mixing.budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), 800, 1, {}, {}, {}).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "e": 400}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        path = corpus_pipeline.shared_dir(spark) + f"/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        assert 0 < docs.count() <= before
        before = docs.count()
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    want = con.execute(mixing.oracle("d")).fetchall()
    got = corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for c in ("score", "predicted", "leaks", "n_dropped", "__doc", "node", "id", "y", "h", "offending", "Text2"):
        docs = docs.withColumn(c, docs.doc_id if c == "node" else docs.source)
    before = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= before
    assert corpus_pipeline.mix_sources(spark, docs.withColumn("domain", docs.lang), SF).columns[-3:] == ["domain", "n_tokens", "copies"]


def test_no_local_folder_on_a_cluster(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app-1"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session) == common.shared_dir(Session) != common.shared_dir(spark)
