"""Personal data: base patterns, and wider candidates that boosted trees accept by format and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jotspark.llm.common import fold, let, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns: the same leftmost matches, found in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: spelled-out addresses, and digit groups with any usual separator.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]++ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]){9,15}(?![0-9])",
    "phone": r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9])",
}
#: What a text must hold for a pattern to match and pass its check at all; cheaper than the pattern. Each is part of its pattern: a base
#: card has 16 digits or more with at most one separator between two, a base phone number may have any number of them.
BASE_HOLDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
WIDE_HOLDS = {"email": r"@|[\[(] ?at", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}(?:[ .-]?[0-9]){9}", "phone": r"[0-9](?:[ ().-]{0,2}[0-9]){6}"}
WORDS = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay", "phone": "tel|phone|call|mobile|fax"}
MARK, OTHER = "\u0001", "\u0003"
SPAN = "array<struct<start: int, end: int, x: string, before: string>>"
FEATURES = ["f_kind", "f_len", "f_digits", "f_seps", "f_plus", "f_paren", "f_at", "f_dots", "f_luhn", "f_octets", "f_word", "f_joined", "f_date"]
#: Candidates of each label that the trees are fitted on at most, and the share of right ones that a threshold must reach.
TRAIN_ROWS, PRECISION = 10_000, 0.95
#: Lengths that are summed in one run, and levels of runs: 64^4 pieces are summed in linear time.
RUN, LEVELS = 64, 3


def running(lengths: Column, levels: int = LEVELS) -> Column:
    """The sum of the lengths before each one; runs of RUN lengths are summed apart, and so are their totals."""

    def plain(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
        return F.aggregate(a, start, step, lambda s: s["out"])

    def parted(a: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda i: F.slice(a, i * RUN + 1, RUN))

        def joined(runs: Column) -> Column:
            before = running(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, x: s + x)), levels - 1)
            return F.flatten(F.zip_with(runs, before, lambda r, at: F.transform(plain(r), lambda x: x + at)))

        return let(runs, joined)

    return let(lengths, lambda a: F.when(F.size(a) <= 2 * RUN, plain(a)).otherwise(parted(a)) if levels else plain(a))


def matches(text: Column, pattern: str, holds: str) -> Column:
    """All matches of a pattern with their places in code points and up to 24 characters before them, in linear time."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def spans(p: Column) -> Column:
        def span(at: Column) -> Column:  # matches are the pieces of odd places
            return lambda i: F.struct(
                F.element_at(at, 2 * i).alias("start"), (F.element_at(at, 2 * i) + F.length(F.element_at(p, 2 * i))).alias("end"), F.element_at(p, 2 * i).alias("x"), F.substring(F.element_at(p, 2 * i - 1), -24, 24).alias("before")
            )

        found = let(running(F.transform(p, F.length)), lambda at: F.transform(F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")), span(at)))
        return F.when(F.size(p) > 1, found).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(holds), let(pieces, spans)).otherwise(F.array().cast(SPAN))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """The sum of digits that the Luhn check asks to be a multiple of ten."""
    n = F.split(F.reverse(d), "(?<=.)(?=.)")
    doubled = F.transform(n, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return luhn_sum(d) % 10 == 0


def octets(x: Column) -> Column:
    def small(p: Column) -> Column:
        q = F.regexp_replace(p, "^0+", "")
        return (F.length(q) <= 3) & (F.coalesce(F.when(F.length(q) <= 3, q).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(x, r"\."), small)


def valid(kind: str, x: Column) -> Column:
    d = digits(x)
    return {"email": F.lit(True), "ip": octets(x), "card": F.length(d).between(16, 19) & luhn(d), "phone": F.length(d).between(8, 15)}[kind]


def base_spans(kind: str) -> Column:
    good = F.filter(f"b_{kind}", lambda s: valid(kind, s["x"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["x"].alias("x"), s["before"].alias("before")))


def candidates(kind: str) -> Column:
    return F.transform(f"w_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("c")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Dates, versions and times, which runs of digits often are.
DATE = r"^(?:19|20)\d\d[-./ ]?[01]\d[-./ ]?[0-3]\d|^[0-3]?\d[-./][01]?\d[-./](?:19|20)\d\d"


def featured(c: DataFrame) -> DataFrame:
    """Format and context of each candidate (kind, x, before) as numbers."""
    x, before, kind = F.col("x"), F.lower("before"), F.col("kind")
    d = digits(x)
    said = F.coalesce(*[F.when(kind == k, before.rlike(w)) for k, w in WORDS.items()]).cast("double")
    ok_ip = F.when(kind == "ip", octets(x)).otherwise(False)
    return c.withColumns(
        {
            "f_kind": F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("double"), "f_len": F.length(x).cast("double"), "f_digits": F.length(d).cast("double"),
            "f_seps": F.length(F.regexp_replace(x, "[A-Za-z0-9]", "")).cast("double"), "f_plus": x.startswith("+").cast("double"), "f_paren": x.contains("(").cast("double"),
            "f_at": x.contains("@").cast("double"), "f_dots": F.length(F.regexp_replace(x, "[^.]", "")).cast("double"), "f_luhn": F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False).cast("double"),
            "f_octets": ok_ip.cast("double"), "f_word": said, "f_joined": before.rlike("[a-z0-9_.+-]$").cast("double"), "f_date": x.rlike(DATE).cast("double"),
        }
    )


def carriers(found: DataFrame) -> DataFrame:
    """Base spans (kind, x, before) written in the wider formats, in their own context: examples whose truth does not come from the
    base pattern's form. Numbers lose their plus sign, or get other separators; addresses are spelled out, the same or apart."""
    x, d, kind = F.col("x"), digits(F.col("x")), F.col("kind")
    spelled = [F.regexp_replace(F.replace(x, F.lit("@"), F.lit(at)), r"\.", dot) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" at ", "."))]
    spelled = [spelled[0], spelled[1], spelled[2], F.replace(x, F.lit("@"), F.lit(" (at) "))]
    grouped = lambda sep: F.regexp_replace(d, r"(\d{4})(?=\d)", f"$1{sep}")
    cards = [grouped("."), grouped("-"), grouped(" "), d]
    local = [F.regexp_replace(x, r"^\+", ""), F.concat(F.lit("00"), F.regexp_replace(x, r"^\+", "")), F.regexp_replace(d, r"^(\d{2})(\d{3})(\d+)$", "($1) $2-$3"), F.regexp_replace(d, r"^(\d{3})(\d{3})(\d+)$", "$1.$2.$3")]
    forms = F.when(kind == "email", F.array(*spelled)).when(kind == "card", F.array(*cards)).when(kind == "phone", F.array(*local)).otherwise(F.array(x))
    return found.select("held", "kind", "before", F.explode(forms).alias("x"))


def others(found: DataFrame) -> DataFrame:
    """Text that the wider patterns take and that is no personal data, one of each sort for each base span, away from its words: prices at
    a time, dates, order numbers and versions, card numbers that fail Luhn, and addresses with parts over 255."""
    n = F.abs(F.xxhash64("x", "before"))
    part = lambda k, size: F.lpad((F.shiftright(n, k) % 10**size).cast("string"), size, "7")
    year = F.concat(F.lit("20"), part(3, 2))
    number = F.concat(F.lit("4"), part(0, 4), part(7, 6), part(11, 4))
    emails = [F.concat(part(1, 2), F.lit(" @ "), part(5, 1), F.lit("."), part(9, 2)), F.concat(part(1, 1), F.lit(" (at) "), part(4, 2), F.lit("."), part(8, 2))]
    phones = [F.concat_ws("-", year, F.lit("07"), part(9, 2)), F.concat_ws(".", part(2, 2), F.lit("11"), year), part(5, 9), F.concat_ws(".", part(2, 1), part(6, 2), part(9, 3), part(1, 2))]
    cards = [F.concat(number, ((13 - luhn_sum(F.concat(number, F.lit("0"))) % 10) % 10).cast("string"))]
    forms = F.when(F.col("kind") == "email", F.array(*emails)).when(F.col("kind") == "phone", F.array(*phones)).when(F.col("kind") == "card", F.array(*cards)).otherwise(F.array(F.concat(F.lit("300."), F.col("x"))))
    return found.select("held", "kind", F.translate("before", "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza").alias("before"), F.explode(forms).alias("x"))


def fit(c: DataFrame, found: DataFrame):
    """Boosted trees and a threshold for each kind. c: the candidates that overlap no base span, found: the base spans.

    Examples of personal data are carriers(). Examples of other text are others(), and the candidates of c that fail their kind's
    check (Luhn, parts up to 255) or look like dates; the rest of c, of which some are personal data, counts as such at a tenth
    of their weight. At most TRAIN_ROWS of each label, outside the held-out fold, by a hash. On the held-out
    fold, which is read whole, a kind's threshold is the lowest score from which PRECISION of the known examples are carriers, either
    side weighing the same; a kind without examples of both has none and adds nothing. None where one label is missing."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    columns = ["held", "kind", "x", "before"]
    checked = F.when(F.col("kind") == "card", F.col("f_luhn") == 0).when(F.col("kind") == "ip", F.col("f_octets") == 0).otherwise(F.col("f_date") == 1)
    good = featured(carriers(found).select(columns)).withColumns({"y": F.lit(1.0), "weight": F.lit(1.0)})
    bad = featured(c.select(columns)).withColumns({"y": F.lit(0.0), "weight": F.when(checked, 1.0).otherwise(0.1)})
    bad = bad.unionByName(featured(others(found).select(columns)).withColumns({"y": F.lit(0.0), "weight": F.lit(1.0)}))
    picks = [df.filter("not held").orderBy(F.xxhash64("kind", "x", "before"), "kind", "x", "before").limit(TRAIN_ROWS).select("y", "weight", *FEATURES) for df in (good, bad)]
    sample = stored(picks[0].unionByName(picks[1]).repartition(4))
    if len(sample.groupBy("y").count().collect()) < 2:
        return None
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), GBTClassifier(labelCol="y", weightCol="weight", maxIter=8, maxDepth=4, seed=1)]).fit(sample)

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(featured(df)).withColumn("p", vector_to_array("probability")[1])

    held = good.unionByName(bad).filter("held and weight = 1").select("kind", "x", "before", "y")
    bins = scored(held).groupBy("kind", F.floor(F.col("p") * 50).alias("b")).agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("kind", F.col("b").desc()).collect()  # 4 x 51 rows
    thresholds = {}
    for kind in KINDS:
        own = [r for r in bins if r["kind"] == kind]
        all_y, all_n = sum(r["y"] for r in own), sum(r["n"] - r["y"] for r in own)
        y = n = 0.0
        for r in own if all_y and all_n else ():
            y, n = y + r["y"] / all_y, n + (r["n"] - r["y"]) / all_n
            if y < PRECISION * (y + n):
                break
            thresholds[kind] = max(0.5, r["b"] / 50)
    return scored, thresholds


def apart(spans: DataFrame) -> DataFrame:
    """The best of each run of spans (rid, kind, start, end, p) that overlap one after the other."""
    before = Window.partitionBy("rid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)  # of one text
    runs = spans.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy("rid").orderBy("start", "end", "kind")))
    best = runs.groupBy("rid", "run").agg(F.min(F.struct((-F.col("p")).alias("p"), "start", "end", "kind")).alias("s"))
    return best.select("rid", "s.kind", "s.start", "s.end")


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and redactions (kind, start, end) of every row.

    Base spans are the matches of the four patterns that pass their checks (parts up to 255; 16 to 19 digits and Luhn; 8 to
    15 digits), leftmost and without overlap within a kind. Wider candidates that overlap no base span are scored by boosted trees,
    which learn from base spans rewritten in other formats (see fit); those over their kind's threshold are added, the best of
    each run that overlaps. Null and empty texts have no spans; repeated rows are searched each; an empty table gives none. Without
    examples there are no added spans. The control characters U+0001 are read as U+0003, which no pattern takes.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.when(t.contains(MARK), F.translate(t, MARK, OTHER)).otherwise(t).alias("t"))
    rows = rows.select(id_col, F.when(F.col("t").rlike(r"@|[0-9]|[\[(] ?at"), F.col("t")).otherwise("").alias("t"))
    found = rows.select(id_col, *[matches(F.col("t"), BASE[k], BASE_HOLDS[k]).alias(f"b_{k}") for k in KINDS], *[matches(F.col("t"), WIDE[k], WIDE_HOLDS[k]).alias(f"w_{k}") for k in KINDS])
    spans, cands = [base_spans(k) for k in KINDS], [candidates(k) for k in KINDS]
    base = stored(found.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col), F.concat(*spans).alias("base"), F.concat(*cands).alias("cands")))

    kept = base.filter(F.size("cands") + F.size("base") > 0).withColumn("held", fold(F.col(id_col)) == 0)
    known = kept.select("rid", "held", F.explode("base").alias("s")).select("rid", "held", F.lit(True).alias("is_base"), "s.*")
    wide = kept.select("rid", "held", F.explode("cands").alias("k")).select("rid", "held", F.lit(False).alias("is_base"), "k.kind", "k.c.start", "k.c.end", "k.c.x", "k.c.before")
    every = known.unionByName(wide)
    by = Window.partitionBy("rid").orderBy("start")  # of one text; rows of equal start are peers
    back = Window.partitionBy("rid").orderBy(-F.col("start")).rangeBetween(Window.unboundedPreceding, -1)
    base_end, base_start = F.when(F.col("is_base"), F.col("end")), F.when(F.col("is_base"), F.col("start"))
    hits = (F.coalesce(F.max(base_end).over(by), F.lit(0)) > F.col("start")) | F.coalesce(F.min(base_start).over(back) < F.col("end"), F.lit(False))
    every = stored(every.withColumn("hits", hits).filter("is_base or not hits"))
    c = every.filter("not is_base")
    trained = fit(c, every.filter("is_base"))
    spans_kind = "array<struct<kind: string, start: int, end: int>>"
    plain_base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = base.select("rid", F.col(id_col), plain_base.alias("base"))
    if trained and trained[1]:
        scored, thresholds = trained
        enough = F.coalesce(*[F.when(F.col("kind") == k, F.col("p") >= x) for k, x in thresholds.items()], F.lit(False))
        extra = apart(scored(c).filter(enough).select("rid", "kind", "start", "end", "p"))
        extra = extra.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))  # of one text
        out = out.join(stored(extra), "rid", "left")
    else:
        out = out.withColumn("extra", F.lit(None).cast(spans_kind))
    both = F.concat("base", F.coalesce("extra", F.array().cast(spans_kind)))
    ranked = F.concat(*[F.array_sort(of_kind(both, k)) for k in KINDS])
    out = out.select("*", ranked.alias("redactions"))
    count = lambda k: F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}")
    return out.select(id_col, *map(count, KINDS), F.sha2(digest_of(F.col("base")), 256).alias("base_sha256"), digest_of(F.col("redactions")).alias("spans"), "redactions")


def op9_pii(spark, sf_dir):
    return pii(table(spark, sf_dir, "documents")).drop("redactions")
