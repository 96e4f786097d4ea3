"""Line deduplication by a log-template tree of fixed depth: token count, then leading tokens; variable fields become
wildcards, and templates that recur across documents are dropped from all but the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jotspark.llm.common import free, let, positional, stored, table

#: Depth of the tree below the token count, least tokens of a line that can be dropped, documents from which a template recurs.
DEPTH, LEAST_TOKENS, MIN_DOCS = 3, 5, 3
#: Lines of so many tokens recur from two documents on, as they stand.
LONG_TOKENS, LONG_DOCS = 50, 2
#: A template of several lines needs this share of constant positions. A leaf's templates are read at several levels: at level j a token is
#: constant if it stands at its place in min_docs * STEP^j of the leaf's lines.
CONSTANT, STEP = 0.6, 3
WILD = "<*>"
#: Dropped lines up to this number may be broadcast (about 40 bytes each); beyond it the join is by shuffle.
SMALL = 500_000
#: A leaf of so many comparisons of tokens (its masks squared, times their tokens) is one row; the tokens of larger leaves are counted by joins.
PAIRS = 50_000


def masked(line: Column) -> Column:
    """The line with single spaces, and a wildcard for each token that holds a digit."""
    plain = F.trim(F.when(line.rlike(r"\s\s|[^\S ]"), F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, r"(?<!\S)[^\s\d]*+\d\S*+", WILD)).otherwise(plain)


def n_tokens(mask: Column) -> Column:
    return F.length(mask) - F.length(F.replace(mask, F.lit(" "), F.lit(""))) + 1


def template_lines(docs: DataFrame) -> DataFrame:
    """Each document's distinct masks of enough tokens: doc (a hash of the row), id, mask, its two hashes and its leaf."""
    masks = F.array_distinct(F.transform(F.split("text", "\n", -1), masked))
    rows = docs.select("doc", "id", F.explode(masks).alias("mask")).filter(n_tokens(F.col("mask")) >= LEAST_TOKENS)
    lead = F.xxhash64(n_tokens(F.col("mask")), F.substring_index("mask", " ", DEPTH))
    return rows.withColumns({"t1": F.xxhash64("mask"), "t2": F.hash(F.lit(7), F.col("mask")), "leaf": lead})


def joined(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a table of distinct keys, broadcast if it is small; the large side of a shuffled join may be split by key."""
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, on, how)


def counted_in_rows(lines: DataFrame) -> DataFrame:
    """Each mask of the leaves that are one row: t1, t2, leaf, docs and line, its tokens with the number of the leaf's documents that have them there."""
    leaves = lines.groupBy("leaf").agg(F.first("docs").alias("docs"), F.collect_set(F.struct("t1", "t2", "mask", "n")).alias("masks"))

    def counted(masks: Column) -> Column:
        def line(m: Column) -> Column:
            count = lambda t, at: F.aggregate(masks, F.lit(0).cast("long"), lambda c, o: c + F.when(F.get(o["tokens"], at) == t, o["n"]).otherwise(0))
            return F.transform(m["tokens"], lambda t, at: F.struct(t.alias("token"), count(t, at).alias("c")))

        return F.transform(masks, lambda m: F.struct(m["t1"].alias("t1"), m["t2"].alias("t2"), line(m).alias("line")))

    tokens = F.transform("masks", lambda m: F.struct(m["t1"].alias("t1"), m["t2"].alias("t2"), m["n"].alias("n"), F.split(m["mask"], " ").alias("tokens")))
    return leaves.select("leaf", "docs", F.explode(let(tokens, counted)).alias("m")).select("m.t1", "m.t2", "leaf", "docs", "m.line")


def counted_by_joins(lines: DataFrame, min_docs: int) -> DataFrame:
    """The same for leaves of any size; tokens of fewer than min_docs documents have no number."""
    words = stored(lines.groupBy("t1", "t2").agg(F.first("mask").alias("mask"), F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("docs").alias("docs")))
    places = words.select("t1", "t2", "leaf", "n", F.posexplode(F.split("mask", " ")).alias("at", "token"))
    seen = stored(places.groupBy("leaf", "at", "token").agg(F.sum("n").alias("c")).filter(F.col("c") >= min_docs))
    placed = joined(places, seen, ["leaf", "at", "token"], "left").select("t1", "t2", F.struct("at", "c").alias("x"))
    full = placed.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("x")).alias("counts")).join(words, ["t1", "t2"])  # of one line
    full = full.withColumn("line", F.zip_with(F.split("mask", " "), "counts", lambda t, x: F.struct(t.alias("token"), x["c"].alias("c"))))
    return full.select("t1", "t2", "leaf", "docs", "line")


def general(docs: DataFrame, held: DataFrame, masks: DataFrame, min_docs: int) -> DataFrame:
    """Masks of lines that differ in variable fields only: t1, t2 and the first id of the widest template that they share.

    A leaf may hold any number of families of lines: a token that many of the leaf's documents have at its place is part of some family's
    constant text, a rare one fills a field. What is rare depends on the family's size, so each line gives a template
    for each level of frequency; those with enough constant places that enough documents share are families.
    """
    leaves = masks.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("n").alias("docs"), F.max("tokens").alias("tokens"))
    leaves = leaves.filter((F.col("kinds") > 1) & (F.col("docs") >= min_docs)).select("leaf", "docs", (F.pow("kinds", F.lit(2)) * F.col("tokens") <= PAIRS).alias("one"))
    leaves = stored(leaves)
    wanted = stored(joined(masks, leaves, ["leaf"]).select("t1", "t2", "n", "docs", "one"))  # few: most leaves hold one mask
    whose = stored(joined(held.select("doc", "t1", "t2"), wanted, ["t1", "t2"], "left_semi").select("doc").distinct())
    lines = stored(joined(template_lines(joined(docs, whose, ["doc"], "left_semi")), wanted, ["t1", "t2"]))  # only texts with such lines are split again
    full = counted_in_rows(lines.filter("one")).unionByName(counted_by_joins(lines.filter("NOT one"), min_docs))
    top = F.floor(F.log(F.col("docs") / float(min_docs)) / F.log(F.lit(float(STEP))) + 1e-9).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), lambda j: F.pow(F.lit(float(STEP)), j) * min_docs)
    paths = F.transform(levels, lambda least: F.transform("line", lambda x: F.when(x["c"] >= least, x["token"]).otherwise(WILD)))
    paths = F.filter(F.array_distinct(paths), lambda p: (F.size(F.filter(p, lambda x: x != WILD)) >= CONSTANT * F.size(p)) & F.array_contains(p, WILD))
    each = full.select("t1", "t2", "leaf", F.explode(F.transform(paths, lambda p: F.array_join(p, " "))).alias("path"))
    each = stored(each.select("t1", "t2", F.xxhash64("leaf", "path").alias("p1"), F.hash(F.lit(7), F.col("path")).alias("p2")))
    met = lines.select("doc", "id", "t1", "t2").join(each, ["t1", "t2"]).select("p1", "p2", "doc", "id").distinct()
    families = stored(met.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= min_docs).drop("n"))
    return joined(each, families, ["p1", "p2"]).groupBy("t1", "t2").agg(F.min("first").alias("first"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Returns docs with the recurring lines taken out of the text, and n_dropped (lines taken out of the row; n_dropped_1 and so on
    if docs has such a column).

    A line's mask is its tokens, those with a digit as wildcards; leaves of the tree are token count and first three tokens. Within a
    leaf, tokens that are rare at their place become wildcards too (see general), if three in five positions are constant.
    A template of five or more tokens that min_docs rows hold, or a mask of 50 or more that two rows hold, is dropped from all rows but
    those of its smallest id (of the smallest of all templates that a line fits). Rows are never dropped; null texts stay null and
    empty ones empty; rows without an id keep no line that recurs in others. Repeated rows keep or lose the same lines; each counts for
    a mask, but rows of one id and text count once for a template of several masks. Line breaks are \\n; the other lines stay as they are, in their order. An empty table gives an empty one.
    """
    rows, id_name, text_name, names = positional(docs, id_col, text_col)
    own = rows.filter(F.col(text_name).isNotNull()).select(F.xxhash64(id_name, text_name).alias("doc"), F.col(id_name).alias("id"), F.col(text_name).alias("text"))
    lines = stored(template_lines(own).select("doc", "id", "t1", "t2", "leaf", n_tokens(F.col("mask")).alias("tokens")))
    masks = stored(lines.groupBy("t1", "t2", "leaf", "tokens").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    wide = general(own, lines, masks, min_docs)
    exact = masks.filter((F.col("n") >= min_docs) | ((F.col("tokens") >= LONG_TOKENS) & (F.col("n") >= min(min_docs, LONG_DOCS)))).select("t1", "t2", "first")
    recurring = stored(exact.unionByName(wide).groupBy("t1", "t2").agg(F.min("first").alias("first")))
    dropped = stored(joined(lines.select("doc", "id", "t1", "t2"), recurring, ["t1", "t2"]).filter(~F.col("id").eqNullSafe(F.col("first"))).select("doc", "t1", "t2"))
    small = dropped.count() <= SMALL
    gone = dropped.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(F.struct("t1", "t2")).alias("__gone"))  # of one text
    out = rows.withColumn("__doc", F.xxhash64(id_name, text_name)).join(F.broadcast(gone) if small else gone, "__doc", "left")

    def stays(line: Column) -> Column:
        mask = masked(line)
        return ~F.array_contains("__gone", F.struct(F.xxhash64(mask).alias("t1"), F.hash(F.lit(7), mask).alias("t2")))

    split = F.split(F.col(text_name), "\n", -1)
    left = F.when(F.col("__gone").isNull(), F.lit(None)).otherwise(F.filter(split, stays))
    out = out.withColumn("__left", left)
    text = F.when(F.col("__left").isNull(), F.col(text_name)).otherwise(F.array_join("__left", "\n"))
    n = F.when(F.col("__left").isNull(), 0).otherwise(F.size(split) - F.size("__left")).cast("long")
    count = free("n_dropped", docs.columns)
    return out.select(*[(text if new == text_name else F.col(new)).alias(old) for new, old in names], n.alias(count))


def op8_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_dropped")


def oracle(docs: str, columns: str) -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
lines AS (SELECT rid, doc_id, text, pos, line, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS plain FROM (
    SELECT rid, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE text IS NOT NULL)),
m AS (SELECT *, regexp_replace(plain, '(^|\\s)[^\\s0-9]*[0-9]\\S*', '\\1{WILD}', 'g') AS mask FROM lines),
k AS (SELECT DISTINCT rid, doc_id, text, mask, string_split(mask, ' ') AS tokens FROM m WHERE len(string_split(mask, ' ')) >= {LEAST_TOKENS}),
t AS (SELECT mask, any_value(tokens) AS tokens, count(*) AS n, min(doc_id) AS first FROM k GROUP BY mask),
lf AS (SELECT *, len(tokens) AS len_, tokens[1:{DEPTH}] AS lead FROM t),
ls AS (SELECT len_, lead, sum(n) AS docs FROM lf GROUP BY ALL HAVING count(*) > 1 AND sum(n) >= {MIN_DOCS}),
w AS (SELECT lf.*, docs FROM lf JOIN ls USING (len_, lead)),
u AS (SELECT mask, len_, lead, docs, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM w),
ct AS (SELECT len_, lead, place, token, sum(n) AS c FROM u GROUP BY ALL),
lv AS (SELECT mask, len_, lead, place, token, c, unnest(generate_series(0, greatest(0, CAST(floor(ln(docs / {float(MIN_DOCS)}) / ln({float(STEP)}) + 1e-9) AS INTEGER)))) AS j FROM u JOIN ct USING (len_, lead, place, token)),
pt AS (SELECT mask, len_, lead, j, list(CASE WHEN c >= {MIN_DOCS} * power({STEP}, j) THEN token ELSE '{WILD}' END ORDER BY place) AS path FROM lv GROUP BY ALL),
pl AS (SELECT DISTINCT mask, len_, lead, path FROM pt WHERE len(list_filter(path, lambda x: x <> '{WILD}')) >= {CONSTANT} * len(path) AND list_contains(path, '{WILD}')),
fam AS (SELECT len_, lead, path, min(doc_id) AS first FROM (SELECT DISTINCT len_, lead, path, doc_id, text FROM k JOIN pl USING (mask)) GROUP BY len_, lead, path HAVING count(*) >= {MIN_DOCS}),
r AS (SELECT mask, min(first) AS first FROM (SELECT mask, first FROM t WHERE n >= {MIN_DOCS} OR (len(tokens) >= {LONG_TOKENS} AND n >= {LONG_DOCS})
  UNION ALL SELECT mask, first FROM pl JOIN fam USING (len_, lead, path)) GROUP BY mask),
d AS (SELECT m.*, r.mask IS NOT NULL AND m.doc_id IS DISTINCT FROM r.first AS gone FROM m LEFT JOIN r ON m.mask = r.mask),
o AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept, count(*) FILTER (gone) AS n FROM d GROUP BY rid)
SELECT {columns} FROM docs LEFT JOIN o USING (rid)
"""


ORACLE = oracle("documents", "doc_id, CASE WHEN text IS NULL THEN NULL ELSE kept END AS text, coalesce(n, 0) AS n_dropped")
