"""Mixing sources to target weights: budgets flow down a domain-language-source tree, shortages are shared among siblings
first, and each leaf gives a token prefix of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jotspark.llm.common import stored, table

LEAF = ["domain", "lang", "source"]
#: A table of leaves up to this size may be broadcast; beyond it the join is by shuffle.
SMALL = 100_000
#: Weights of the registered query; what is not named weighs 1.
DOMAINS = {"group0": 4, "group1": 3, "group2": 2, "group3": 1}
LANGS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def default_domain() -> Column:
    """Sources in four groups by their number; those without a number are group0."""
    number = F.coalesce(F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.concat(F.lit("group"), (number % 4).cast("string"))


def n_tokens(text: Column) -> Column:
    """Runs without white space."""
    n = F.size(F.split(text, r"\s+")) - text.rlike(r"^\s").cast("int") - text.rlike(r"\s$").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(n).cast("long")


def weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(F.col(column) == k, w).otherwise(out)
    return out.cast("decimal(20,0)")


def water_fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Shares each parent's budget among its children (columns budget, w, cap) by weight, up to their caps; what a capped
    child leaves goes to its siblings by weight. Adds alloc; whole tokens, rounded down."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col(name))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(20,0)")
    df = nodes.withColumn("c_before", F.coalesce(F.sum("cap").over(before), zero)).withColumn("w_after", F.sum("w").over(after))
    df = df.withColumn("full", F.col("cap") * F.col("w_after") + F.col("c_before") * F.col("w") <= F.col("budget") * F.col("w"))
    df = df.withColumn("c_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), zero)).withColumn("w_rest", F.sum(F.when(~F.col("full"), F.col("w"))).over(by))
    share = F.expr("(budget - c_full) * w div w_rest").cast("decimal(20,0)")
    return df.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.least(share, F.col("cap")))).drop("c_before", "w_after", "full", "c_full", "w_rest")


def budgets(leaves: DataFrame, total: int, epochs: int, domain_weights: dict[str, int], lang_weights: dict[str, int], source_weights: dict[str, int]) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds alloc, full epochs and the tokens of the last, partial epoch."""
    leaf = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("decimal(20,0)"))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("cap").cast("decimal(20,0)").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").cast("decimal(20,0)").alias("cap"))
    d = water_fill(domains.withColumns({"budget": F.lit(total).cast("decimal(20,0)"), "w": weight("domain", domain_weights)}), [], "domain")
    m = langs.join(d.select("domain", F.col("alloc").alias("budget")), "domain").withColumn("w", weight("lang", lang_weights))
    m = water_fill(m, ["domain"], "lang")
    s = leaf.join(m.select("domain", "lang", F.col("alloc").alias("budget")), ["domain", "lang"]).withColumn("w", weight("source", source_weights))
    s = water_fill(s, ["domain", "lang"], "source").withColumn("alloc", F.col("alloc").cast("long"))
    return s.select(*LEAF, "tokens", "alloc", F.expr("CASE WHEN tokens > 0 THEN alloc div tokens ELSE 0 END").alias("epochs"), F.expr("CASE WHEN tokens > 0 THEN alloc % tokens ELSE 0 END").alias("rest"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, share: float = 0.5, epochs: int = 3, seed: int = 17,
    domain_weights: dict[str, int] | None = None, lang_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Returns id, the columns in keep, domain, leaf_lang, leaf_source, n_tokens and copies of every row that is selected.

    The budget is `share` of all tokens (runs without white space). It is split by weight among domains, then languages,
    then sources; no leaf gives more than `epochs` times its tokens, and what it lacks goes to its siblings first, then to
    its parent's. A leaf gives its whole epochs to all its rows and, of the next epoch, the rows whose tokens add up to at most
    the rest, in order of md5(seed:epoch:id), then id. copies: how often a row is taken. Null languages and sources are the leaf
    ''; null and empty texts have 0 tokens and come along where their turn is; repeated rows have one turn together; an empty table gives none.
    """
    texts = [F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col)]
    dom = domain if domain is not None else default_domain()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.coalesce(dom, F.lit("")).alias("domain"), texts[0].alias("lang"), texts[1].alias("source"))
    narrow = stored(rows.select(F.col(id_col).cast("string").alias("id"), *LEAF, n_tokens(F.col("__text")).alias("n_tokens")))
    leaves = stored(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")))
    small = leaves.count() <= SMALL
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = stored(budgets(leaves, total, epochs, domain_weights or {}, lang_weights or {}, source_weights or {}))

    def with_leaf(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return df.join(F.broadcast(other) if small else other, on, how)

    # where the partial epoch ends: by the first two hexadecimal digits, then the next two, then row by row
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce("id", F.lit(""))).cast("binary"))
    turns = with_leaf(narrow, plan.select(*LEAF, "epochs", "rest"), LEAF).withColumn("h", key)
    turns = stored(turns.select("id", *LEAF, "n_tokens", "rest", "h", F.substring("h", 1, 2).alias("h1"), F.substring("h", 3, 2).alias("h2"), F.lit(0).cast("long").alias("before")))
    for digit in ("h1", "h2"):
        sums = turns.groupBy(*LEAF, digit).agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEAF).orderBy(digit)) + F.col("before"))
        edge = stored(run.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest"))).select(*LEAF, digit, (F.col("upto") - F.col("t")).alias("before")))
        turns = with_leaf(turns.drop("before"), edge, [*LEAF, digit])
    in_turn = turns.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*LEAF, "h1", "h2").orderBy("h", "id")) + F.col("before"))
    last = in_turn.groupBy(*LEAF, F.concat("h1", "h2").alias("edge")).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("h", F.coalesce("id", F.lit("")).alias("id")))).alias("last"))
    plan = plan.join(last, LEAF, "left").select(*[F.col(c).alias(f"__{c}") for c in LEAF], "epochs", "edge", "last")
    plan = stored(plan)

    out = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"), F.coalesce(dom, F.lit("")).alias("__domain"), texts[0].alias("__lang"), texts[1].alias("__source"), F.col(id_col).cast("string").alias("__id"))
    out = with_leaf(out, plan, [f"__{c}" for c in LEAF])
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce("__id", F.lit(""))).cast("binary"))
    head = F.substring("__h", 1, 4)
    more = (head < F.col("edge")) | ((head == F.col("edge")) & (F.struct(F.col("__h").alias("h"), F.coalesce("__id", F.lit("")).alias("id")) <= F.col("last")))
    more = F.when(F.col("edge").isNull(), True).otherwise(F.coalesce(more, F.lit(False)))  # a leaf without tokens has no edge: all its rows fit
    out = out.withColumn("__h", h).withColumn("copies", F.col("epochs") + more.cast("long")).filter("copies > 0")
    return out.select(id_col, *keep, F.col("__domain").alias("domain"), F.col("__lang").alias("leaf_lang"), F.col("__source").alias("leaf_source"), n_tokens(F.col("__text")).alias("n_tokens"), "copies")


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), domain_weights=DOMAINS, lang_weights=LANGS)


def _fill(level: str, parent: str, source: str) -> str:
    by = f"PARTITION BY {parent}" if parent else "PARTITION BY 0"
    order = f"{by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level}"
    return f"""(SELECT * EXCLUDE (c0, w1, full_, c2, w2), CASE WHEN full_ THEN cap ELSE least(cap, (budget - c2) * w // w2) END AS alloc FROM (
      SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({by}), 0)::HUGEINT AS c2, (sum(CASE WHEN NOT full_ THEN w END) OVER ({by}))::HUGEINT AS w2 FROM (
      SELECT *, cap * w1 + c0 * w <= budget * w AS full_ FROM (
      SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c0,
        (sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS w1 FROM {source}))))"""


def _case(column: str, weights: dict[str, int]) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END AS HUGEINT)"


def oracle(docs: str) -> str:
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  'group' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4)::VARCHAR AS domain,
  CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split_regex(text, '\\s+')) - regexp_matches(text, '^\\s')::INT - regexp_matches(text, '\\s$')::INT END::BIGINT AS n_tokens FROM {docs}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 3 * sum(n_tokens)::HUGEINT AS cap FROM t GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL),
doms AS (SELECT domain, sum(cap)::HUGEINT AS cap, {_case("domain", DOMAINS)} AS w, (SELECT CAST(floor(sum(tokens)::BIGINT * 0.5::DOUBLE) AS HUGEINT) FROM leaf) AS budget FROM langs GROUP BY domain),
d AS {_fill("domain", "", "doms")},
l0 AS (SELECT langs.*, {_case("lang", LANGS)} AS w, d.alloc AS budget FROM langs JOIN d USING (domain)),
l AS {_fill("lang", "domain", "l0")},
s0 AS (SELECT leaf.*, 1::HUGEINT AS w, l.alloc AS budget FROM leaf JOIN l USING (domain, lang)),
s AS {_fill("source", "domain, lang", "s0")},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN (alloc // tokens)::BIGINT ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN alloc % tokens ELSE 0 END AS rest FROM s),
h AS (SELECT t.*, epochs, rest, md5('17:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM t JOIN p USING (domain, lang, source)),
c AS (SELECT *, epochs + (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id::VARCHAR) <= rest)::BIGINT AS copies FROM h)
SELECT doc_id, domain, lang AS leaf_lang, source AS leaf_source, n_tokens, copies FROM c WHERE copies > 0
"""


ORACLE = oracle("documents")
