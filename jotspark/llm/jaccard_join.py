"""N-gram Jaccard self-join by a token-group matrix: similar documents share a group, a group stores the union of its
members' tokens, and only groups whose overlap with a query can suffice are opened."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jotspark.llm.common import stored, table
from jotspark.llm.components import components

#: Members and queries that meet in one task, and the shingles of each side.
MEMBERS, QUERIES, MEMBER_SHINGLES, QUERY_SHINGLES = 256, 512, 300_000, 600_000
#: Documents looked at to order the tokens, and the share of all whose first tokens are looked at then; the order decides the work, never the result.
SAMPLE, SHARE = 8192, 1 / 8
#: Tokens whose order is kept, the most frequent ones.
ORDERED = 1_000_000
#: A token that more nodes hold is looked up under several keys, so that no task gets all of them.
HELD = 4096
#: Words of which a worker keeps the hashes, and rows that it works out at once; they bound its memory.
KNOWN, ROWS = 150_000, 1000
#: A list of so many keys may be broadcast (about 16 bytes each); beyond it the join is by shuffle.
SMALL = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is short enough; a stored table, as it is counted."""
    return F.broadcast(df) if df.count() <= SMALL else df


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes (a pair of texts meets a false match with odds of 2^-64 a pair of shingles)."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        if not k:
            return h.view(np.int64)
        s = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            s = (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((s ^ (s >> np.uint64(30))).view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def first_size(n: int, percent: int) -> int:
    """So many first tokens of a set of n hold one that any linked set has among its own."""
    return n - least_overlap(n, percent) + 1


def least_hits(percent: int) -> Column:
    """Tokens that a query's first tokens and the union of a group's must share if a member can link with the query.

    Let x and y share c of their first tokens. Whatever else they share comes after the earlier of the two last ones, so
    the overlap is at most c + max(rest(x), rest(y)), rest(n) being the tokens after the first ones. A link needs
    percent * (x + y) / (100 + percent). Over the sizes y of a group the difference is least at one of its ends; one less
    is asked for, as the roundings of both can differ.
    """
    x = F.col("n")

    def rest(n: Column) -> Column:
        return F.ceil(n * percent / F.lit(100.0)) - 1

    def lacking(y: Column) -> Column:
        return F.ceil((x + y) * percent / F.lit(100.0 + percent)) - F.greatest(rest(x), rest(y))

    low, high = F.greatest("least", F.ceil(x * percent / F.lit(100.0))), F.least("most", F.floor(x * 100 / F.lit(float(percent))))
    return F.least(lacking(low), lacking(high)) - 1


def per_text(docs: DataFrame, words: int, schema: str, fn) -> DataFrame:
    """docs: id (long), text, and more; fn(shingles, id) gives the first columns of the output row, and what docs has more follows."""
    kinds = [pa.list_(pa.int64()) if "array" in x else pa.int64() for x in schema.split(", ")]
    more = "".join(f", `{c}` {kind}" for c, kind in docs.dtypes[2:])
    names = [x.split()[0] for x in schema.split(", ")] + docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in (big.slice(at, ROWS) for big in batches for at in range(0, big.num_rows, ROWS)):
            rows = [fn(shingles(t.as_py()), i.as_py()) for i, t in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)] + b.columns[2:], names)

    return docs.mapInArrow(run, schema + more)


def first_tokens(tokens: np.ndarray, k: int, listed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first k of a set's tokens in the order of all: those not listed, by value, then the listed ones by their place."""
    at = np.searchsorted(listed, tokens)
    at[at == len(listed)] = 0
    late = listed[at] == tokens if len(listed) else np.zeros(len(tokens), bool)
    first = tokens[~late][:k]
    if len(first) < k:
        first = np.r_[first, tokens[late][np.argsort(place[at[late]])[: k - len(first)]]]
    return first.copy()  # not a view that keeps the whole set


def frequent(docs: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that come late in the order, rarest first, at most the ORDERED most frequent, by value with their places: those seen in three or more of about
    SAMPLE documents, and, before them, those that three or more of a share of all documents have among their first tokens. By the share a token of
    very many documents is found however large the table is; a fixed number of documents alone would leave ever more frequent ones among the first."""
    spark, total = docs.sparkSession, max(1, docs.count())

    def some(share: float) -> DataFrame:
        return docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1)

    def seen(tokens: DataFrame) -> np.ndarray:
        counted = tokens.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter("n >= 3")
        return counted.orderBy(F.col("n").desc(), F.col("t").desc()).limit(ORDERED).select("t").toPandas()["t"].to_numpy(np.int64)

    def placed(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(tokens, kind="stable")
        return tokens[by], -by  # the most frequent, the first here, has the last place

    tokens = seen(per_text(some(SAMPLE / total), words, "tokens array<long>", lambda s, i: (s,)))
    if SAMPLE < SHARE * total:
        known = spark.sparkContext.broadcast(placed(tokens))
        ahead = per_text(some(SHARE), words, "tokens array<long>", lambda s, i: (first_tokens(s, 2 * first_size(len(s), percent), *known.value),))
        more = seen(ahead)
        tokens = np.r_[tokens, more[~np.isin(more, tokens)]][:ORDERED]
    return placed(tokens)


def digest(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes()))))


def linked(members: pd.DataFrame, queries: pd.DataFrame, percent: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links between queries and members that join what is not yet joined, at most one less than the nodes; and for each class the
    copies it links with here. Every link counts: a pair of one part meets from both sides and counts from its smaller class."""
    if not len(members) or not len(queries):
        return [], {}
    members, queries = members.drop_duplicates(["node", "cls"]), queries.drop_duplicates(["q_node", "q_cls"])  # repeated rows
    ids, sizes, classes, copies = (members[c].to_numpy() for c in ("node", "n", "cls", "copies"))
    inside = set(classes.tolist())
    met, links = np.zeros(len(ids), np.int64), {}
    tokens = np.concatenate(members["tokens"].to_numpy())
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(ids)), sizes)[order]
    union, first = np.unique(tokens[order], return_index=True)
    last = np.r_[first[1:], len(tokens)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for q, n, own, cls, weight in zip(*(queries[f"q_{c}"] for c in ("node", "n", "tokens", "cls", "copies")), strict=True):
        at = np.searchsorted(union, own)
        at[at == len(union)] = 0
        at = at[union[at] == own]
        if len(at) < least_overlap(n, percent):  # the group's bound: no member can share more than the union does
            continue
        lengths = last[at] - first[at]
        spots = np.repeat(first[at] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[spots], minlength=len(ids))
        link = 100 * shared >= percent * (n + sizes - shared)
        new = link & (classes > cls) if cls in inside else link
        met[new] += weight
        if new.any():
            links[int(cls)] = links.get(int(cls), 0) + int(copies[new].sum())
        for m in ids[link]:
            a, b = root(int(q)), root(int(m))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(q), int(m)))
    for cls, k in zip(classes[met > 0].tolist(), met[met > 0].tolist(), strict=True):
        links[cls] = links.get(cls, 0) + k
    return out, links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """Returns id, n_shingles and component_id of every row, and n_links if links is set. component_id is the smallest id reachable over links between documents whose sets of
    `words`-word shingles (ASCII lower case, words split at ASCII white space) share `percent` per cent of their union. n_links is how many
    other documents a row links with, each copy counted; of rows that share an id, each different shingle set counts once.

    Texts of fewer words are one shingle; null and empty texts have none and link with nothing, nor do rows without an id. Rows of
    equal shingle sets form a class, which is compared once; rows that share an id count as one document. Exact: any pair that
    links shares a token among the first n - ceil(percent * n / 100) + 1 tokens of each, in one order for all (rare ones first).
    Tokens that several classes share select groups; a task meets a bounded part of a group's members with a bounded part of
    the queries that the matrix sends there, so a large group is many tasks. Rows without an id are in no component (null); an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(frequent(rows, words, percent))

    def prefix(s: np.ndarray, i: int | None) -> tuple:
        return (i, len(s), digest(s), first_tokens(s, first_size(len(s), percent), *order.value)) if len(s) else (i, 0, None, [])

    base = stored(per_text(rows, words, "id long, n long, cls long, prefix array<long>", prefix).withColumn("row", F.monotonically_increasing_id()))
    classes = base.filter("n > 0 and id is not null").groupBy("cls", "n").agg(F.min(F.struct("id", "row")).alias("rep"), F.count("*").alias("rows"), F.countDistinct("id").alias("copies"))
    copied = small(stored(classes.filter("rows > 1").select("cls", "n", F.col("rep.id").alias("rep"), F.col("rep.row").alias("rep_row"), "copies")))

    # tokens that two classes share, and the nodes (first ids of classes; row tells the class) that hold them; nothing but token and row is sent for all tokens
    single = base.filter("n > 0 and id is not null").join(copied, ["cls", "n"], "left").filter("rep_row is null or rep_row = row")
    held = single.select("row", F.explode("prefix").alias("t")).withColumn("df", F.count("*").over(Window.partitionBy("t"))).filter("df > 1")

    # groups: the most frequent of a node's tokens and its size, to 5 per cent, name its group; large groups have parts
    held = stored(held).withColumn("top", F.max(F.struct("df", "t")).over(Window.partitionBy("row"))["t"])
    nodes = single.select("row", F.col("id").alias("node"), "n", "cls", F.coalesce("copies", F.lit(1)).alias("copies"))
    grouped = held.join(nodes, "row").withColumn("g", F.xxhash64("top", F.floor(F.log("n") / F.log(F.lit(1.05)))))
    grouped = stored(grouped.select("row", "t", "df", (F.col("t") == F.col("top")).alias("names"), "node", "n", "cls", "copies", "g"))
    sizes = grouped.filter("names").groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = sizes.select("g", F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.col("s") / MEMBER_SHINGLES)).alias("parts"))
    parts = small(stored(parts.filter("parts > 1")))
    owned = grouped.join(parts, "g", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long"))))
    member = stored(owned.filter("names").select("row", "node", "n", "cls", "copies", "g", "part"))

    # the matrix of tokens and groups; a query opens the groups of its tokens that come after its own
    owned = owned.select("row", "t", F.ceil(F.col("df") / HELD).alias("keys"), "n", "g", "part")
    matrix = owned.groupBy("t", "g", "part").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("keys").alias("keys"))
    matrix = matrix.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1))).drop("keys")  # one key but for tokens of many nodes
    asks = owned.select("t", F.pmod(F.xxhash64("row"), "keys").alias("key"), "row", "n", F.col("g").alias("own_g"), F.col("part").alias("own_part"))
    after = (F.col("g") > F.col("own_g")) | ((F.col("g") == F.col("own_g")) & (F.col("part") >= F.col("own_part")))
    alone = (F.col("g") == F.col("own_g")) & (F.col("part") == F.col("own_part")) & (F.col("c") == 1)
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    hit = asks.join(matrix, ["t", "key"]).filter(after & ~alone).groupBy("row", "n", "g", "part").agg(F.count("*").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))
    opened = stored(hit.filter(fits & (F.col("hits") >= least_hits(percent))).select("row", "n", "g", "part"))
    load = opened.groupBy("g", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    load = small(stored(load.select("g", "part", F.greatest(F.ceil(F.col("c") / QUERIES), F.ceil(F.col("s") / QUERY_SHINGLES)).alias("turns"))))

    # where a node's set has to go, as a member of its part or as a query or both
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn")
    seats = member.join(load, ["g", "part"]).select("row", "node", "cls", "copies", "g", "part", turn, F.lit(True).alias("seat"))
    whose = small(member.select("row", "node", "cls", "copies"))
    visits = opened.join(whose, "row").join(load, ["g", "part"]).select("row", "node", "cls", "copies", "g", "part", F.pmod(F.xxhash64("node"), F.col("turns")).alias("turn"), F.lit(False).alias("seat"))
    places = seats.union(visits).groupBy("row", "node", "cls", "copies", "g", "part", "turn").agg(F.max("seat").alias("member"), (~F.min("seat")).alias("query"))
    places = places.groupBy(F.col("node").alias("id")).agg(F.collect_list(F.struct("cls", "copies", "g", "part", "turn", "member", "query")).alias("places"))
    places = stored(places)

    # whole sets of the nodes that take part, from a second reading of their texts; each set is sent once to each place
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= SMALL
    texts = rows.join(F.broadcast(places) if few else places, "id").select("id", "text", "places")
    sets = per_text(texts, words, "node long, n long, own long, tokens array<long>", lambda s, i: (i, len(s), digest(s) if len(s) else None, s))
    sent = sets.withColumn("place", F.explode("places")).filter("place.cls = own").select("node", "n", "tokens", "place.*")

    def meet(sets: pd.DataFrame) -> pd.DataFrame:
        joins, counts = linked(sets[sets["member"]], sets[sets["query"]].add_prefix("q_"), percent)
        both = [(a, b, False) for a, b in joins] + [(a, b, True) for a, b in counts.items()]
        return pd.DataFrame({"a": np.array([x[0] for x in both], np.int64), "b": np.array([x[1] for x in both], np.int64), "count": np.array([x[2] for x in both], bool)})

    met = stored(sent.groupBy("g", "part", "turn").applyInPandas(meet, "a long, b long, count boolean"))
    joined = small(components(met.filter("not count").select("a", "b")))

    out = base.select("id", "n", "cls").join(copied.drop("rep_row"), ["cls", "n"], "left").withColumn("node", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    out = out.join(joined, "node", "left")
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")]
    if not links:
        return out.select(columns)
    counts = stored(met.filter("count").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("met")))
    out = out.join(small(counts), "cls", "left")
    zero = F.lit(0).cast("long")
    others = F.coalesce("met", zero) + F.coalesce("copies", F.lit(1)) - 1
    return out.select(*columns, F.when((F.col("n") > 0) & F.col("id").isNotNull(), others).otherwise(zero).alias("n_links"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that are the first of their component."""
    gone = stored(found.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct())
    return docs.join(small(gone), id_col, "left_anti").select(docs.columns)


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85, links=True)
