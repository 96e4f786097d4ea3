"""Benchmark decontamination by the q-gram lemma: shared character q-grams are counted in overlapping diagonal bands, bands
that can hold a match within the edit budget are kept, and a banded alignment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jotspark.llm.common import free, table

#: Length of the q-grams and of a passage's windows, which start at every character, in normalised characters.
Q, WINDOW = 10, 100
#: Edits allowed for a character of a window; shorter items than LEAST say too little for edits and are found as whole words only.
RATE, LEAST = 0.06, 20
#: Characters of benchmark text that are broadcast at once; more are taken in blocks.
BLOCK_CHARS = 20_000_000
#: Characters of documents looked at side by side, characters of a slice of one text (slices overlap by more than a passage's window),
#: and shared q-grams compared at once.
CHUNK, SLICE, HITS = 400_000, 50_000, 2_000_000


def letter(c: str) -> int:
    """Lower-case letters and digits by themselves, all else as a space."""
    return 32 if not c.isalnum() else ord(c.lower()) if len(c.lower()) == 1 else ord(c)


#: The usual letters; others are looked up as they come.
_LETTERS = np.array([letter(chr(x)) for x in range(0x3000)], np.uint32)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits, all else as single spaces; and each one's place in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _LETTERS[np.minimum(codes, len(_LETTERS) - 1)]
    far = np.flatnonzero(codes >= len(_LETTERS))
    if len(far):
        kinds, which = np.unique(codes[far], return_inverse=True)
        c[far] = np.array([letter(chr(x)) for x in kinds.tolist()], np.uint32)[which]
    keep = np.flatnonzero((c != 32) | (np.r_[np.uint32(1), c[:-1]] != 32))
    return c[keep], keep


def grams(c: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(c) - Q + 1), np.uint64)
    for i in range(Q if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(h)]
    return h ^ (h >> np.uint64(32))


def distinct_windows(c: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n characters are the first of their text: a repeated window finds nothing that its first one does not."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(c), odd))
        sums = np.r_[np.uint64(0), np.cumsum((c.astype(np.uint64) + np.uint64(77)) * powers)]
        back = np.cumprod(np.full(len(c), np.uint64(pow(int(odd), -1, 1 << 64))))
        h = (sums[n:] - sums[:-n]) * back[: len(c) - n + 1]
    out = np.zeros(len(h), bool)
    out[np.unique(h ^ (h >> np.uint64(31)), return_index=True)[1]] = True
    return out


def plain(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def budget(length: int) -> int:
    return min(int(RATE * length), (length + 1) // Q - 2)


def aligned(patterns: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pattern (a row): edits, start and end of its best place in the text on `width` diagonals from its low one on."""
    far, lane = most + 1, np.arange(width)
    d = low[:, None] + lane
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    begin, edge = d.copy(), np.full((len(d), 1), far + 1)
    for i in range(patterns.shape[1]):
        at = i + d  # text position that a diagonal step takes
        ok = (at >= 0) & (at < len(text))
        same = text[np.clip(at, 0, max(0, len(text) - 1))] == patterns[:, i : i + 1] if len(text) else ok
        step = np.where(ok, cost + ~same, far + 1)
        drop = np.concatenate([cost[:, 1:] + 1, edge], 1)  # a pattern character is left out
        both = np.minimum(step, drop)
        start = np.where(step <= drop, begin, np.concatenate([begin[:, 1:], 0 * edge], 1))
        run = np.minimum.accumulate(both - lane, 1) + lane  # text characters are left out
        source = np.maximum.accumulate(np.where(run == both, lane, 0), 1)
        cost, begin = np.minimum(run, far + 1), np.take_along_axis(start, source, 1)
        end = at + 1
        cost = np.where((end >= 0) & (end <= len(text)), cost, far + 1)
    best = cost.argmin(1)
    rows = np.arange(len(d))
    return cost[rows, best], begin[rows, best], patterns.shape[1] + d[rows, best]


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best place of the pattern in the text on diagonals low to high; None over `most` edits."""
    cost, begin, end = (int(x[0]) for x in aligned(pattern[None, :], text, np.array([low]), high - low + 1, most))
    return (cost, begin, end) if cost <= most else None


class Benchmark:
    """All items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, np.ndarray, int, int]] = []  # item, characters, length of its windows, edits
        self.distinct: list[np.ndarray] = []  # of each item: which of its windows are the first of their text
        self.short: dict[str, list[tuple[int, str]]] = {}  # by first word
        h, own, pos = [], [], []
        for item, text in items:
            c = normal(text)[0]
            if len(c) and c[0] == 32:
                c = c[1:]
            if len(c) and c[-1] == 32:
                c = c[:-1]
            if len(c) < LEAST:
                words = plain(c)
                if words:
                    self.short.setdefault(words.split(" ")[0], []).append((item, words))
                continue
            g, n = grams(c), min(len(c), WINDOW)
            first = distinct_windows(c, n)
            mark = np.zeros(len(g) + 1, np.int64)  # q-grams of some distinct window
            np.add.at(mark, np.flatnonzero(first), 1)
            np.add.at(mark, np.flatnonzero(first) + n - Q + 1, -1)
            at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            h.append(g[at])
            own.append(np.full(len(at), len(self.items)))
            pos.append(at)
            self.items.append((item, c, n, max(0, budget(n))))
            self.distinct.append(first)
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.own, self.pos = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (own, pos))
        self.gram, self.first = np.unique(h[order], return_index=True)
        self.last = np.r_[self.first[1:], len(h)].astype(np.int64)
        self.posting = np.repeat(np.arange(len(self.gram)), self.last - self.first) * (len(self.items) + 1) + self.own
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.gram >> np.uint64(3)).astype(np.int64) & (len(self.bits) - 1)] = True
        self.edits = np.array([x[3] for x in self.items], np.int64)
        self.reach = np.array([x[2] - Q for x in self.items], np.int64)  # from a window's first q-gram to its last
        self.need = np.array([max(1, n + 1 - Q * (e + 1)) for _, _, n, e in self.items], np.int64)

    def find(self, texts: list[str]) -> list[list[dict]]:
        """Of each text: the passages in which windows of an item lie within the budget, with place, edits and shared q-grams."""
        out: list[list[dict]] = [[] for _ in texts]
        parts = [normal(t) for t in texts]
        if self.short:
            for (c, place), to in zip(parts, out, strict=True):
                to += self.exact(c, place)
        step = SLICE - 2 * WINDOW
        slices = [(i, at) for i, (c, _) in enumerate(parts) for at in range(0, max(1, len(c) - 2 * WINDOW), step)]
        met: dict[tuple[int, int], list[np.ndarray]] = {}  # of a text and an item: windows found, as rows of start, place, end, edits, shared
        cut = [parts[i][0][at : at + SLICE] for i, at in slices]
        starts = np.cumsum([0] + [len(c) + Q for c in cut])
        all_c = np.zeros(starts[-1], np.uint32)
        for c, s in zip(cut, starts, strict=False):
            all_c[s : s + len(c)] = c
        h = grams(all_c)
        at = np.flatnonzero(self.bits[(h >> np.uint64(3)).astype(np.int64) & (len(self.bits) - 1)])
        if len(at) and len(self.gram):
            k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
            at, k = (x[self.gram[k] == h[at]] for x in (at, k))
            doc = np.searchsorted(starts, at, side="right") - 1
            for lo, hi, first, last in self.turns(doc, k):
                n = last - first
                spot = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                d, place = np.repeat(doc[lo:hi], n), np.repeat(at[lo:hi] - starts[doc[lo:hi]], n)
                self.verify(self.own[spot], d, place - self.pos[spot], self.pos[spot], cut, slices, met)
        self.passages(met, parts, out)
        return [sorted(x, key=lambda y: (y["item_id"], y["start"])) for x in out]

    def turns(self, doc: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of hits (from, to) of whole slices, with the postings of each that are looked at together: about HITS, or, where a
        slice has more, those of a run of items."""
        n = self.last[k] - self.first[k]
        ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1 if len(doc) else np.zeros(0, int)
        total = np.r_[0, np.cumsum(n)]
        lo = 0
        for j, hi in enumerate(ends.tolist()):
            if j + 1 < len(ends) and total[ends[j + 1]] - total[lo] <= HITS:
                continue
            rounds = int(-(-(total[hi] - total[lo]) // HITS))
            mine = k[lo:hi]
            if rounds <= 1:
                yield lo, hi, self.first[mine], self.last[mine]
            else:
                for r in range(rounds):
                    a, z = (x * len(self.items) // rounds for x in (r, r + 1))
                    yield lo, hi, self.spot(mine, a), self.spot(mine, z)
            lo = hi

    def spot(self, k: np.ndarray, item: int) -> np.ndarray:
        """Where the postings of q-gram k from this item on begin."""
        return np.searchsorted(self.posting, k * (len(self.items) + 1) + item)

    def exact(self, c: np.ndarray, place: np.ndarray) -> list[dict]:
        """All places of the short items as whole words."""
        text, found = f" {plain(c)} ", []
        for first in set(text.split(" ")).intersection(self.short):
            for item, words in self.short[first]:
                i = text.find(f" {words} ")
                while i >= 0:
                    found.append({"item_id": item, "start": int(place[i]), "end": int(place[i + len(words) - 1]) + 1, "edits": 0, "shared": max(0, len(words) - Q + 1)})
                    i = text.find(f" {words} ", i + 1)
        return found

    def verify(self, own: np.ndarray, doc: np.ndarray, diagonal: np.ndarray, pos: np.ndarray, texts: list[np.ndarray], slices: list[tuple[int, int]], met: dict[tuple[int, int], list[np.ndarray]]) -> None:
        """From shared q-grams to windows: all windows whose band holds enough of them are aligned."""
        wide = 2 * (self.edits[own] + 1)
        done: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for shift in (0, 1):  # bands overlap by half: the diagonals of a match lie whole in one of them
            band = (diagonal + shift * wide // 2) // wide
            order = np.lexsort((pos, band, doc, own))
            o, d, b, p = own[order], doc[order], band[order], pos[order]
            end = np.minimum(np.arange(len(o)) + self.need[o] - 1, len(o) - 1)
            same = (o[end] == o) & (d[end] == d) & (b[end] == b) & (end - np.arange(len(o)) == self.need[o] - 1)
            good = np.flatnonzero(same & (p[end] - p <= self.reach[o]))
            if not len(good):
                continue
            cut = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (d[1:] != d[:-1]) | (b[1:] != b[:-1])])
            group = np.searchsorted(cut, good, "right") - 1
            for g, ok in zip(*split_by(group, good), strict=True):  # bands that hold enough
                lo, hi = int(cut[g]), int(cut[g + 1]) if g + 1 < len(cut) else len(o)
                i, slice_no = int(o[lo]), int(d[lo])
                _, c, n, edits = self.items[i]
                mark = np.zeros(len(c) - n + 2, np.int64)
                first, last = np.maximum(0, p[end[ok]] - self.reach[i]), np.minimum(p[ok], len(c) - n)
                np.add.at(mark, first, 1)
                np.add.at(mark, last + 1, -1)
                w = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & self.distinct[i])
                shared = np.searchsorted(p[lo:hi], w + self.reach[i], "right") - np.searchsorted(p[lo:hi], w)
                low, width = int(b[lo]) * 2 * (edits + 1) - shift * (edits + 1) - edits, 4 * edits + 2
                text, (text_no, offset) = texts[slice_no], slices[slice_no]
                half = edits + 1  # windows found are kept by half bands: those on these diagonals need not be found again
                for x in range(low // half, (low + width - 1) // half + 1):
                    for found in done.get((slice_no, i, x), ()):
                        left = ~np.isin(w, found[(found[:, 1] - found[:, 0] >= low) & (found[:, 1] - found[:, 0] < low + width), 0])
                        w, shared = w[left], shared[left]

                def keep(rows: np.ndarray, key: tuple[int, int] = (slice_no, i), to: tuple[int, int] = (text_no, i), half: int = half, move: int = offset) -> None:
                    halves = (rows[:, 1] - rows[:, 0]) // half
                    for x in np.unique(halves).tolist():
                        done.setdefault((*key, x), []).append(rows[halves == x])
                    met.setdefault(to, []).append(rows + [0, move, move, 0, 0])

                for x in np.unique(diagonal[order[ok]]).tolist():  # windows without an edit need no alignment
                    if not len(w):
                        break
                    a, z = max(0, -x, int(w[0])), min(len(c), len(text) - x, int(w[-1]) + n)
                    if z - a < n:
                        continue
                    inside = (w >= a) & (w + n <= z)
                    equal = np.r_[0, np.cumsum(c[a:z] == text[a + x : z + x])]
                    s = w[inside]
                    whole = equal[s - a + n] - equal[s - a] == n
                    if whole.any():
                        s, k = s[whole], shared[inside][whole]
                        keep(np.stack([s, s + x, s + x + n, 0 * s, k], 1))
                        left = ~np.isin(w, s)
                        w, shared = w[left], shared[left]
                for k in range(0, len(w), 512):
                    s = w[k : k + 512]
                    cost, begin, stop = aligned(c[s[:, None] + np.arange(n)], text, low + s, width, edits)
                    hit = cost <= edits
                    if hit.any():
                        keep(np.stack([s, begin, stop, cost, shared[k : k + 512]], 1)[hit])

    def passages(self, met: dict[tuple[int, int], list[np.ndarray]], parts: list, out: list[list[dict]]) -> None:
        """Windows of an item that overlap in a text are one passage."""
        for (text_no, i), found in met.items():
            place = parts[text_no][1]
            rows = np.unique(np.concatenate(found)[:, 1:], axis=0)  # by start
            far = np.r_[-1, np.maximum.accumulate(rows[:, 1])[:-1]]
            cut = np.flatnonzero(rows[:, 0] >= far)
            least, most, last = np.minimum.reduceat(rows[:, 2], cut), np.maximum.reduceat(rows[:, 3], cut), np.maximum.reduceat(rows[:, 1], cut)
            for a, z, e, k in zip(rows[cut, 0].tolist(), last.tolist(), least.tolist(), most.tolist(), strict=True):
                out[text_no].append({"item_id": self.items[i][0], "start": int(place[a]), "end": int(place[z - 1]) + 1, "edits": e, "shared": k})


def split_by(group: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The values of each group; group is in order."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return group[first].tolist(), np.split(values, first[1:])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Returns id, the columns in keep, and leaks: for each passage of a benchmark item found in the text, item_id, start, end (code
    points), and the least edits and most shared q-grams of its windows.

    Texts are compared as lower-case letters and digits with single spaces. An item is found where one of its windows (100
    characters from any place on, the whole item if shorter) lies in the text with at most 6 edits in 100 characters; windows that overlap in the
    text are one passage, whose ends may reach beyond the quote by about the edits allowed. Items under 20 characters are found without edits as whole words. Null texts or items have no part; repeated rows are searched each; empty tables give no leaks. One pass over the documents, without a
    shuffle, for each 20 million characters of benchmark, which bounds what is broadcast; texts are searched in slices that overlap, so
    that memory does not grow with a text. Kept columns that have the name leaks stay as leaks_1 and so on.
    """
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    found = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("shared", pa.int64())]))
    kind = "array<struct<item_id: long, start: long, end: long, edits: long, shared: long>>"
    named: list[str] = [id_col]
    for c in keep:
        named.append(free(c, [*named, "leaks"]))
    kept = list(zip(keep, named[1:], strict=True))
    sent = [(c, n) for c, n in kept if c != text_col]  # the text goes to the workers once
    rows = docs.select(F.col(text_col), F.col(id_col), *[c for c, _ in sent]).toDF("__text", id_col, *[n for _, n in sent])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    rows = rows.withColumn("leaks", F.array().cast(kind))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)  # about BLOCK_CHARS
        shared = docs.sparkSession.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Benchmark(shared.value)
            for b in batches:
                got, texts, size = [], [], 0
                for t in b.column(0):
                    texts.append(t.as_py() or "")
                    size += len(texts[-1])
                    if size > CHUNK:
                        got += index.find(texts)
                        texts, size = [], 0
                got += index.find(texts) if texts else []
                before = b.column(b.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x + y for x, y in zip(before, got, strict=True)], found)], b.schema.names)

        rows = rows.mapInArrow(run, f"__text string, {fields}, leaks {kind}")
    return rows.select(id_col, *[F.col("__text").alias(n) if c == text_col else F.col(n) for c, n in kept], "leaks")


def op6_decontamination(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.start", "x.end", "x.edits", "x.shared")
