"""Evaluation texts leaking into training text (problem 7), by greedy string tiling.

Both sides become words: look-alike characters in one form, markup and punctuation dropped, lower case. Shared runs of three
words are the seeds: both sides' running Karp-Rabin fingerprints are joined on them. A document and an item with enough
seeds in one place are tiled by running Karp-Rabin greedy string tiling: windows of unmarked words are matched by
fingerprint at a search length that is first long and then halved, matches are extended word by word, and the longest
that do not overlap are marked, until no run of three is left; where copies near each other could share words, each passage of
the place is tiled on its own as well. The item has leaked where the tiles that lie in order, in one place, cover at
least half of its words. Coverage in any order is reported too, so passages whose sentences changed places are caught.

The seed filter loses nothing: tiles of at least three words that cover half of n words hold at least n/6 seeds. Items with up to
``most_words`` words in all are sent to every task, and the join is a lookup in the sorted fingerprints; more items than
that are joined by a shuffle, each with its rarest seeds only: of n - 2 seeds all but the n/6 - 1 most frequent, one of which
any leak must hit. A document is read once in either case.

Null texts and items, and items of fewer than three words, match nothing. Rows with the same id count once each text.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut, skew_join
from .lookalike import Rewriter, plain_rewriter

SEED = 3
#: The length at which the search for tiles begins.
FIRST_SEARCH = 16
#: So many words of items are sent to every task at most (about 100 bytes a word).
MOST_WORDS = 1_000_000
MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?[a-zA-Z]+(?:=[^\]]*)?\]")
WORD = re.compile(r"\w+")
SCHEMA = "doc_id bigint, item_id bigint, coverage double, in_order double, first_word int, last_word int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: The odd base of the fingerprints and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words(text: str, rewrite: Rewriter) -> list[str]:
    if not text.isascii():
        text = rewrite(text)
    if "&" in text:
        text = html.unescape(text)
    return WORD.findall(MARKUP.sub(" ", text).lower())


def word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Fingerprints:
    """Karp-Rabin fingerprints, modulo 2^64, of the windows of a sequence of word ids, of any length, from its prefix sums."""

    def __init__(self, ids) -> None:
        ids = np.asarray(ids, np.uint64)
        self.size = len(ids)
        self.up = _powers(BASE, self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(ids * _powers(INVERSE, self.size), dtype=np.uint64, out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """The fingerprint of the window that begins at each place."""
        n = self.size - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * self.up[:n]


class Index:
    """The seeds of items that every task may hold."""

    def __init__(self, items: list[tuple[int, str]], rewrite: Rewriter) -> None:
        self.rewrite = rewrite
        every = [(i, words(p, rewrite)) for i, p in items if p]
        self.items = [(i, [word_id(x) for x in w]) for i, w in every if len(w) >= SEED]
        self.vocabulary = {x: word_id(x) for _, w in every for x in w}
        marks = [Fingerprints(w).windows(SEED) for _, w in self.items]
        owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks]) if marks else np.zeros(0, np.int64)
        rows = np.unique(np.stack([np.concatenate(marks), owner.astype(np.uint64)], axis=1), axis=0) if marks else np.zeros((0, 2), np.uint64)
        self.seeds, self.first = np.unique(rows[:, 0], return_index=True)
        self.first = np.append(self.first, len(rows))
        self.owner = rows[:, 1].astype(np.int64)

    def leaks(self, texts: list[str], least: float) -> Iterator[tuple[int, int, float, float, int, int]]:
        """Number of the text, item_id, coverage, coverage in order, first and last word of the place, for each leaked item."""
        get = self.vocabulary.get
        docs = [[get(w, 0) for w in words(t, self.rewrite)] for t in texts]
        if not len(self.seeds) or not docs:
            return
        begins = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        marks = Fingerprints([x for d in docs for x in d]).windows(SEED)
        at = np.minimum(np.searchsorted(self.seeds, marks), len(self.seeds) - 1)
        places_ = np.nonzero(self.seeds[at] == marks)[0]
        of = np.searchsorted(begins, places_, side="right") - 1
        inside = places_ + SEED <= begins[of + 1]
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for place, d in zip(places_[inside].tolist(), of[inside].tolist(), strict=True):
            for k in self.owner[self.first[at[place]] : self.first[at[place] + 1]].tolist():
                hits[d, k].append(place - int(begins[d]))
        for (d, k), seeds in hits.items():
            item = self.items[k][1]
            if len(seeds) >= math.ceil(len(item) * least / SEED):
                got = covered(item, docs[d], seeds, least)
                if got:
                    yield d, self.items[k][0], *got


def covered(item: list[int], doc: list[int], seeds: list[int], least: float) -> tuple[float, float, int, int] | None:
    """Coverage, coverage in order, first and last word of the best place, where one of them reaches ``least``."""
    n, span = len(item), reach(len(item))
    best, any_order = (0, 0, 0), 0
    for begin, end in places(seeds, math.ceil(n * least / SEED), span):
        tiles = tile(item, doc, begin, end)
        any_order = max(any_order, sum(t[2] for t in tiles))
        best = max(best, chain(tiles, span))
        best, any_order = alone(item, doc, begin, end, span, best, any_order)
    return (any_order / n, best[0] / n, best[1], best[2]) if max(best[0], any_order) >= least * n else None


def reach(n: int) -> int:
    """How many words of a document a passage of n words may spread over and still be in one place."""
    return n + n // 2 + 10


def places(at: list[int], enough: int, span: int) -> list[tuple[int, int]]:
    """Ranges of words that hold all windows of ``span`` words with ``enough`` seeds."""
    out: list[list[int]] = []
    for i in range(len(at) - enough + 1):
        if at[i + enough - 1] - at[i] <= span:
            a, b = at[i], at[i + enough - 1] + SEED
            a, b = max(0, a - span), b + span
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [tuple(x) for x in out]


def seed_pairs(item: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Places in the item and in the text of every shared seed, by the place in the text."""
    return [(p, q) for p, q, _ in matches(item, text, SEED, None, None)[0]]


def matches(item: list[int], text: list[int], length: int, free_i: list[bool] | None, free_t: list[bool] | None) -> tuple[list[tuple[int, int, int]], int]:
    """Every (place in the item, place in the text, length) where unmarked windows of ``length`` have the same fingerprint
    and the same words, extended over unmarked words that agree, and the greatest length."""

    def open_windows(ids, free):
        marks = Fingerprints(ids).windows(length)
        if free is None:
            return [(i, h) for i, h in enumerate(marks.tolist())]
        gaps = np.concatenate([[0], np.cumsum(~np.asarray(free))])
        whole = np.nonzero(gaps[length:] == gaps[: len(gaps) - length])[0] if len(marks) else []
        return [(int(i), int(marks[i])) for i in whole]

    where: dict[int, list[int]] = defaultdict(list)
    for p, h in open_windows(item, free_i):
        where[h].append(p)
    out, longest = [], 0
    for q, h in open_windows(text, free_t):
        for p in where.get(h, ()):
            if item[p : p + length] != text[q : q + length]:
                continue
            n = length
            if free_i is not None:
                while p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n] and free_i[p + n] and free_t[q + n]:
                    n += 1
            out.append((p, q, n))
            longest = max(longest, n)
    return out, longest


def bounds(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """The most item words that any tiles of these seeds can cover in order (longest common subsequence), and in any order."""
    tails: list[int] = []
    for _, p in sorted({(q + d, -p - d) for p, q in pairs for d in range(SEED)}):
        at = bisect_left(tails, -p)
        tails[at : at + 1] = [-p]
    return len(tails), len({p + d for p, _ in pairs for d in range(SEED)})


def alone(item: list[int], doc: list[int], begin: int, end: int, span: int, best: tuple[int, int, int], any_order: int) -> tuple[tuple[int, int, int], int]:
    """The best chain and coverage, where passages of up to ``span`` words are tiled each on its own, so that copies near each
    other take no words from one another. Passages that cannot be better than ``best`` and ``any_order`` are left out."""
    pairs = [(p, q + begin) for p, q in seed_pairs(item, doc[begin:end])]
    better = lambda some: any(x > y for x, y in zip(bounds(some), (best[0], any_order), strict=True))
    if better(pairs):
        for a in sorted({q for _, q in pairs}):
            own = [x for x in pairs if a <= x[1] <= a + span - SEED]
            while own and better(own):
                z = own[-1][1]
                tiles = tile(item, doc, a, z + SEED)
                any_order = max(any_order, sum(t[2] for t in tiles))
                best = max(best, chain(tiles, span))
                own = [x for x in own if x[1] < z]
    return best, any_order


def tile(item: list[int], doc: list[int], begin: int, end: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length), the longest first; each word is in one tile at most."""
    text = doc[begin:end]
    free_i, free_t = [True] * len(item), [True] * len(text)
    tiles: list[tuple[int, int, int]] = []
    length = max(SEED, min(FIRST_SEARCH, len(item)))
    while True:
        found_, longest = matches(item, text, length, free_i, free_t)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, q, p) for p, q, n in found_]
        heapq.heapify(queue)
        while queue:
            n, q, p = heapq.heappop(queue)
            n = -n
            lost = [not (free_i[p + i] and free_t[q + i]) for i in range(n)]
            if any(lost):  # what longer tiles have left of it waits for its turn
                a = 0
                while a < n:
                    b = a
                    while b < n and not lost[b]:
                        b += 1
                    if b - a >= length:
                        heapq.heappush(queue, (a - b, q + a, p + a))
                    a = b + 1
                continue
            free_i[p : p + n] = [False] * n
            free_t[q : q + n] = [False] * n
            tiles.append((p, q + begin, n))
        if length == SEED:
            return tiles
        length = max(SEED, length // 2)


def chain(tiles: list[tuple[int, int, int]], span: int) -> tuple[int, int, int]:
    """The most words covered by tiles in order within ``span`` words of the document, with the place's first and last word."""
    tiles = sorted(tiles, key=lambda t: t[1])
    best = (0, 0, 0)
    for s in range(len(tiles)):
        limit = tiles[s][1] + span
        score: dict[int, int] = {s: tiles[s][2]}
        for j in range(s, len(tiles)):
            p, q, n = tiles[j]
            if q + n > limit:
                continue
            if j > s:
                score[j] = max((v + n for k, v in score.items() if tiles[k][0] + tiles[k][2] <= p and tiles[k][1] + tiles[k][2] <= q), default=0)
            if score[j] > best[0]:
                best = (score[j], tiles[s][1], q + n)
    return best


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, in_order, first_word, last_word of every document and item with coverage of ``least``."""
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = items.select("item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    size = rows.agg(F.sum(F.size(F.split("passage", r"\W+")))).first()[0] or 0
    out = _by_lookup(texts, [(r.item_id, r.passage) for r in rows.orderBy("item_id", "passage").collect()], least) if size <= most_words else _by_join(texts, rows, least)
    return out.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max(F.struct("in_order", "first_word", "last_word")).alias("x")).select("doc_id", "item_id", "coverage", "x.in_order", "x.first_word", "x.last_word")


def _by_lookup(texts: DataFrame, items: list[tuple[int, str]], least: float) -> DataFrame:
    rewrite = plain_rewriter()
    held = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value, rewrite)
        for b in batches:
            ids = b["doc_id"].to_list()
            yield pd.DataFrame([(ids[x[0]], *x[1:]) for x in index.leaks(b["text"].to_list(), least)], columns=_COLUMNS)

    return texts.mapInPandas(run, SCHEMA)


def _by_join(texts: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Candidates from a shuffled join of the seeds; only these are tiled. Texts and items are named by their hashes until then."""
    rewrite = plain_rewriter()
    texts, items = cut(texts.withColumn("d", F.xxhash64("text"))), cut(items.withColumn("i", F.xxhash64("passage")))

    def seeds(column: str, ids: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                marks = [Fingerprints([word_id(w) for w in words(t, rewrite)]) for t in b[column]]
                own = [np.unique(m.windows(SEED), return_counts=True) for m in marks]
                many = [len(x) for x, _ in own]
                yield pd.DataFrame({**{c: np.repeat(b[c].to_numpy(), many) for c in ids}, "n": np.repeat([m.size for m in marks], many), "seed": np.concatenate([x.astype(np.int64) for x, _ in own] or [[]]), "times": np.concatenate([x for _, x in own] or [[]])})

        return run

    schema = "n bigint, seed bigint, times bigint"
    of_docs = texts.mapInPandas(seeds("text", ["doc_id", "d"]), f"doc_id bigint, d bigint, {schema}").select("doc_id", "d", "seed")
    of_items = cut(items.mapInPandas(seeds("passage", ["item_id", "i"]), f"item_id bigint, i bigint, {schema}"))
    often = of_docs.join(of_items.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    # a leak hits so many seeds of an item that the most frequent ones, one fewer in all, need no look
    order = Window.partitionBy("item_id", "i").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    rare = of_items.join(often, "seed").withColumn("upto", F.sum("times").over(order)).where(F.col("upto") >= F.ceil(F.col("n") * least / SEED))
    pairs = skew_join(of_docs, rare.select("seed", "item_id", "i"), ["seed"]).select("doc_id", "d", "item_id", "i").distinct()
    both = pairs.join(texts, ["doc_id", "d"]).join(items, ["item_id", "i"]).select("doc_id", "text", "item_id", "passage")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, text, i, passage in zip(b["doc_id"], b["text"], b["item_id"], b["passage"], strict=True):
                item, doc = ([word_id(w) for w in words(t, rewrite)] for t in (passage, text))
                at = sorted({q for _, q in seed_pairs(item, doc)})
                got = covered(item, doc, at, least) if len(at) >= math.ceil(len(item) * least / SEED) else None
                if got:
                    out.append((d, i, *got))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return both.mapInPandas(run, SCHEMA)


def found(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id; ids as in TESTDATA."""
    return leaks(docs, items, least).where(F.col("in_order") >= least).select("doc_id", "item_id")


def per_item(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """item_id, n_docs, n_in_order, best: where each item leaked, 0 for items that did not."""
    by = leaks(docs, items, least).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("in_order") >= least).alias("n_in_order"), F.round(F.max("coverage"), 4).alias("best"))
    every = items.where(F.col("item_id").isNotNull()).select("item_id", "suite").dropDuplicates(["item_id"])
    return every.join(by, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_in_order", F.lit(0)).alias("n_in_order"), F.coalesce("best", F.lit(0.0)).alias("best"))
