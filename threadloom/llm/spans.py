"""Long exact spans shared between records (problem 9), by difference-cover anchors.

Windows are hashed at those positions only whose remainder modulo v lies in a difference cover D of v: for any two offsets
there is a shift below v that brings both into D, so two texts that share ``length`` characters share an aligned window of
length - v + 1 characters. Anchors found in several texts mark the places from which matches are extended: all starts of
a full-length window around them are hashed (128 bits), and windows that agree and differ in the character before (the left
ends of maximal matches) give the links. Interior windows of a match never form pairs, and groups in which nobody differs
from anybody before aggregation are dropped, so work follows the number of links.

Equal texts are treated as one and expanded at the end. Positions and lengths are code points. Null texts and texts shorter
than ``length`` share nothing. Rows with the same id and text count once; ids should be unique.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import cut, hot_of, skew_join

LENGTH = 400
#: Odd multipliers of the rolling hash and of the mixing of code points.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
OUT_ROWS = 200_000


@functools.lru_cache(maxsize=8)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """A perfect difference cover for a prime q: v = q*q + q + 1 and q + 1 remainders (Singer's construction).

    The remainders are the powers of a generator of GF(q^3) that lie in a plane through 0."""
    v = q * q + q + 1
    order = q**3 - 1
    factors = {p for p in range(2, order) if order % p == 0 and all(p % k for k in range(2, int(p**0.5) + 1))} if order < 40_000 else set(_factors(order))
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                times = lambda p, r, a=a, b=b, c=c: _reduce(p, r, (a, b, c), q)
                if all(_power((0, 1, 0), order // f, times) != (1, 0, 0) for f in factors) and _power((0, 1, 0), order, times) == (1, 0, 0):
                    out, x = [], (1, 0, 0)
                    for i in range(v):
                        if x[2] == 0:
                            out.append(i)
                        x = times(x, (0, 1, 0))
                    return v, tuple(out)
    raise ValueError(f"{q} is no prime")


def _factors(n: int) -> list[int]:
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out


def _reduce(x, y, poly, q):
    """Product of two polynomials of degree 2 modulo t^3 = a t^2 + b t + c."""
    a, b, c = poly
    full = [0] * 5
    for i, s in enumerate(x):
        for j, t in enumerate(y):
            full[i + j] += s * t
    for k in (4, 3):
        full[k - 1] += full[k] * a
        full[k - 2] += full[k] * b
        full[k - 3] += full[k] * c
    return tuple(s % q for s in full[:3])


def _power(x, n, times):
    out = (1, 0, 0)
    while n:
        if n & 1:
            out = times(out, x)
        x = times(x, x)
        n >>= 1
    return out


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose period is at most half of the length; period 1 (every position) for very short spans."""
    best = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if q * q + q + 1 <= length / 2]
    return difference_cover(best[-1]) if best else (1, (0,))


class Hasher:
    """Rolling hashes of any window of a text, two 64-bit values."""

    def __init__(self) -> None:
        self.room = 0

    def prepare(self, n: int) -> None:
        if n > self.room:
            self.room = max(n, 2 * self.room, 4096)
            self.pow = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.room, b, np.uint64))]) for b in BASES]
            self.inv = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.room, pow(b, -1, 1 << 64), np.uint64))]) for b in BASES]

    def prefix(self, codes: np.ndarray, which: int) -> np.ndarray:
        x = codes.astype(np.uint64) + np.uint64(1)
        x = x * np.uint64(MIX[which])
        x ^= x >> np.uint64(29)
        x *= np.uint64(MIX[1 - which])
        x ^= x >> np.uint64(32)
        return np.concatenate([[np.uint64(0)], np.cumsum(x * self.pow[which][: len(x)])])

    def at(self, prefix: np.ndarray, starts: np.ndarray, width: int, which: int) -> np.ndarray:
        return ((prefix[starts + width] - prefix[starts]) * self.inv[which][starts]).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _chunks(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Small column pieces gathered into frames of bounded size."""
    held: list[dict] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(next(iter(p.values())))
        if size >= OUT_ROWS:
            yield pd.DataFrame({k: np.concatenate([h[k] for h in held]) for k in held[0]})
            held, size = [], 0
    if held:
        yield pd.DataFrame({k: np.concatenate([h[k] for h in held]) for k in held[0]})


def text_classes(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(cls, text) of the distinct texts that are long enough, and (cls, doc_id) of all documents that have them."""
    docs = docs.select("doc_id", "text").where((F.length("text") >= length) & F.col("doc_id").isNotNull())
    by = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("salt"), "text").alias("k2")]
    keyed = docs.select("doc_id", "text", *by)
    first = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"))
    members = skew_join(keyed.select("doc_id", "k1", "k2"), first, ["k1", "k2"]).select("cls", "doc_id").distinct()
    texts = docs.join(first.select(F.col("cls").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("cls")).agg(F.min("text").alias("text"))
    return texts, members


def anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """hash, cls, pos of every window at a cover position."""
    v, cover = cover_for(length)
    width = length - v + 1
    remainders = np.array(cover)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher()

        def parts() -> Iterator[dict]:
            for b in batches:
                for cls, text in zip(b["cls"], b["text"], strict=True):
                    codes = code_points(text)
                    h.prepare(len(codes))
                    pos = (np.arange(0, len(codes) - width + 1, v)[:, None] + remainders).ravel()
                    pos = pos[pos + width <= len(codes)]
                    if len(pos):
                        yield {"hash": h.at(h.prefix(codes, 0), pos, width, 0), "cls": np.full(len(pos), cls), "pos": pos.astype(np.int32)}

        yield from _chunks(parts())

    return texts.mapInPandas(run, "hash bigint, cls bigint, pos int")


def windows(marked: DataFrame, length: int = LENGTH) -> DataFrame:
    """h1, h2, cls, pos, before: all full-length windows around the anchors ``at`` of (cls, text, at); before is -1 at a start."""
    v, _ = cover_for(length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher()

        def parts() -> Iterator[dict]:
            for b in batches:
                for cls, text, at in zip(b["cls"], b["text"], b["at"], strict=True):
                    codes = code_points(text)
                    h.prepare(len(codes))
                    inside = np.zeros(len(codes) + 1, np.int32)
                    at = np.asarray(at, np.int64)
                    np.add.at(inside, np.maximum(at - (v - 1), 0), 1)
                    np.add.at(inside, at + 1, -1)
                    pos = np.nonzero(np.cumsum(inside)[: len(codes) - length + 1])[0]
                    if len(pos):
                        before = np.where(pos > 0, codes[np.maximum(pos - 1, 0)].astype(np.int64), -1)
                        yield {"h1": h.at(h.prefix(codes, 0), pos, length, 0), "h2": h.at(h.prefix(codes, 1), pos, length, 1), "cls": np.full(len(pos), cls), "pos": pos.astype(np.int32), "before": before.astype(np.int32)}

        yield from _chunks(parts())

    return marked.mapInPandas(run, "h1 bigint, h2 bigint, cls bigint, pos int, before int")


def marked_texts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """cls, text, at: the texts that share an anchor with another, with the positions of those anchors."""
    every = anchors(texts, length)
    shared = cut(every.groupBy("hash").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("hash", "n"))
    at = skew_join(every, shared.select("hash"), ["hash"], hot=hot_of(shared, ["hash"])).groupBy("cls").agg(F.collect_list("pos").alias("at"))
    return texts.join(at, "cls")


def _shared_windows(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    texts, members = text_classes(docs, length)
    return cut(marked_texts(texts, length)), cut(members)


def class_pairs(marked: DataFrame, length: int = LENGTH) -> DataFrame:
    """cls_a < cls_b: every two distinct texts with a common stretch of the length."""
    every = windows(marked, length)
    groups = every.groupBy("h1", "h2").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.count(F.lit(1)).alias("n"))
    ends = cut(groups.where("lo < hi AND (b0 = -1 OR b0 < b1)").select("h1", "h2", "n"))
    hot = hot_of(ends, ["h1", "h2"])
    kept = cut(skew_join(every, ends.select("h1", "h2"), ["h1", "h2"], hot=hot).select("h1", "h2", "cls", "before").distinct())
    other = kept.select("h1", "h2", F.col("cls").alias("cls_b"), F.col("before").alias("before_b"))
    linked = skew_join(kept, other, ["h1", "h2"], hot=hot).where("cls < cls_b AND (before <> before_b OR before = -1)")
    return linked.select(F.col("cls").alias("cls_a"), "cls_b").distinct()


def found(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id_a, doc_id_b; ids as in TESTDATA."""
    marked, members = _shared_windows(docs, length)
    pairs = class_pairs(marked, length)
    a, b = members.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("i")), members.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("j"))
    across = skew_join(skew_join(a, pairs, ["cls_a"]), b, ["cls_b"]).select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    mine = members.join(copies, "cls", "left_semi")
    equal = skew_join(mine.select("cls", F.col("doc_id").alias("doc_id_a")), mine.select("cls", F.col("doc_id").alias("doc_id_b")), ["cls"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return across.unionByName(equal)


def stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, n_chars: the maximal runs of text of which every stretch of the length recurs in another document."""
    marked, members = _shared_windows(docs, length)
    every = windows(marked, length)
    shared = cut(every.groupBy("h1", "h2").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h1", "h2", "n"))
    at = skew_join(every, shared.select("h1", "h2"), ["h1", "h2"], hot=hot_of(shared, ["h1", "h2"])).groupBy("cls").agg(F.sort_array(F.collect_set("pos")).alias("at"))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("n_chars", T.LongType())])))
    def runs(positions: pd.Series) -> pd.Series:
        def one(at) -> list[dict]:
            at = np.asarray(at, np.int64)
            cuts = np.nonzero(np.diff(at) > length)[0]
            first, last = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
            return [{"start": int(f), "n_chars": int(z - f + length)} for f, z in zip(first, last, strict=True)]

        return positions.map(one)

    partial = at.select("cls", F.explode(runs("at")).alias("r")).select("cls", "r.start", "r.n_chars")
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    whole = docs.select(F.col("doc_id").alias("cls"), F.length("text").cast("bigint").alias("n_chars")).join(copies, "cls", "left_semi").distinct().select("cls", F.lit(0).cast("bigint").alias("start"), "n_chars")
    per_class = partial.join(copies, "cls", "left_anti").unionByName(whole)
    return skew_join(members, per_class, ["cls"]).select("doc_id", "start", "n_chars")


def coverage(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_part of every document."""
    shared = stretches(docs, length).groupBy("doc_id").agg(F.sum("n_chars").alias("shared_chars"))
    sizes = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    part = F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 4)).otherwise(0.0)
    return sizes.join(shared, "doc_id", "left").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), part.alias("shared_part"))
