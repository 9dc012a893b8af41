"""Visually identical text with different characters (problem 3).

Look-alike classes are the transitive closure, by union-find, over code points and short strings: letters of other scripts,
full-width and font forms, ligatures, blanks, invisible characters (the class of the empty string) and combining sequences
with their composed letters. The representative of a class is its most frequent member in the corpus (a string counts as
its rarest code point; ties go to the shorter, then the smaller one). Texts are rewritten by one automaton over all members,
leftmost-longest, pass after pass until nothing changes, for a rewritten base letter may form a new combining sequence. Should
passes ever lead back to an earlier form, the smallest form of that round is taken, so that the end is the same from each of them.

Nulls stay null and match nothing. Empty texts and texts of invisible characters alone look alike. Line ends are blanks.
Repeated rows count once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut, skew_join
from .glyphs import base_pairs

#: Fewer rows than this make no hot key.
HOT = 10_000


class Union:
    """Union-find over strings, with path halving."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@functools.lru_cache(maxsize=1)
def classes() -> tuple[tuple[str, ...], ...]:
    """Every look-alike class with more than one member."""
    sets = Union()
    for form, plain in base_pairs():
        sets.join(form, plain)
        parts = unicodedata.normalize("NFD", form)
        if len(parts) > 1:
            sets.join(form, parts)
    composed = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1:
            sets.join(chr(code), parts)
            inner = unicodedata.normalize("NFC", parts[:-1])
            if len(inner) == 1:
                sets.join(chr(code), inner + parts[-1])
                composed.append((chr(code), inner, parts[-1]))
    # look-alike bases with the same mark look alike, composed or not; a class that grows may be the base of another
    known = None
    while known != (known := (len(sets.up), sum(sets.find(x) == x for x in list(sets.up)))):
        members: dict[str, list[str]] = {}
        for x in sorted(sets.up):
            if x and all(map(unicodedata.combining, x[1:])):
                members.setdefault(sets.find(x), []).append(x)
        for form, inner, mark in composed:
            for x in members.get(sets.find(inner), ()):
                sets.join(form, x + mark)
                sets.join(form, unicodedata.normalize("NFC", x + mark))
    groups: dict[str, list[str]] = {}
    for x in sorted(sets.up):
        groups.setdefault(sets.find(x), []).append(x)
    return tuple(tuple(g) for g in groups.values() if len(g) > 1)


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """Each member that isn't its class's representative, with the representative."""
    out: dict[str, str] = {}
    for members in classes():
        if "" in members:
            best = ""
        else:
            best = min(members, key=lambda m: (-min(counts.get(c, 0) for c in m), not m.isascii(), len(m), m))
        out |= {m: best for m in members if m != best}
    return out


def char_counts(texts: DataFrame, columns: list[str]) -> dict[str, int]:
    """How often each code point occurs in the whole columns; its size is bounded by that of Unicode."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter[str] = Counter()
        for b in batches:
            for c in columns:
                got.update("".join(b[c].dropna()))
        yield pd.DataFrame({"ch": [ord(c) for c in got], "n": list(got.values())})

    rows = texts.select(*columns).mapInPandas(count, "ch int, n bigint").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    return {chr(r.ch): r.n for r in rows}


class Rewriter:
    """Rewrites texts by a table; picklable, the automaton is built where it is used.

    The automaton reads only the stretches that can hold a member: runs of characters that tell a member, with one other character
    between or beside them, such as the base letter of a combining sequence. What a stretch becomes is remembered."""

    MOST_KNOWN = 50_000

    def __init__(self, table: dict[str, str]) -> None:
        self.table, self.machine = table, None

    def __getstate__(self) -> dict:
        return {"table": self.table, "machine": None}

    def build(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        telling: set[str] = set()
        for form, plain in self.table.items():
            self.machine.add_word(form, (len(form), plain))
            rare = [i for i, c in enumerate(form) if not c.isascii()]
            if len(form) > 1 and all(map(unicodedata.combining, form[1:])):
                telling.update(form[1:])
            elif rare and all(b - a <= 2 for a, b in zip([-1, *rare], [*rare, len(form)])):
                telling.update(form[i] for i in rare)
            else:
                telling.update(form)
        self.machine.make_automaton()
        own = "".join(re.escape(c) for c in sorted(telling) if ord(c) < 0x10000)
        beyond = "\U00010000-\U0010ffff" if any(ord(c) > 0xFFFF for c in telling) else ""  # sets beyond the first plane are slow to search
        self.stretch = re.compile(f"(?s).?[{own}{beyond}]+(?:.[{own}{beyond}]+)*.?") if telling else re.compile(r"(?!)")
        self.known: dict[str, str] = {}

    def once(self, text: str) -> str:
        if self.machine is None:
            self.build()
        return self.stretch.sub(self._stretch, text)

    def _stretch(self, found: re.Match) -> str:
        text = found[0]
        known = self.known.get(text)
        if known is None:
            out, at = [], 0
            for end, (length, plain) in self.machine.iter_long(text):
                out += (text[at : end + 1 - length], plain)
                at = end + 1
            known = "".join(out) + text[at:]
            if len(self.known) >= self.MOST_KNOWN:
                self.known.clear()
            self.known[text] = known
        return known

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        passed = [text]
        while True:
            new = self.once(text)
            if not new.isascii():
                new = unicodedata.normalize("NFC", new)
            if new == text:
                return text
            if new in passed:
                return min(passed[passed.index(new) :])
            passed.append(new)
            text = new


def rewriter(texts: DataFrame, columns: list[str]) -> Rewriter:
    return Rewriter(rewrites(char_counts(texts, columns)))


def plain_rewriter() -> Rewriter:
    """The rewriter with ASCII representatives, for operators that need one form whatever the corpus."""
    return Rewriter(rewrites({chr(c): 1 for c in range(32, 127)}))


def udf_of(rewrite: Rewriter):
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(rewrite, na_action="ignore")

    return apply


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each of ``columns`` in the one consistent form; all other columns stay."""
    apply = udf_of(rewriter(df, columns))
    return df.withColumns({c: apply(F.col(c)) for c in columns})


def _variants(texts: DataFrame, rewrite: Rewriter) -> DataFrame:
    """key, va (hash pairs of form and text), n: the distinct texts of each form that has several."""
    apply = udf_of(rewrite)
    distinct = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    formed = cut(distinct.withColumn("form", apply("text")).select(_hash("form").alias("key"), _hash("text").alias("v"), "n"))
    several = formed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    return formed.join(several, "key", "left_semi")


def _hash(c: str):
    """128 bits of a text, as a pair of longs."""
    return F.struct(F.xxhash64(F.col(c)).alias("h1"), F.xxhash64(F.lit("salt"), F.col(c)).alias("h2"))


def pairs(texts: DataFrame, rewrite: Rewriter) -> DataFrame:
    """id_a < id_b: every two ids of (id, text) whose texts differ but look alike.

    Pairs are formed between distinct texts and expanded to ids at the end; the text with more ids comes first, so the
    join that multiplies rows repeats the smaller side only."""
    texts = texts.where(F.col("text").isNotNull()).distinct()
    variants = cut(_variants(texts, rewrite))
    size = variants.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    join = functools.partial(skew_join, least=HOT) if size.n >= HOT else lambda left, right, on: left.join(right, on)
    a, b = variants.select("key", F.col("v").alias("va"), F.col("n").alias("na")), variants.select("key", F.col("v").alias("vb"), F.col("n").alias("nb"))
    linked = join(a, b, ["key"]).where((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("va") > F.col("vb")))).select("va", "vb")
    members = cut(texts.select("id", _hash("text").alias("v")).join(variants.select("v"), "v", "left_semi"))
    first = join(members.select(F.col("id").alias("i"), F.col("v").alias("va")), linked, ["va"]).select("i", "vb")
    both = join(first, members.select(F.col("id").alias("j"), F.col("v").alias("vb")), ["vb"])
    return both.where(F.col("i") != F.col("j")).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def found(posts: DataFrame) -> DataFrame:
    """field_name, post_id_a, post_id_b; ids as in TESTDATA."""
    rewrite = rewriter(posts, ["message", "author"])
    by_message = pairs(posts.where(F.col("id").isNotNull()).select("id", F.col("message").alias("text")), rewrite)
    spellings = posts.where(F.col("author").isNotNull()).groupBy(F.col("author").alias("text")).agg(F.min("id").alias("id"))
    by_author = pairs(spellings.select("id", "text"), rewrite)
    label = lambda df, name: df.select(F.lit(name).alias("field_name"), F.col("id_a").alias("post_id_a"), F.col("id_b").alias("post_id_b"))
    return label(by_message, "message").unionByName(label(by_author, "author"))


def variants_report(posts: DataFrame) -> DataFrame:
    """form, n_spellings, n_posts of every author name that occurs in several spellings."""
    apply = udf_of(rewriter(posts, ["message", "author"]))
    rows = posts.where(F.col("author").isNotNull()).select("id", "author").distinct().groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(apply("author").alias("form")).agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_posts")).where("n_spellings > 1")
