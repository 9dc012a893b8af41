"""Scoring of token sequences: Dirichlet-smoothed log-odds, maximal scoring segments and their calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from .lookalike import Rewriter

# Digits and signs written in place of letters inside words.
LEET = str.maketrans("013457@$!", "oieastasi")
MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?[a-zA-Z]+\]|&[a-z]+;")
SPACED = re.compile(r"(?<![\w])(?:\w[ .*_-]){2,}\w(?![\w])")
PIECE = re.compile(r"[^\s\w@$!]|[\w@$!'’*]+")
RUNS = re.compile(r"(.)\1{2,}")
MIXED = re.compile(r"(?=.*[a-z])(?=.*[013457@$!])[a-z013457@$!]+$")


def tokens(text: str | None, rewrite: Rewriter) -> list[str]:
    """Words in lower case, with disguises undone: look-alikes, spaced-out letters, digits for letters, drawn-out letters."""
    if not text:
        return []
    if not text.isascii():
        text = rewrite(text)
    text = MARKUP.sub(" ", text).lower()
    text = SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]) if re.search("[a-z]", m[0]) else m[0], text)
    out = []
    for t in PIECE.findall(text):
        if t[0] == "@":
            out.append("@handle")
            continue
        if not t.isalpha():
            bare = t.strip("!'’*")
            if bare.isdigit():
                out.append("0")
                continue
            if MIXED.match(bare) and sum(c.isalpha() for c in bare) * 2 >= len(bare):
                bare = bare.translate(LEET)
            t = bare or t[:1]
        if len(t) > 2:
            t = RUNS.sub(r"\1", t)
        if t.isalnum() or "'" in t or ord(t[0]) > 0x2000:
            out.append(t)
    return out


def grams(words: list[str], begin: int = 0, end: int | None = None) -> list[str]:
    """All runs of one to three words that end at a word from ``begin`` to ``end``, each joined by blanks; a text begins with a mark."""
    w, out = ["^", *words], []
    for i in range(begin + 1, (len(words) if end is None else end) + 1):
        pair = f"{w[i - 1]} {w[i]}"
        out += (w[i], pair)
        if i > 1:
            out.append(f"{w[i - 2]} {pair}")
    return out


def before(gram: str) -> str:
    """The context of a run: all but its last word."""
    return gram.rpartition(" ")[0]


class Sample:
    """A reviewed text: its label, its words, the part that is read as its passage, and whether the fit uses it."""

    __slots__ = ("label", "words", "fold", "begin", "end", "kept")

    def __init__(self, label: str, words: list[str], fold: int) -> None:
        self.label, self.words, self.fold, self.begin, self.end, self.kept = label, words, fold, 0, len(words), True


class LogOdds:
    """Scores of words in context for each kind of passage against all other reviewed text, in one table.

    Both sides are distributions with Dirichlet priors: that of single words is the corpus's own distribution with a weight
    of ``strength`` of the side's size, that of a word after one or two others is the distribution after the shorter
    context with a weight of ``context`` words. A word that no side knows scores ``-drift``, so that passages
    without evidence lose. Runs whose context no passage holds are left out: there the shorter run decides."""

    LOW, HIGH = -4.0, 6.0

    def __init__(self, kinds: tuple[str, ...], strength: float = 0.3, context: float = 8.0, drift: float = 0.5) -> None:
        self.kinds, self.strength, self.context, self.drift = kinds, strength, context, drift
        self.table: dict[str, tuple[float, ...]] = {}
        self.default = (-drift,) * len(kinds)

    def fit(self, counts: list[Counter], masses: list[int], corpus: dict[str, int], corpus_total: int) -> LogOdds:
        """``counts`` of runs: in harmless text, then in passages of each kind; ``masses``: their numbers of words."""
        n = len(self.kinds)
        sizes = [m for i in range(n) for m in (masses[1 + i], sum(masses) - masses[1 + i])]
        weights = [max(self.strength * m, 1.0) for m in sizes]
        held = set().union(*(c.keys() for c in counts[1:]))
        wanted = held | {g for g in counts[0] if " " not in g or before(g) in held}

        def sides(g: str) -> list[int]:
            each = [c[g] for c in counts]
            every = sum(each)
            return [x for e in each[1:] for x in (e, every - e)]

        chances: dict[str, list[float]] = {}
        for g in sorted(wanted, key=lambda g: g.count(" ")):
            if " " not in g:
                q = (corpus.get(g, 0) + 0.5) / (corpus_total + 1)
                chances[g] = [(c + w * q) / (m + w) for c, w, m in zip(sides(g), weights, sizes, strict=True)]
            else:
                shorter = g.partition(" ")[2]
                base = chances.get(shorter) or chances[shorter.rpartition(" ")[2]]
                chances[g] = [(c + self.context * p) / (m + self.context) for c, p, m in zip(sides(g), base, sides(before(g)), strict=True)]
            p = chances[g]
            self.table[g] = tuple(max(self.LOW, min(self.HIGH, math.log(p[2 * i] / p[2 * i + 1]))) - self.drift for i in range(n))
        return self

    def scores(self, words: list[str]) -> list[tuple[float, ...]]:
        """One score a word for each kind, from the longest known context."""
        get, out = self.table.get, []
        a, b = None, "^"
        for c in words:
            pair = f"{b} {c}"
            out.append((get(f"{a} {pair}") if a is not None else None) or get(pair) or get(c) or self.default)
            a, b = b, c
        return out

    def segments(self, words: list[str]) -> list[list[tuple[int, int, float]]]:
        """All maximal scoring segments (begin, end, score) of each kind."""
        rows = self.scores(words)
        if all(r is self.default for r in rows):
            return [[] for _ in self.kinds]
        return [maximal_segments(column) if max(column) > 0 else [] for column in zip(*rows, strict=True)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time, by the algorithm of Ruzzo and Tompa."""
    held: list[list] = []  # begin, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(b, e, after - before) for b, e, before, after in held]


def gumbel(maxima: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Scale and place of the extreme-value law of the best score, less the scale times the log of the length.

    Fitted by moments to the lower nine tenths, so that wrongly labelled texts do not move it."""
    if len(maxima) < 10:
        return 1.0, 0.0
    scale = 1.0
    for _ in range(20):
        x = maxima - scale * np.log(np.maximum(lengths, 1))
        keep = x[x <= np.quantile(x, 0.9)]
        new = max(0.2, 1.25 * keep.std() * math.sqrt(6) / math.pi)
        if abs(new - scale) < 1e-3:
            break
        scale = 0.5 * scale + 0.5 * new
    x = maxima - scale * np.log(np.maximum(lengths, 1))
    return scale, float(np.quantile(x, 0.5) + scale * math.log(math.log(2)))


def surprise(score: float, length: int, law: tuple[float, float]) -> float:
    """Minus the natural log of the chance of such a best score in a harmless text of this length."""
    z = excess(score, length, law)
    return z if z > 30 else -math.log(max(1e-300, -math.expm1(-math.exp(-z))))


def excess(score: float, length: int, law: tuple[float, float]) -> float:
    """The score in units of the law's scale above what a harmless text of this length is expected to reach."""
    return (score - law[1]) / law[0] - math.log(max(length, 1))


def joint_surprise(scores: list[float], length: int, law: tuple[float, float]) -> float:
    """Minus the natural log of the chance of the best passages of a text taken together.

    The chance that the r best add up to an excess of T is about exp(-T) T^(r-1) / (r! (r-1)!) (Karlin and Altschul); the r that
    is least likely counts, each further passage at the price of one half for the choice."""
    if not scores:
        return 0.0
    ranked = sorted(scores, reverse=True)
    best, total = surprise(ranked[0], length, law), 0.0
    for r, s in enumerate(ranked, 1):
        z = excess(s, length, law)
        if z <= 0:
            break
        total += z
        if r > 1:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best
