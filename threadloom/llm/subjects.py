"""Subject area of each document (problem 5), by bisecting k-means over document vectors and leaf mixtures.

Terms (words and pairs of words) are weighted by how unevenly they are spread over the leaf categories of the taxonomy, in clean
examples and in noisy labels; terms of every subject alike weigh nothing. Each text, title and opening message, becomes
a normalised vector over those terms, and all vectors are clustered by bisecting k-means. A cluster leaf is labelled by its
discriminative terms: its mixture of categories is that of the terms in which its centre stands out against the mean. Each sentence of
a text falls into the leaves whose centres are like it, in proportion to a power of the likeness, and brings their mixtures;
what categories a term speaks for enters by the leaves alone. A text's subjects are read off the sum over its sentences: the main
subject, and every other that has more than one passing sentence. A title counts where the message agrees with it or has no
subject of its own.

Null and empty texts have no subject. Repeated rows count once; of several texts of a thread the smallest is taken. Labels
are compared trimmed and in lower case; ids that are no leaf of the taxonomy are ignored. Without terms there are no subjects.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut
from .leakage import MARKUP
from .lookalike import plain_rewriter

#: Leaves for each category; every term with so many texts and that weight counts; the power of the likeness of a sentence and a leaf.
LEAVES_EACH, LEAST_TERM, LEAST_WEIGHT, SMOOTHING, SHARPNESS = 4, 6, 0.42, 3.0, 2.0
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|<br\s*/?>|</p>|\[/quote\]", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Openings of a sentence that adds something beside the subject.
ASIDE = re.compile(r"^\W*(?:ps|p\.s\.|btw|by the way|off topic|unrelated)\b", re.I)


def sentences(text: str | None, rewrite) -> list[list[str]]:
    """The terms of each sentence: words and neighbouring pairs, in lower case and one form."""
    if not text:
        return []
    if not text.isascii():
        text = rewrite(text)
    text = re.sub(r"&#?\w+;", " ", text)
    out = []
    for s in SENTENCE.split(text):
        if ASIDE.match(MARKUP.sub(" ", s)):
            out.append(["(aside)"])
            continue
        w = WORD.findall(MARKUP.sub(" ", s).lower())
        if w:
            out.append([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    return out


def leaf_ids(taxonomy: DataFrame) -> list[str]:
    """The leaves: ids with a parent that are no parents themselves. Sized by the taxonomy."""
    rows = taxonomy.select("category_id", "parent_id").distinct().collect()
    parents = {r.parent_id for r in rows}
    return sorted({r.category_id for r in rows if r.category_id and r.parent_id and r.category_id not in parents})


def term_table(texts: DataFrame, labels: DataFrame, examples: DataFrame, leaves: list[str]) -> pd.DataFrame:
    """term, weight and the chance of each leaf (array p) for the terms that discriminate between leaves.

    Counted over all labelled texts and examples: an example counts four times and a manual label twice as much as another."""
    rewrite = plain_rewriter()
    clean = F.lower(F.trim("category_id"))
    own = labels.select("thread_id", clean.alias("category_id"), F.when(F.col("source") == "manual", 2.0).otherwise(1.0).alias("w")).where(F.col("category_id").isin(leaves))
    own = own.groupBy("thread_id", "category_id").agg(F.max("w").alias("w"))
    given = texts.join(own, "thread_id").select("title", "message", "category_id", "w")
    shown = examples.select("title", "message", clean.alias("category_id"), F.lit(4.0).alias("w")).where(F.col("category_id").isin(leaves))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[tuple[str, str], list[float]] = {}
        for b in batches:
            for title, message, c, w in zip(b["title"], b["message"], b["category_id"], b["w"], strict=True):
                for t in {t for s in (*sentences(title, rewrite), *sentences(message, rewrite)) for t in s}:
                    x = got.setdefault((t, c), [0.0, 0.0])
                    x[0] += w
                    x[1] += 1
        yield pd.DataFrame([(*k, *v) for k, v in got.items()], columns=["term", "category_id", "w", "n"])

    counts = given.unionByName(shown).mapInPandas(count, "term string, category_id string, w double, n double").groupBy("term", "category_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    k = len(leaves)
    frequent = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("w").alias("top"), F.map_from_entries(F.collect_list(F.struct("category_id", "w"))).alias("by")).where((F.col("n") >= LEAST_TERM) & (F.col("top") >= 0.18 * F.col("w")))
    # the weight is known before any term is gathered (but for rounding, so that it is held against the bound again below)
    share = lambda w: (w + SMOOTHING / k) / (F.col("w") + SMOOTHING)
    plogp = lambda p: p * F.log(p)
    seen = F.aggregate(F.map_values("by"), F.lit(0.0), lambda total, w: total + plogp(share(w)))
    weight = F.lit(1.0) + (seen + (F.lit(k) - F.size("by")) * plogp(share(F.lit(0.0)))) / F.lit(math.log(k) if k > 1 else 1.0)
    rows = frequent.where(weight >= LEAST_WEIGHT - 1e-9).orderBy(F.desc("n"), "term").select("term", "n", "by").collect()
    out = []
    for r in rows:
        p = np.array([r["by"].get(c, 0.0) for c in leaves])
        p = (p + SMOOTHING / k) / (p.sum() + SMOOTHING)
        weight = 1 + float((p * np.log(p)).sum()) / math.log(k)
        if weight >= LEAST_WEIGHT:
            out.append((r.term, r.n, weight, p))
    return pd.DataFrame(out, columns=["term", "n", "weight", "p"])


def vectors(texts: DataFrame, terms: pd.DataFrame) -> DataFrame:
    """thread_id, title, message: the term numbers of each of their sentences, in order."""
    rewrite = plain_rewriter()
    held = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms["term"])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = held.value.get
        numbers = lambda text: [sorted({i for t in s if (i := get(t)) is not None}) for s in sentences(text, rewrite)]
        for b in batches:
            yield pd.DataFrame({"thread_id": b["thread_id"], "title": b["title"].map(numbers), "message": b["message"].map(numbers)})

    return texts.mapInPandas(run, "thread_id bigint, title array<array<int>>, message array<array<int>>")


def cluster(points: DataFrame, terms: pd.DataFrame, leaves: int, seed: int = 11) -> np.ndarray:
    """Centres of the leaves of bisecting k-means over all document vectors; equal ones are counted once, with their number as weight."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    at = F.array_sort(F.flatten(F.concat("title", "message")))
    distinct = points.select(at.alias("at")).where(F.size("at") > 0).groupBy("at").agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("names", F.col("at").cast("array<string>"))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(terms))], inputCol="names", outputCol="counts").transform(distinct)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(terms["weight"].to_list()), inputCol="counts", outputCol="scaled").transform(counted)
    data = cut(Normalizer(inputCol="scaled", outputCol="features").transform(scaled).select("w", "features"))
    model = BisectingKMeans(k=leaves, maxIter=6, seed=seed, weightCol="w", minDivisibleClusterSize=2.0).fit(data)
    return np.array(model.clusterCenters())


def mixtures(centres: np.ndarray, terms: pd.DataFrame) -> np.ndarray:
    """The mixture of categories of each leaf, from the terms of its centre that stand out against the mean centre."""
    p = np.stack(terms["p"].to_list())
    outstanding = np.maximum(centres - centres.mean(0), 0)
    mix = outstanding @ (p**2 / (p**2).sum(1, keepdims=True))
    return mix / np.maximum(mix.sum(1, keepdims=True), 1e-12)


def decide(title: np.ndarray, message: list[np.ndarray], floor: float = 1.5, part: float = 0.22) -> list[int]:
    """Subjects of a text from the mixtures of its sentences (those without subject terms are left out)."""
    total = np.sum(message, axis=0) if message else np.zeros(len(title))
    if total.max(initial=0) < 0.5:
        return [int(title.argmax())] if title.max(initial=0) >= 0.5 else []
    main = int(total.argmax())
    bonus = total + np.where(total >= 0.5, np.minimum(title, 1.0) * 0.5, 0)
    main = int(bonus.argmax())
    return [main, *(int(c) for c in np.nonzero((total >= floor) & (total >= part * total.sum()))[0] if c != main)]


class LeafReader:
    """The mixture that a sentence brings: those of the leaves like it."""

    def __init__(self, weight: np.ndarray, centres: np.ndarray, mix: np.ndarray) -> None:
        self.weight, self.mix = weight, mix
        self.by_term = np.ascontiguousarray(centres.T)
        self.known: dict[tuple, np.ndarray] = {}

    def __call__(self, at) -> np.ndarray:
        key = tuple(at)
        got = self.known.get(key)
        if got is None:
            v = self.weight[list(key)]
            like = np.maximum(v @ self.by_term[list(key)], 0) ** SHARPNESS
            got = like @ self.mix
            got = got / max(got.sum(), 1e-12)
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[key] = got
        return got


def leaf_subjects(points: DataFrame, terms: pd.DataFrame, centres: np.ndarray, mix: np.ndarray, leaves: list[str]) -> DataFrame:
    """thread_id, category_id, share: the subjects of each text, from the mixtures of the leaves its sentences fall into."""
    held = points.sparkSession.sparkContext.broadcast((terms["weight"].to_numpy(), centres, mix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = LeafReader(*held.value)
        for b in batches:
            rows = []
            for i, title, message in zip(b["thread_id"], b["title"], b["message"], strict=True):
                head = np.sum([np.zeros(len(leaves)), *(read(at) for at in title if len(at))], axis=0)
                parts = [read(at) for at in message if len(at)]
                total = np.sum([head, *parts], axis=0)
                rows += [(i, leaves[c], round(float(total[c] / max(total.sum(), 1e-9)), 4)) for c in decide(head, parts)]
            yield pd.DataFrame(rows, columns=["thread_id", "category_id", "share"])

    return points.mapInPandas(run, "thread_id bigint, category_id string, share double")


def subjects(threads: DataFrame, labels: DataFrame, taxonomy: DataFrame, examples: DataFrame) -> DataFrame:
    """thread_id, category_id, share of every subject of every thread."""
    leaves = leaf_ids(taxonomy)
    texts = cut(threads.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("thread_id")).agg(F.min(F.struct("title", "message")).alias("t")).select("thread_id", "t.title", "t.message"))
    terms = term_table(texts, labels, examples, leaves) if leaves else pd.DataFrame({"term": []})
    if not len(terms):
        return threads.sparkSession.createDataFrame([], "thread_id bigint, category_id string, share double")
    points = cut(vectors(texts, terms))
    if points.where(F.exists(F.concat("title", "message"), lambda s: F.size(s) > 0)).limit(1).count() == 0:
        return threads.sparkSession.createDataFrame([], "thread_id bigint, category_id string, share double")
    centres = cluster(points, terms, LEAVES_EACH * len(leaves))
    return leaf_subjects(points, terms, centres, mixtures(centres, terms), leaves)


def found(threads: DataFrame, labels: DataFrame, taxonomy: DataFrame, examples: DataFrame) -> DataFrame:
    """thread_id, category_id; ids as in TESTDATA."""
    return subjects(threads, labels, taxonomy, examples).select("thread_id", "category_id")


def composition(threads: DataFrame, labels: DataFrame, taxonomy: DataFrame, examples: DataFrame) -> DataFrame:
    """category_id, n_threads, share of all threads (a thread with two subjects counts in both)."""
    own = subjects(threads, labels, taxonomy, examples)
    n = threads.where(F.col("id").isNotNull()).agg(F.countDistinct("id").alias("all"))
    counted = own.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_threads"))
    return counted.join(F.broadcast(n)).select("category_id", "n_threads", F.round(F.col("n_threads") / F.col("all"), 6).alias("share"))
