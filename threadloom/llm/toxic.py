"""Abusive, hateful or sexual content (problem 2), by maximum-scoring segments.

Words in context get log-odds with Dirichlet priors for each kind against all other text, from a reviewed sample with the
corpus's own word counts as the prior. Every text is scanned in linear time for all its maximal scoring segments
(Ruzzo-Tompa). Each kind's segments are calibrated by an extreme-value law, fitted on held-out harmless texts, which takes
the text's length into account; the passages of one text are then taken together by sum statistics.

Labels are noisy, and most of a harmful text is harmless. The fit therefore runs in rounds over a few folds: models of
the other folds find each text's passage and its surprise; a harmful label whose text holds no passage of that kind, and a
harmless one whose text holds a passage beyond doubt, are left out of the next round, and only the passages count
as evidence of their kind; the rest of such a text counts as nothing, lest a passage found short be kept short. The laws come from the last round's held-out scores.

The fit uses at most ``most_labelled`` reviewed texts, those with the lowest hash (a parameter); corpus counts, scores and reports
cover all texts. Null and empty texts score 0. Repeated rows count once; a record with several texts has the highest
score. Labels of records without a text are ignored. Without labels all scores are 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut
from .lookalike import plain_rewriter
from .segments import LogOdds, Sample, before, excess, grams, gumbel, joint_surprise, surprise, tokens

KINDS = ("abusive", "hateful", "sexual")
THRESHOLD = 17.0
#: How surprising a reviewed text's own passage must be, round by round, for its harmful label to be kept.
ROUNDS, FOLDS = (4.0, 8.0, 11.0), 4
SCORES = "table_name string, record_id bigint, board string, abusive double, hateful double, sexual double, passage string"


def texts_of(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """table_name, record_id, board, words: every text once, as words joined by blanks, written to the shared folder."""
    board = F.regexp_extract(F.coalesce("source_url", F.lit("")), r"/b/([^/?#]+)", 1)
    rows = [df.select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), board.alias("board"), F.col(column).alias("text")) for name, column, df in (("posts", "message", posts), ("threads", "title", threads))]
    rewrite = plain_rewriter()

    @F.pandas_udf("string")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: " ".join(tokens(t, rewrite)))

    every = rows[0].unionByName(rows[1]).where(F.col("record_id").isNotNull())
    one = every.groupBy("table_name", "record_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("board").alias("board"), F.min("text").alias("text"))
    return cut(one.select("table_name", "record_id", "board", split(F.coalesce("text", F.lit(""))).alias("words")))


def labelled(texts: DataFrame, labels: DataFrame, most: int) -> list[Sample]:
    """Reviewed texts, of the ``most`` labels with the lowest hash. A record labelled in two ways has the least label."""
    own = labels.where(F.col("label").isin("none", *KINDS) & F.col("item_id").isNotNull()).groupBy(F.when(F.col("kind") == "t", "threads").otherwise("posts").alias("table_name"), F.col("item_id").alias("record_id")).agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("table_name", "record_id"), "table_name", "record_id").limit(most)
    rows = texts.join(F.broadcast(chosen), ["table_name", "record_id"]).select("table_name", "record_id", "label", "words").collect()
    rows.sort(key=lambda r: (r.table_name, r.record_id, r.words))
    return [Sample(r.label, r.words.split(), zlib.crc32(r.words.encode()) % FOLDS) for r in rows]


def corpus_counts(texts: DataFrame, sample: list[Sample]) -> tuple[dict[str, int], int]:
    """Counts over all texts of the words of the bounded sample, and the number of all words."""
    spark = texts.sparkSession
    wanted = spark.createDataFrame(pd.DataFrame({"w": sorted({w for s in sample for w in s.words})}, dtype=object), "w string")
    every = texts.select(F.explode(F.split("words", " ")).alias("w")).where(F.col("w") != "").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(every)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.w: r.n for r in counts.join(F.broadcast(wanted), "w").collect()}, total


class Judge:
    """A fitted model with the laws of its scores."""

    def __init__(self, model: LogOdds, laws: list[tuple[float, float]]) -> None:
        self.model, self.laws = model, laws

    def passages(self, words: list[str]) -> list[list[tuple[int, int, float]]]:
        return self.model.segments(words)

    def __call__(self, words: list[str]) -> tuple[list[float], tuple[int, int]]:
        """How surprising the passages of each kind are in a harmless text, and the best passage of the most surprising kind."""
        found = self.passages(words)
        s = [joint_surprise([x[2] for x in part], len(words), law) for part, law in zip(found, self.laws, strict=True)]
        part = found[s.index(max(s))]
        return s, max(part, key=lambda x: x[2])[:2] if part else (0, 0)


def _counts(sample: list[Sample], least: int = 1) -> list[list[tuple[Counter, int]]]:
    """For each fold: counts of runs and numbers of words, in harmless text and in passages of each kind.

    Runs of several words count where they occur ``least`` times in passages. Of harmless text single words count, and longer runs that
    count in passages, or whose context does: no other is ever looked up."""
    often = Counter(g for s in sample if s.kept and s.label != "none" for g in grams(s.words, s.begin, s.end))
    held = {"", *(g for g, n in often.items() if n >= least or " " not in g)}
    out = [[Counter() for _ in range(1 + len(KINDS))] for _ in range(FOLDS)]
    masses = [[0] * (1 + len(KINDS)) for _ in range(FOLDS)]
    for s in sample:
        if not s.kept:
            continue
        mine, size = out[s.fold], masses[s.fold]
        if s.label == "none":
            mine[0].update(g for g in grams(s.words) if g in held or before(g) in held)
            size[0] += len(s.words)
            continue
        k = 1 + KINDS.index(s.label)
        mine[k].update(g for g in grams(s.words, s.begin, s.end) if g in held)
        size[k] += s.end - s.begin
    return [list(zip(c, m, strict=True)) for c, m in zip(out, masses, strict=True)]


def _model(folds: list[list[tuple[Counter, int]]], corpus: dict[str, int], total: int) -> LogOdds:
    counts, masses = [Counter() for _ in range(1 + len(KINDS))], [0] * (1 + len(KINDS))
    for fold in folds:
        for i, (c, m) in enumerate(fold):
            counts[i].update(c)
            masses[i] += m
    return LogOdds(KINDS).fit(counts, masses, corpus, total)


def fit(texts: DataFrame, labels: DataFrame, most_labelled: int = 40_000, rounds: tuple[float, ...] = ROUNDS) -> Judge:
    sample = labelled(texts, labels, most_labelled)
    flat = [(1.0, 0.0)] * len(KINDS)
    if all(s.label == "none" for s in sample):
        return Judge(LogOdds(KINDS), flat)
    return fit_sample(sample, *corpus_counts(texts, sample), rounds)


def fit_sample(sample: list[Sample], corpus: dict[str, int], total: int, rounds: tuple[float, ...] = ROUNDS) -> Judge:
    laws: list[tuple[float, float]] = []
    for least in rounds:
        folds = _counts(sample, 2)  # what occurs once tells nothing about a text that was not seen
        models = [_model(folds[:f] + folds[f + 1 :], corpus, total) for f in range(FOLDS)]
        best = [[max(part, key=lambda x: x[2], default=(0, 0, 0.0)) for part in models[s.fold].segments(s.words)] for s in sample]
        harmless = [i for i, s in enumerate(sample) if s.label == "none"]
        lengths = np.array([len(sample[i].words) for i in harmless])
        laws = [gumbel(np.array([best[i][k][2] for i in harmless]), lengths) for k in range(len(KINDS))]
        for s, own in zip(sample, best, strict=True):
            seen = [surprise(x[2], len(s.words), law) if x[2] > 0 else 0.0 for x, law in zip(own, laws, strict=True)]
            if s.label == "none":
                s.kept = max(seen) < rounds[-1]
            else:
                k = KINDS.index(s.label)
                s.kept = seen[k] > least and seen[k] == max(seen)
                s.begin, s.end = own[k][:2]
    return Judge(_model(_counts(sample), corpus, total), laws)


def scores(posts: DataFrame, threads: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """table_name, record_id, board, a score of each kind and the most harmful passage, for every text of every record.

    A score is minus the natural log of the chance that a harmless text of that length has such passages."""
    texts = texts_of(posts, threads)
    held = texts.sparkSession.sparkContext.broadcast(fit(texts, labels, **bounds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for b in batches:
            out = []
            for line in b["words"]:
                w = line.split()
                s, (begin, end) = own(w)
                out.append((*(round(x, 4) for x in s), " ".join(w[begin:end])))
            yield pd.concat([b[["table_name", "record_id", "board"]], pd.DataFrame(out, columns=[*KINDS, "passage"], index=b.index)], axis=1)

    return texts.mapInPandas(run, SCORES)


def passages(posts: DataFrame, threads: DataFrame, labels: DataFrame, least: float = THRESHOLD, **bounds) -> DataFrame:
    """table_name, record_id, harm, nth, passage, surprise: every maximal scoring passage of every text that is surprising in itself.

    nth numbers the passages of one kind of a record, in the order of its texts and words; a passage's surprise counts it alone."""
    texts = texts_of(posts, threads)
    held = texts.sparkSession.sparkContext.broadcast(fit(texts, labels, **bounds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for b in batches:
            out = []
            for table_name, record_id, line in zip(b["table_name"], b["record_id"], b["words"], strict=True):
                w = line.split()
                for kind, part, law in zip(KINDS, own.passages(w), own.laws, strict=True):
                    out += [(table_name, record_id, kind, line, begin, " ".join(w[begin:end]), round(excess(s, len(w), law), 4)) for begin, end, s in part if excess(s, len(w), law) >= least]
            yield pd.DataFrame(out, columns=["table_name", "record_id", "harm", "words", "begin", "passage", "surprise"])

    rows = texts.mapInPandas(run, "table_name string, record_id bigint, harm string, words string, begin bigint, passage string, surprise double")
    place = Window.partitionBy("table_name", "record_id", "harm").orderBy("words", "begin")
    return rows.select("table_name", "record_id", "harm", F.row_number().over(place).cast("bigint").alias("nth"), "passage", "surprise")


def harm(threshold: float = THRESHOLD):
    """The kind with the highest score, where that is over the threshold."""
    top = F.greatest(*KINDS)
    return F.when(top >= threshold, F.when(F.col("abusive") == top, "abusive").when(F.col("hateful") == top, "hateful").otherwise("sexual"))


def found(posts: DataFrame, threads: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """table_name, record_id, harm; ids as in TESTDATA."""
    judged = scores(posts, threads, labels).select("table_name", "record_id", F.greatest(*KINDS).alias("top"), harm(threshold).alias("harm")).where(F.col("harm").isNotNull())
    return judged.groupBy("table_name", "record_id").agg(F.max_by("harm", F.struct("top", "harm")).alias("harm"))


def rates(posts: DataFrame, threads: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """table_name, board, n_records and the number and rate of each kind."""
    judged = scores(posts, threads, labels).withColumn("harm", harm(threshold)).groupBy("table_name", "record_id").agg(F.min("board").alias("board"), F.max_by("harm", F.greatest(*KINDS)).alias("harm"))
    counts = [F.count_if(F.col("harm") == k).alias(f"n_{k}") for k in KINDS]
    return judged.groupBy("table_name", "board").agg(F.count(F.lit(1)).alias("n_records"), *counts).withColumn("harm_rate", F.round(sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)) / F.col("n_records"), 6))
