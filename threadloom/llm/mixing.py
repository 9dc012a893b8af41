"""Mixing sources to target weights (problem 8).

Documents are counted in tokens of a public tokenizer, get a hash-random key and are laid in key order within their source:
the key range is cut into buckets, bucket sums are prefix-summed, and each bucket is summed on its own, so a source that
holds a third of all rows is spread over as many tasks as its size asks for. A source's budget is met by whole
repeats of all its documents and a prefix of the key order for the rest; the prefix ends at the last document that still
fits, so no source exceeds its budget and each misses it by less than one document.

The total is the largest one at which every source that has documents reaches its share within its cap of repeats, unless
``total_tokens`` is given; sources that cannot reach their part of a given total give all they have. Sources without
documents are reported with 0; the other shares are scaled up in proportion. Source names are compared trimmed and in lower
case: target rows that name one source in several ways count as one, with their shares together, the largest cap and the smallest spelling;
equal target rows count once. Documents without text or tokens are left out; a repeated doc_id counts once (its smallest text).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import bounded_broadcast, cut

#: About so many documents share a bucket of the key range.
BUCKET_ROWS = 20_000
#: Up to so many target sources are broadcast.
MOST_SOURCES = 10_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, column: str, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with n_tokens: the tokens of ``column`` under a byte-level BPE given as a file of ranks."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(own.encode_ordinary(t)) if t else 0)

    return docs.withColumn("n_tokens", count(F.col(column)))


def merged_targets(targets: DataFrame) -> DataFrame:
    """_name (in the form that is compared), source, target_share, max_repeats: one row for each source."""
    rows = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").distinct()
    return rows.groupBy(F.lower(F.trim("source")).alias("_name")).agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def counted(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 42) -> DataFrame:
    """doc_id, source (as in the targets), n_tokens, key of every document of a target source."""
    names = bounded_broadcast(merged_targets(targets).select("_name", F.col("source").alias("_source")), MOST_SOURCES)
    one = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("d"))
    named = one.select("doc_id", "d.text", F.lower(F.trim("d.source")).alias("_name")).join(names, "_name")
    return token_counts(named, "text", tokenizer).where("n_tokens > 0").select("doc_id", F.col("_source").alias("source"), "n_tokens", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1).alias("key"))


def budgets(sizes: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, int]:
    """Tokens to take from each source; a source's budget never exceeds its tokens times its cap of repeats."""
    having = [(s, share, cap) for s, share, cap in targets if sizes.get(s) and share and share > 0 and cap and cap > 0]
    scale = sum(share for _, share, _ in having)
    if not having:
        return {}
    total = total_tokens if total_tokens is not None else min(sizes[s] * cap * scale / share for s, share, cap in having)
    return {s: min(math.floor(total * share / scale + 1e-6), sizes[s] * cap) for s, share, cap in having}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, repeats) and the report.

    The report has, of each target source, target_share, budget_tokens, used_tokens, reached_share, n_docs, most_repeats."""
    base = cut(counted(docs, targets, tokenizer, seed))
    targets = merged_targets(targets).drop("_name")
    per_source = {r.source: (r.tokens, r.n) for r in base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.collect()]
    goal = budgets({s: t for s, (t, _) in per_source.items()}, wanted, total_tokens)
    rows = [(s, goal[s] // per_source[s][0], goal[s] % per_source[s][0]) for s in goal]
    plan = base.sparkSession.createDataFrame(rows, "source string, epochs bigint, rest bigint")
    plan = F.broadcast(plan) if len(rows) <= MOST_SOURCES else plan

    bits = min(40, max(0, math.ceil(math.log2(max([n for _, n in per_source.values()] or [1]) / BUCKET_ROWS)))) if per_source else 0
    bucket = F.shiftright("key", 63 - bits) if bits else F.lit(0).cast("bigint")
    laid = base.withColumn("bucket", bucket)
    order = Window.partitionBy("source").orderBy("bucket")
    before = laid.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size")).select("source", "bucket", (F.sum("size").over(order) - F.col("size")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = laid.withColumn("inside", inside).join(before, ["source", "bucket"])
    fits = (F.col("before") + F.col("inside") <= F.col("rest")).cast("bigint")
    chosen = summed.join(plan, "source").select("doc_id", "source", "n_tokens", (F.col("epochs") + fits).alias("repeats")).where("repeats > 0")

    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    all_used = used.agg(F.sum("used_tokens").alias("all_tokens"))
    budget = base.sparkSession.createDataFrame([(s, int(goal.get(s, 0))) for s, _, _ in wanted], "source string, budget_tokens bigint")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    report = (
        targets.join(budget, "source").join(used, "source", "left").join(F.broadcast(all_used))
        .select("source", "target_share", "max_repeats", "budget_tokens", zero("used_tokens"), F.round(F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"), zero("n_docs"), zero("most_repeats"))
    )
    return chosen, report
