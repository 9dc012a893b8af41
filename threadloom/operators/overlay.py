"""An immutable base, a recent delta and tombstones read as one; and what changed between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, delta: DataFrame, tombstones: DataFrame, key: str = "thread_id") -> DataFrame:
    """Rows of the delta replace rows of the base with the same key; keys in ``tombstones`` are gone."""
    live = delta.join(tombstones.select(key), key, "left_anti")
    hidden = delta.select(key).unionByName(tombstones.select(key)).distinct()
    return base.join(hidden, key, "left_anti").unionByName(live)


def merged(base_hits: DataFrame, delta_hits: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Search hits of both sides: base hits of replaced or deleted threads are dropped, the best score of a doc_key stays."""
    gone = delta_hits.select("thread_id").unionByName(tombstones.select("thread_id")).distinct()
    both = base_hits.join(gone, "thread_id", "left_anti").unionByName(delta_hits.join(tombstones.select("thread_id"), "thread_id", "left_anti"))
    rest = [c for c in both.columns if c != "doc_key"]
    best = F.max_by(F.struct(*rest), F.struct("score", "created_at"))
    return both.groupBy("doc_key").agg(best.alias("x")).select("doc_key", *[f"x.{c}" for c in rest])


def changed(now: DataFrame, before: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Rows of ``now`` that are new or differ in a compared column (nulls equal nulls), with ``change``."""
    old = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in compared], F.lit(True).alias("_had"))
    same: Column = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = now.join(old, now[key] == old["_key"], "left")
    return joined.where(F.col("_had").isNull() | ~same).withColumn("change", F.when(F.col("_had").isNull(), "new").otherwise("edited")).select(*now.columns, "change")


def removed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys of ``before`` that are missing now."""
    return before.select(key).distinct().join(now.select(key), key, "left_anti")


def pruned(delta: DataFrame, watermark, at: str = "last_post_at") -> DataFrame:
    """The delta beyond the base's watermark; rows at or below it, or without a time, are covered by the base."""
    return delta.where(F.col(at) > F.lit(watermark))


def recent(df: DataFrame, base_watermark: Column, now: Column, hours: int = 48, at: str = "last_post_at") -> DataFrame:
    """Rows from ``hours`` before the earlier of the watermark and now."""
    return df.where(F.col(at) >= F.least(base_watermark, now) - F.expr(f"INTERVAL {hours} HOURS"))
