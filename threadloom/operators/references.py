"""References to records that do not exist (problem 4).

Parent keys and child keys are united in one tagged long form and grouped by parent table and key, with map-side
combination, so a key held by a third of all rows costs one row a task. Groups that lack a parent, have a deleted one or
got it late are kept; only for those are the referring records looked up again, by a join that spreads hot keys.

Nulls: a null reference is none, and so is ``parent_id`` 0; records without an id are ignored. Repeated rows count once.
Empty tables give empty results. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import skew_join

FOUND = ("table_name", "field_name", "record_id", "ref_id", "state")


def references(posts: DataFrame, post_categories: DataFrame) -> DataFrame:
    """Every reference once: table_name, field_name, record_id, ref_table, ref_id, seen_at (the record's earliest)."""
    of_posts = (
        posts.where(F.col("id").isNotNull())
        .groupBy("id", "thread_id", "parent_id")
        .agg(F.min("ingested_at").alias("seen_at"))
        .select(
            F.lit("posts").alias("table_name"),
            F.col("id").alias("record_id"),
            "seen_at",
            F.explode(
                F.array(
                    F.struct(F.lit("thread_id").alias("field_name"), F.lit("threads").alias("ref_table"), F.col("thread_id").alias("ref_id")),
                    F.struct(F.lit("parent_id").alias("field_name"), F.lit("posts").alias("ref_table"), F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("ref_id")),
                )
            ).alias("r"),
        )
        .select("table_name", "r.field_name", "record_id", "r.ref_table", "r.ref_id", "seen_at")
    )
    of_categories = (
        post_categories.where(F.col("post_id").isNotNull())
        .groupBy("post_id")
        .agg(F.min("ingested_at").alias("seen_at"))
        .select(F.lit("post_categories").alias("table_name"), F.lit("post_id").alias("field_name"), F.col("post_id").alias("record_id"), F.lit("posts").alias("ref_table"), F.col("post_id").alias("ref_id"), "seen_at")
    )
    return of_posts.unionByName(of_categories).where(F.col("ref_id").isNotNull())


def key_states(refs: DataFrame, posts: DataFrame, threads: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row for each referenced key that is deleted, missing or late: ref_table, ref_id, key_state, parent_at."""
    no_time = F.lit(None).cast(dict(posts.dtypes)["ingested_at"])

    def parents(df: DataFrame, table: str) -> DataFrame:
        return df.where(F.col("id").isNotNull()).select(F.lit(table).alias("ref_table"), F.col("id").alias("ref_id"), F.col("ingested_at").alias("parent_at"), no_time.alias("gone_at"), no_time.alias("child_at"))

    gone = tombstones.where(F.col("kind").isin("t", "r") & F.col("item_id").isNotNull()).select(
        F.when(F.col("kind") == "t", "threads").otherwise("posts").alias("ref_table"), F.col("item_id").alias("ref_id"), no_time.alias("parent_at"), F.col("deleted_at").alias("gone_at"), no_time.alias("child_at")
    )
    children = refs.select("ref_table", "ref_id", no_time.alias("parent_at"), no_time.alias("gone_at"), F.col("seen_at").alias("child_at"))
    groups = (
        parents(posts, "posts")
        .unionByName(parents(threads, "threads"))
        .unionByName(gone)
        .unionByName(children)
        .groupBy("ref_table", "ref_id")
        .agg(
            F.count("parent_at").alias("parents"),
            F.min("parent_at").alias("parent_at"),
            F.max("parent_at").alias("parent_last"),
            F.count("gone_at").alias("stones"),
            F.max("gone_at").alias("gone_at"),
            F.count("child_at").alias("children"),
            F.min("child_at").alias("child_at"),
        )
    )
    alive_after = F.coalesce(F.col("parent_last") > F.col("gone_at"), F.lit(False))
    state = F.when((F.col("stones") > 0) & ~alive_after, "deleted").when(F.col("parents") == 0, "missing").when(F.col("parent_at") > F.col("child_at"), "late")
    return groups.where(F.col("children") > 0).select("ref_table", "ref_id", state.alias("key_state"), "parent_at").where(F.col("key_state").isNotNull())


def orphans(posts: DataFrame, threads: DataFrame, post_categories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Every reference whose target is deleted, missing or late, with the record's earliest time (seen_at)."""
    refs = references(posts, post_categories)
    states = key_states(refs, posts, threads, tombstones)
    held = (F.col("key_state") != "late") | (F.col("parent_at") > F.col("seen_at"))
    return skew_join(refs, states, ["ref_table", "ref_id"]).where(held).select("table_name", "field_name", "record_id", "ref_id", F.col("key_state").alias("state"), "seen_at")


def found(posts: DataFrame, threads: DataFrame, post_categories: DataFrame, tombstones: DataFrame) -> DataFrame:
    return orphans(posts, threads, post_categories, tombstones).select(*FOUND)


def report(posts: DataFrame, threads: DataFrame, post_categories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, month of the record's first ingestion and state."""
    return (
        orphans(posts, threads, post_categories, tombstones)
        .groupBy("table_name", "field_name", F.date_format("seen_at", "yyyy-MM").alias("month"), "state")
        .agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_keys"))
    )
