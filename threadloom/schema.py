"""The documents of a forum: thread roots and replies in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_key", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("post_id", T.LongType(), False),
    T.StructField("thread_id", T.LongType()), T.StructField("parent_post_id", T.LongType()), T.StructField("username", T.StringType(), False),
    T.StructField("title", T.StringType(), False), T.StructField("body", T.StringType(), False), T.StructField("created_at", T.TimestampNTZType()), T.StructField("board", T.StringType(), False),
])


def check_columns(df: DataFrame) -> DataFrame:
    """Refuse any column whose name mentions e-mail: addresses must not reach an index."""
    bad = [c for c in df.columns if "email" in c.casefold()]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def documents(threads: DataFrame, posts: DataFrame) -> DataFrame:
    """One row for each thread ('t:<id>') and reply ('r:<id>'), however often it was delivered.

    Missing texts are empty, a parent of 0 is none, and the time is that of the first delivery, for ``created_utc`` is not
    reliable. Rows without an id are left out."""
    text = lambda c: F.coalesce(F.min(c), F.lit(""))
    common = [text("author").alias("username"), text("title").alias("title"), text("message").alias("body"), F.min("ingested_at").alias("created_at"), F.regexp_extract(text("source_url"), r"/b/([^/?#]+)", 1).alias("board")]
    roots = threads.where("id IS NOT NULL").groupBy("id").agg(*common).select(F.concat(F.lit("t:"), "id").alias("doc_key"), F.lit("t").alias("kind"), F.col("id").alias("post_id"), F.col("id").alias("thread_id"), F.lit(None).cast("bigint").alias("parent_post_id"), "username", "title", "body", "created_at", "board")
    replies = posts.where("id IS NOT NULL").groupBy("id").agg(F.min("thread_id").alias("thread_id"), F.min(F.when(F.col("parent_id") != 0, F.col("parent_id"))).alias("parent_post_id"), *common)
    replies = replies.select(F.concat(F.lit("r:"), "id").alias("doc_key"), F.lit("r").alias("kind"), F.col("id").alias("post_id"), "thread_id", "parent_post_id", "username", "title", "body", "created_at", "board")
    return check_columns(roots.unionByName(replies))
