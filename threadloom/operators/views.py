"""Lists of threads: roll-ups, sort orders, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def thread_rollup(docs: DataFrame) -> DataFrame:
    """thread_id, title, username, body, created_at, reply_count, last_post_at of every root."""
    replies = docs.where("kind = 'r'").groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    roots = docs.where("kind = 't'").select("thread_id", "title", "username", "body", "created_at")
    return roots.join(replies, "thread_id", "left").select("thread_id", "title", "username", "body", "created_at", F.coalesce("n", F.lit(0)).alias("reply_count"), F.greatest("created_at", "last").alias("last_post_at"))


def unblocked(df: DataFrame, names: list[str]) -> DataFrame:
    from .conversation import blocked_keys

    keys = blocked_keys(names)
    return df.where(~X.identity_key("username").isin(*keys)) if keys else df


def unmuted(df: DataFrame, muted: DataFrame) -> DataFrame:
    return df.join(muted.select("thread_id"), "thread_id", "left_anti")


SORTS = {
    "date": lambda: [F.asc("last_post_at"), F.asc("thread_id")],
    "datedesc": lambda: [F.desc("last_post_at"), F.desc("thread_id")],
    "postedby": lambda: [F.asc(X.identity_key("username")), F.asc("thread_id")],
    "postedbydesc": lambda: [F.desc(X.identity_key("username")), F.desc("thread_id")],
    "subject": lambda: [F.asc(X.identity_key("title")), F.asc("thread_id")],
    "subjectdesc": lambda: [F.desc(X.identity_key("title")), F.desc("thread_id")],
    "size": lambda: [F.asc("reply_count"), F.asc("thread_id")],
    "sizedesc": lambda: [F.desc("reply_count"), F.desc("thread_id")],
}


def classic(rollup: DataFrame, sort: str = "datedesc", limit: int = 25, offset: int = 0, pinned: int | None = None) -> DataFrame:
    """One page of the thread list; a pinned thread comes first in the order by newest post only."""
    keys = SORTS.get(sort, SORTS["datedesc"])()
    if pinned is not None and sort == "datedesc":
        keys = [F.desc(F.col("thread_id") == pinned), *keys]
    return rollup.orderBy(*keys).offset(max(0, offset)).limit(max(1, min(100, limit)))


def unloved(rollup: DataFrame) -> DataFrame:
    return rollup.where("reply_count = 0")


def archived(rollup: DataFrame, count: int = 999) -> DataFrame:
    """Threads with exactly so many replies."""
    return rollup.where(F.col("reply_count") == count)


def backfill(rollup: DataFrame, seed: str, count: int, exclude: list[int] | None = None) -> DataFrame:
    """A repeatable sample of unanswered threads: a circular walk over them by id from a place that the seed gives."""
    own = unloved(rollup).select("thread_id")
    if exclude:
        own = own.where(~F.col("thread_id").isin(*exclude))
    n = own.count()
    start = X.fnv1a(seed) % n if n else 0
    # two runs by id, each with a limit, replace a global row number
    ids = own.orderBy("thread_id")
    tail, head = ids.offset(start).limit(count), ids.limit(min(start, count))
    placed = tail.withColumn("turn", F.lit(0)).unionByName(head.withColumn("turn", F.lit(1)))
    return placed.orderBy("turn", "thread_id").limit(max(0, min(count, 100))).select("thread_id")


def longest_replies(docs: DataFrame, n: int = 8, least: int = 40) -> DataFrame:
    """thread_id, rank, post_id, size: the longest replies of each thread.

    A first cut within salted parts of a thread keeps a hot thread out of a single task."""
    own = docs.where(F.col("kind") == "r").select("thread_id", "post_id", F.length("body").alias("size")).where(F.col("size") > least)
    part = own.withColumn("salt", F.pmod(F.xxhash64("post_id"), F.lit(32)))
    order = [F.desc("size"), F.asc("post_id")]
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("thread_id", "salt").orderBy(*order))).where(F.col("r") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("thread_id").orderBy(*order))).where(F.col("rank") <= n).select("thread_id", "rank", "post_id", "size")


def fit_rows(heights: list[float], room: float, most: int = 25) -> int:
    """How many rows fit: the known heights first, then rows of their median height."""
    if not heights:
        return 1
    ordered = sorted(heights)
    middle = ordered[len(ordered) // 2]
    used, n = 0.0, 0
    while n < most:
        height = heights[n] if n < len(heights) else middle
        if used + height > room:
            break
        used += height
        n += 1
    return max(1, n)


def page_for_anchor(page: int, old_rows: int, new_rows: int) -> int:
    """The page that shows the first row of ``page`` after the number of rows a page has changed."""
    return (page - 1) * old_rows // new_rows + 1
