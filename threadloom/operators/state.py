"""Keyed state of a reader: read marks, saved and muted threads, bounded histories. State in, state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """A hash of the content that makes a record unread when it changes."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def merge_read_state(prior: DataFrame | None, current: DataFrame) -> DataFrame:
    """doc_key, thread_id, current_fp, read_fp, source. The first run marks everything as read; later, new keys are unread, changed
    ones become unread, keys no longer present are dropped unless they were shown ('presented')."""
    if prior is None:
        return current.select("doc_key", "thread_id", F.col("fp").alias("current_fp"), F.col("fp").alias("read_fp"), F.lit("activity").alias("source"))
    old = prior.select("doc_key", F.col("thread_id").alias("_t"), F.col("current_fp").alias("_c"), F.col("read_fp").alias("_r"), F.col("source").alias("_s"))
    both = current.select("doc_key", "thread_id", "fp").join(old, "doc_key", "full")
    kept = F.col("fp").isNotNull() | (F.col("_s") == "presented")
    return both.where(kept).select("doc_key", F.coalesce("thread_id", "_t").alias("thread_id"), F.coalesce("fp", "_c").alias("current_fp"), F.col("_r").alias("read_fp"), F.when(F.col("fp").isNotNull(), "activity").otherwise(F.col("_s")).alias("source"))


def mark_read(state: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Everything, or the rows with one of the keys, becomes read."""
    if keys is None:
        return state.withColumn("read_fp", F.col("current_fp"))
    hit = state.join(keys.select("doc_key").distinct().withColumn("_hit", F.lit(True)), "doc_key", "left")
    return hit.withColumn("read_fp", F.when(F.col("_hit"), F.col("current_fp")).otherwise(F.col("read_fp"))).drop("_hit")


def mark_all_unread(state: DataFrame) -> DataFrame:
    return state.withColumn("read_fp", F.lit(None).cast("string"))


def unread_summary(state: DataFrame) -> DataFrame:
    """thread_id, n_unread, n_total."""
    unread = ~F.col("read_fp").eqNullSafe(F.col("current_fp"))
    return state.groupBy("thread_id").agg(F.count_if(unread).alias("n_unread"), F.count(F.lit(1)).alias("n_total"))


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order (a bounded history)."""
    return df.orderBy(*order).limit(n)


def newest_per_key(df: DataFrame, key: str, n: int, *order: Column, salts: int = 16) -> DataFrame:
    """The first n rows of each key; a first cut in salted parts keeps a hot key out of a single task. ``order`` must be total."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_salt", "_r")


def expire(df: DataFrame, at: str, now, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days; rows of the future are dropped too."""
    return df.where((F.col(at) <= F.lit(now)) & (F.col(at) >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")))


def toggle(state: DataFrame, toggles: DataFrame) -> DataFrame:
    """Saved or muted threads after a batch of toggles (thread_id, at): an even number leaves a key as it is, an odd number
    removes or adds it; a kept key keeps its time, an added one has that of its last toggle."""
    t = toggles.groupBy("thread_id").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"), F.max("at").alias("toggled_at"))
    both = state.select("thread_id", F.col("at").alias("was_at")).join(t, "thread_id", "full")
    had, odd = F.col("was_at").isNotNull(), F.coalesce("odd", F.lit(False))
    return both.where(had != odd).select("thread_id", F.coalesce("was_at", "toggled_at").alias("at"))


def reconcile_notifications(prior: DataFrame | None, candidates: DataFrame, most: int = 1000) -> DataFrame:
    """doc_key, created_at, read, dismissed: on the first run candidates are taken as read and dismissed; later only new keys are
    added, unread. The newest ``most`` stay."""
    if prior is None:
        out = candidates.select("doc_key", "created_at", F.lit(True).alias("read"), F.lit(True).alias("dismissed"))
    else:
        fresh = candidates.join(prior.select("doc_key"), "doc_key", "left_anti").select("doc_key", "created_at", F.lit(False).alias("read"), F.lit(False).alias("dismissed"))
        out = prior.unionByName(fresh)
    return out.orderBy(F.desc("created_at"), F.desc("doc_key")).limit(most)


def last_write_wins(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key (ties: the largest other columns)."""
    rest = [c for c in df.columns if c not in (key, at)]
    return df.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("x")).select(key, f"x.{at}", *[f"x.{c}" for c in rest])


def is_unread() -> Column:
    return ~F.col("read_fp").eqNullSafe(F.col("current_fp"))


def unread_list(state: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_key, thread_id, created_at of every unread document that is there, the newest first."""
    return state.where(is_unread()).select("doc_key").join(docs.select("doc_key", "thread_id", "created_at"), "doc_key").orderBy(F.desc("created_at"), F.desc("doc_key"))


def first_unread(state: DataFrame, docs: DataFrame) -> DataFrame:
    """thread_id, first_unread, n_unread: the oldest unread document of each thread that has any (ties: the smallest key)."""
    own = state.where(is_unread()).select("doc_key").join(docs.select("doc_key", "thread_id", "created_at"), "doc_key")
    return own.groupBy("thread_id").agg(F.min(F.struct("created_at", "doc_key")).alias("x"), F.count(F.lit(1)).alias("n_unread")).select("thread_id", F.col("x.doc_key").alias("first_unread"), "n_unread")


def unread_totals(state: DataFrame) -> DataFrame:
    """n_unread, n_threads with any, n_total over everything."""
    t = F.when(is_unread(), F.col("thread_id"))
    return state.agg(F.count_if(is_unread()).alias("n_unread"), F.count_distinct(t).alias("n_threads"), F.count(F.lit(1)).alias("n_total"))


def thread_list(kept: DataFrame, rollup: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Saved or muted threads (thread_id, at), the latest first, with title, reply_count, last_post_at, n_unread and ``missing``
    where the thread itself is not there (any more)."""
    own = kept.select("thread_id", "at").join(rollup.select("thread_id", "title", "reply_count", "last_post_at", F.lit(True).alias("_there")), "thread_id", "left")
    unread = own.withColumn("n_unread", F.lit(0).cast("bigint")) if state is None else own.join(unread_summary(state).select("thread_id", "n_unread"), "thread_id", "left")
    return unread.select("thread_id", "at", "title", "reply_count", "last_post_at", F.coalesce("n_unread", F.lit(0)).alias("n_unread"), F.col("_there").isNull().alias("missing")).orderBy(F.desc("at"), F.desc("thread_id"))


def present(state: DataFrame, shown: DataFrame, most: int = 1000) -> DataFrame:
    """Read marks after documents were shown (doc_key, thread_id, fp; at most ``most``, more are refused): each is read as it is now, and stays
    in the state even where it is not among the current ones later."""
    if shown.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents cannot be shown at once")
    now = shown.groupBy("doc_key").agg(F.min("thread_id").alias("thread_id"), F.min("fp").alias("fp"))
    kept = state.join(now.select("doc_key"), "doc_key", "left_anti").select("doc_key", "thread_id", "current_fp", "read_fp", "source")
    return kept.unionByName(now.select("doc_key", "thread_id", F.col("fp").alias("current_fp"), F.col("fp").alias("read_fp"), F.lit("presented").alias("source")))


def bounded(state: DataFrame, docs: DataFrame, most: int = 5000) -> DataFrame:
    """Read marks of the ``most`` newest documents; marks of documents that are not there go first. A reader's state, not a corpus."""
    at = state.join(docs.select("doc_key", "created_at"), "doc_key", "left")
    return at.orderBy(F.desc_nulls_last("created_at"), F.desc("doc_key")).limit(most).select(*state.columns)
