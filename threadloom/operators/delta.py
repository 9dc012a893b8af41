"""Live changes of whole threads on top of a base, and what is kept up to date without a rebuild.

A delta is two tables: documents, and tombstones (thread_id, deleted_at). All operators take tables and return tables; nothing
is changed in place. Null thread ids match nothing and stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import members, overlay, search


def replace_threads(docs: DataFrame, tombstones: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and tombstones after the threads in ``changed`` (documents) came again: all their documents are replaced, and
    they are no longer deleted. A thread that comes twice in ``changed`` must come whole."""
    ids = changed.select("thread_id").where("thread_id IS NOT NULL").distinct()
    kept = docs.join(ids, "thread_id", "left_anti").select(*docs.columns)
    return kept.unionByName(changed.select(*docs.columns)), tombstones.join(ids, "thread_id", "left_anti")


def delete_threads(docs: DataFrame, tombstones: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and tombstones after the threads in ``gone`` (thread_id, deleted_at) were deleted; the latest time of each counts."""
    both = tombstones.select("thread_id", "deleted_at").unionByName(gone.select("thread_id", "deleted_at"))
    dead = both.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.max("deleted_at").alias("deleted_at"))
    return docs.join(gone.select("thread_id"), "thread_id", "left_anti").select(*docs.columns), dead


def thread_ids_since(docs: DataFrame, cutoff) -> DataFrame:
    """thread_id of every thread with a document at or after ``cutoff``."""
    return docs.groupBy("thread_id").agg(F.max("created_at").alias("_last")).where(F.col("_last") >= F.lit(cutoff)).select("thread_id")


def maintain_postings(posts: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings after some documents changed (``changed``: documents) and some went (``removed``: doc_key). Only the changed documents
    are read again."""
    stale = changed.select("doc_key").unionByName(removed.select("doc_key")).distinct()
    fresh = search.postings(changed.join(removed.select("doc_key"), "doc_key", "left_anti"))
    return posts.join(stale, "doc_key", "left_anti").select(*fresh.columns).unionByName(fresh)


def maintain_lexicon(lexicon: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """The lexicon after postings went (``gone``) and came (``fresh``): the counts of their terms move, terms without documents go."""
    step = gone.select("field", "term", F.lit(-1).alias("by")).unionByName(fresh.select("field", "term", F.lit(1).alias("by"))).groupBy("field", "term").agg(F.sum("by").alias("by"))
    both = lexicon.select("field", "term", "df").join(step, ["field", "term"], "full")
    counted = both.select("field", "term", (F.coalesce("df", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("df")).where("df > 0")
    return counted.withColumn("stop", F.col("term").isin(*X.STOP_WORDS))


def search_both(base: DataFrame, base_posts: DataFrame, delta: DataFrame, delta_posts: DataFrame, tombstones: DataFrame, query: str, **options) -> DataFrame:
    """Hits of a query over two indexes, each ranked by its own counts. Base documents that the delta has too, and those of deleted threads,
    are left out; of a doc_key the best score stays."""
    own = search.search(base, query, posts=base_posts, hidden=delta.select("doc_key"), **options)
    hits = own.join(tombstones.select("thread_id").distinct(), "thread_id", "left_anti").select(*own.columns)
    both = hits.unionByName(search.search(delta, query, posts=delta_posts, **options))
    rest = [c for c in both.columns if c != "doc_key"]
    return both.groupBy("doc_key").agg(F.max_by(F.struct(*rest), F.struct("score", "created_at")).alias("x")).select("doc_key", *[f"x.{c}" for c in rest])


def update_members(stats: DataFrame, before: DataFrame, after: DataFrame, threads: DataFrame) -> DataFrame:
    """Member statistics after some threads changed: only members who write, or wrote, in one of them are counted again.

    before, after: all documents; threads: thread_id of the changed ones."""
    key = X.identity_key("username")
    there = lambda docs: docs.join(threads.select("thread_id").distinct(), "thread_id", "left_semi").select(key.alias("member"))
    touched = there(before).unionByName(there(after)).distinct()
    again = members.member_stats(after.withColumn("member", key).join(touched, "member", "left_semi").drop("member"))
    return stats.join(touched, "member", "left_anti").select(*again.columns).unionByName(again)


def update_by_thread(model: DataFrame, after: DataFrame, threads: DataFrame, recompute) -> DataFrame:
    """A model with a thread_id, after some threads changed: their rows are computed again by ``recompute`` from their
    documents, all others stay. Threads without documents lose their rows."""
    ids = threads.select("thread_id").distinct()
    again = recompute(after.join(ids, "thread_id", "left_semi").select(*after.columns))
    return model.join(ids, "thread_id", "left_anti").select(*again.columns).unionByName(again)


def backfill(old: DataFrame, watermark, now: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a delta needs when a base with ``watermark`` takes the place of an older index: the documents of threads of the older
    index that had a document after the watermark, and the tombstones of threads that the older index has and ``now`` has not."""
    newer = thread_ids_since(old, watermark)
    gone = overlay.removed(now, old, "thread_id").where("thread_id IS NOT NULL").select("thread_id", F.lit(watermark).alias("deleted_at"))
    both = tombstones.select("thread_id", "deleted_at").unionByName(gone).groupBy("thread_id").agg(F.max("deleted_at").alias("deleted_at"))
    return old.join(newer, "thread_id", "left_semi").join(both.select("thread_id"), "thread_id", "left_anti").select(*old.columns), both
