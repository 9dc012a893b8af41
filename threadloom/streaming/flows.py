"""Streams that keep a keyed table by merging each micro-batch, in the folder of the stream.

Tables that are merged key by key lie in buckets, and a batch rewrites only those its keys fall into (``KeyedStore``); a state that is
judged as a whole, and bounded, is written whole. A version is numbered by its batch, and a repeated batch writes the same version again, so
the result is exactly once; all but the last two versions are deleted. The state function is the batch operator itself, so stream and batch agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import overlay as O
from ..operators import state as S
from ..sources.stores import KeyedStore


Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def _writer(stream: DataFrame, store: KeyedStore, folder: str, merge: Merge, key: str | None):
    def step(batch: DataFrame, n: int) -> None:
        batch = batch.persist()

        def merged(prior: DataFrame | None) -> DataFrame:
            out = merge(prior if prior is None else prior.drop("_all"), batch)
            return out if key else out.withColumn("_all", F.lit(0))

        try:
            KeyedStore(batch.sparkSession, store.root, store.key, store.buckets).change(batch if key else batch.select(F.lit(0).alias("_all")), merged, n)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")


def _store(stream: DataFrame, folder: str, key: str | None, buckets: int) -> KeyedStore:
    return KeyedStore(stream.sparkSession, f"{folder}/state", key or "_all", buckets if key else 1)


def run(stream: DataFrame, folder: str, merge: Merge, key: str | None = None, buckets: int = 16) -> DataFrame:
    """Merge all available micro-batches into the table below ``folder`` and return it.

    With ``key`` the table is bucketed, and ``merge`` gets the rows of the buckets that the batch touches; it must give each key's
    rows from that key's rows alone. ``merge`` gets None at the very first batch only."""
    store = _store(stream, folder, key, buckets)
    _writer(stream, store, folder, merge, key).trigger(availableNow=True).start().awaitTermination()
    out = store.read()
    return merge(None, stream.sparkSession.createDataFrame([], stream.schema)) if out is None else out.drop("_all")


def keep_running(stream: DataFrame, folder: str, merge: Merge, key: str | None = None, every: str = "15 minutes", buckets: int = 16):
    """The same as a running query, which takes what has come in at most once in ``every``; stop it with ``stop()``, and start it again from
    where it was. The table is read with ``KeyedStore``."""
    return _writer(stream, _store(stream, folder, key, buckets), folder, merge, key).trigger(processingTime=every).start()


def delta_merge(stream: DataFrame, folder: str, key: str, at: str) -> DataFrame:
    """The last version of each key of a stream of row versions."""
    return run(stream, folder, lambda prior, batch: S.last_write_wins(batch if prior is None else prior.unionByName(batch), key, at), key)


def read_state(stream: DataFrame, folder: str) -> DataFrame:
    """Read marks over a stream of (doc_key, thread_id, fp, at); the first batch is taken as read."""

    def merge(prior: DataFrame | None, batch: DataFrame) -> DataFrame:
        now = S.last_write_wins(batch.select("doc_key", "at", "thread_id", "fp"), "doc_key", "at")
        if prior is not None:
            old = prior.select("doc_key", "thread_id", F.col("current_fp").alias("fp")).join(now.select("doc_key"), "doc_key", "left_anti")
            now = now.select("doc_key", "thread_id", "fp").unionByName(old)
        return S.merge_read_state(prior, now)

    return run(stream, folder, merge, "doc_key")


def notifications(stream: DataFrame, folder: str, most: int = 1000) -> DataFrame:
    """The newest notifications over a stream of candidates (doc_key, created_at); the first batch is the baseline."""
    return run(stream, folder, lambda prior, batch: S.reconcile_notifications(prior, batch.dropDuplicates(["doc_key"]), most))


def live_delta(stream: DataFrame, folder: str, at: str = "ingested_at") -> DataFrame:
    """The documents of a live delta over a stream of document versions (with ``at``): a thread that comes again replaces all its
    documents, so the versions of a thread in one batch that are older than its latest are dropped too."""

    def merge(prior: DataFrame | None, batch: DataFrame) -> DataFrame:
        every = batch if prior is None else prior.unionByName(batch)
        last = every.groupBy("thread_id").agg(F.max(at).alias("_last"))
        return every.join(last, "thread_id").where(F.col(at) == F.col("_last")).drop("_last").dropDuplicates(["doc_key"]).select(*every.columns)

    return run(stream, folder, merge, "thread_id")


def windowed_activity(stream: DataFrame, at: str = "ts", late: str = "48 hours", size: str = "1 day") -> DataFrame:
    """start, n: events a window with a watermark; later events than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def catch_up(base: DataFrame, delta_stream: DataFrame, folder: str, tombstones: DataFrame, key: str = "thread_id", at: str = "last_post_at") -> DataFrame:
    """Base, streamed delta and tombstones read as one."""
    return O.overlay(base, delta_merge(delta_stream, folder, key, at).select(*base.columns), tombstones, key)
