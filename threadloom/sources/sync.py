"""Imports and incremental updates from a paged source, and control over them.

A source is a function page number -> rows (a list of tuples; none at the end). What was read lies as Parquet, one folder a page, so a page that
is read again replaces itself; what is next, pending or paused lies in a small record that is replaced as a whole. The rows of
one page are all that the driver holds."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stores import Record, delete

Fetch = Callable[[int], Iterable[tuple]]


def until_unchanged(pages: DataFrame, stop_after: int = 2) -> DataFrame:
    """The pages (page, changed) that an update reads: in order, up to the ``stop_after``-th unchanged one in a row. There is one row
    a page, so the window over them is small."""
    order = Window.orderBy("page")
    runs = pages.withColumn("_run", F.sum(F.col("changed").cast("int")).over(order))
    calm = F.sum((~F.col("changed")).cast("int")).over(Window.partitionBy("_run").orderBy("page"))
    ended = F.max((F.col("_calm") >= stop_after).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_calm", calm).withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0").select("page", "changed")


def page_changes(now: DataFrame, known: DataFrame, compared: list[str], key: str = "thread_id") -> DataFrame:
    """``now`` (with page) and ``changed``: whether the row is new or differs from the known one in a compared column."""
    old = known.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in compared], F.lit(True).alias("_had"))
    same = F.col("_had").isNotNull()
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return now.join(old, now[key] == old["_key"], "left").select(*now.columns, (~same).alias("changed"))


def due(last: str | None, now: dt.datetime, **every) -> bool:
    """Whether an interval (``days=7``, ``minutes=15``) has passed since ``last`` (ISO text; None: never)."""
    return last is None or now - dt.datetime.fromisoformat(last) >= dt.timedelta(**every)


class SingleFlight:
    """Calls with the same name that overlap share one run and its outcome."""

    def __init__(self) -> None:
        self._lock, self._open = threading.Lock(), {}

    def __call__(self, name: str, f: Callable):
        with self._lock:
            mine = name not in self._open
            if mine:
                self._open[name] = (threading.Event(), {})
            event, out = self._open[name]
        if not mine:
            event.wait()
        else:
            try:
                out["value"] = f()
            except BaseException as e:
                out["error"] = e
            finally:
                with self._lock:
                    del self._open[name]
                event.set()
        if "error" in out:
            raise out["error"]
        return out["value"]


class Importer:
    """A first import that can be stopped and taken up again, and updates after it.

    The state has phase (idle, importing, paused, complete, error), next_page, error and the times of the last update and of the last
    full comparison."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "thread_id") -> None:
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.record, self.flight = Record(spark, self.root, "_STATE"), SingleFlight()

    def state(self) -> dict:
        return self.record.read() or {"phase": "idle", "next_page": 1, "error": None, "updated": None, "reconciled": None}

    def _put(self, **new) -> dict:
        state = self.state() | new
        self.record.write(state)
        return state

    def pause(self) -> dict:
        return self._put(phase="paused")

    def clear(self) -> None:
        delete(self.spark, self.root)

    def run(self, fetch: Fetch, most_pages: int | None = None) -> dict:
        """Read on from the next page to the first empty one, or ``most_pages`` pages; an error leaves the import paused at its page."""
        return self.flight("run", lambda: self._run(fetch, most_pages))

    def _run(self, fetch: Fetch, most_pages: int | None) -> dict:
        state, done = self._put(phase="importing", error=None), 0
        while most_pages is None or done < most_pages:
            page = state["next_page"]
            try:
                rows = list(fetch(page))
                if rows:
                    self._save(page, rows)
            except Exception as e:
                return self._put(phase="paused", error=str(e))
            if not rows:
                return self._put(phase="complete")
            done += 1
            if self.state()["phase"] == "paused":
                return self._put(next_page=page + 1)
            state = self._put(next_page=page + 1)
        return self._put(phase="paused")

    def _save(self, page: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pages/page={page}")

    def read(self) -> DataFrame:
        """The rows read so far, with their page; of a key that is on several pages the row of the first one."""
        if self.state()["next_page"] == 1:
            return self.spark.createDataFrame([], self.schema).withColumn("page", F.lit(0))
        rows = self.spark.read.option("basePath", f"{self.root}/pages").parquet(f"{self.root}/pages")
        rest = [c for c in rows.columns if c not in (self.key, "page")]
        return rows.groupBy(self.key).agg(F.min(F.struct("page", *rest)).alias("x")).select(self.key, *[f"x.{c}" for c in rest], "x.page")

    def update(self, fetch: Fetch, known: DataFrame, compared: list[str], now: dt.datetime, full: bool | None = None, stop_after: int = 2) -> tuple[DataFrame, DataFrame]:
        """Changed rows and removed keys since ``known``: pages are read, the newest first, until ``stop_after`` of them in a row bring
        nothing new. Once a week, or with ``full``, all pages are read, and what is on none of them counts as removed."""
        state = self.state()
        full = due(state["reconciled"], now, days=7) if full is None else full
        changed, seen, calm, page = [], None, 0, 1
        while full or calm < stop_after:
            rows = list(fetch(page))
            if not rows:
                break
            part = self.spark.createDataFrame(rows, self.schema)
            fresh = page_changes(part, known, compared, self.key).where("changed").drop("changed")
            n = fresh.count()
            calm = 0 if n else calm + 1
            changed += [fresh] if n else []
            seen = part.select(self.key) if seen is None else seen.unionByName(part.select(self.key))
            page += 1
        none = self.spark.createDataFrame([], self.schema)
        out = none
        for c in changed:
            out = out.unionByName(c)
        removed = known.select(self.key).join(seen if seen is not None else none.select(self.key), self.key, "left_anti") if full else none.select(self.key)
        self._put(updated=now.isoformat(), **({"reconciled": now.isoformat()} if full else {}))
        return out.dropDuplicates([self.key]), removed
