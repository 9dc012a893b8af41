"""Keyed tables on a shared file system that are changed a few keys at a time, and small JSON records.

Rows lie in buckets by the hash of their key. A change writes new files for the buckets it touches and then a numbered
record of which version of each bucket counts; that record is the commit point. Readers take the highest record, so they see all of
a change or nothing. Buckets that neither of the last two records names are deleted."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_of(spark: SparkSession, name: str):
    """The file system of a path, and the path, by Hadoop's own classes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, p = path_of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, name: str) -> str | None:
    fs, p = path_of(spark, name)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a new file whole: beside it first, then renamed. A file of that name is replaced."""
    fs, target = path_of(spark, name)
    _, beside = path_of(spark, name + ".next")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"could not write {name}")


def delete(spark: SparkSession, name: str) -> None:
    fs, p = path_of(spark, name)
    fs.delete(p, True)


class Record:
    """A small JSON value that is replaced as a whole: each write makes a file with the next number, the highest counts, and the one
    before it stays. A crash at any point leaves the old value or the new one."""

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name

    def numbers(self) -> list[int]:
        own = re.compile(re.escape(self.name) + r"\.(\d+)")
        return sorted(int(m[1]) for n in names_in(self.spark, self.folder) if (m := own.fullmatch(n)))

    def read(self):
        n = self.numbers()
        return json.loads(read_text(self.spark, f"{self.folder}/{self.name}.{n[-1]:012d}")) if n else None

    def write(self, value, number: int | None = None) -> int:
        had = self.numbers()
        number = (had[-1] + 1 if had else 1) if number is None else number
        write_text(self.spark, f"{self.folder}/{self.name}.{number:012d}", json.dumps(value, sort_keys=True))
        for old in [n for n in had if n != number][:-1]:
            delete(self.spark, f"{self.folder}/{self.name}.{old:012d}")
        return number


class KeyedStore:
    """A table of one row a key, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.record = Record(spark, self.root, "_VERSION")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _load(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.root}/v{v}/b{b}" for b, v in sorted(state["buckets"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The table, or None before the first change."""
        state = self.record.read()
        return self._load(state) if state else None

    def change(self, keys: DataFrame, merge: Callable[[DataFrame | None], DataFrame], number: int | None = None) -> DataFrame:
        """Replace the buckets that ``keys`` fall into by what ``merge`` makes of their rows (None before the first change).

        ``merge`` must not need rows of other keys, and must return the rows of those buckets only. A change of the same ``number`` as
        one that was recorded replaces it, so that a repeated change counts once."""
        had = self.record.numbers()
        numbers = [n for n in had if number is None or n < number]
        state = json.loads(read_text(self.spark, f"{self.root}/_VERSION.{numbers[-1]:012d}")) if numbers else None
        number = (numbers[-1] + 1 if numbers else 1) if number is None else number
        touched = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())
        new = merge(self._load(state, touched) if state else None)
        at = {b: v for b, v in state["buckets"].items()} if state else {}
        held = new.withColumn("_bucket", self._bucket()).repartition(max(1, len(touched)), "_bucket")
        held.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/v{number}/_all")
        fs, _ = path_of(self.spark, self.root)
        for b in touched:
            _, source = path_of(self.spark, f"{self.root}/v{number}/_all/_bucket={b}")
            _, target = path_of(self.spark, f"{self.root}/v{number}/b{b}")
            fs.delete(target, True)
            if fs.exists(source):
                fs.rename(source, target)
                at[str(b)] = number
            else:
                at.pop(str(b), None)
        delete(self.spark, f"{self.root}/v{number}/_all")
        self.record.write({"buckets": at, "schema": new.schema.jsonValue()}, number)
        self._clean()
        return self.read()

    def _clean(self) -> None:
        kept: set[str] = set()
        for n in self.record.numbers():
            kept |= {f"v{v}/b{b}" for b, v in json.loads(read_text(self.spark, f"{self.root}/_VERSION.{n:012d}"))["buckets"].items()}
        for v in [n for n in names_in(self.spark, self.root) if re.fullmatch(r"v\d+", n)]:
            left = names_in(self.spark, f"{self.root}/{v}")
            for b in left:
                if f"{v}/{b}" not in kept:
                    delete(self.spark, f"{self.root}/{v}/{b}")
            if not any(f"{v}/{b}" in kept for b in left):
                delete(self.spark, f"{self.root}/{v}")

    def upsert(self, rows: DataFrame, at: str | None = None, number: int | None = None) -> DataFrame:
        """Put rows in the place of those with their keys; with ``at`` the latest of all counts. Keys must be single in ``rows``, or ``at`` be given."""
        from ..operators.state import last_write_wins

        def merge(prior: DataFrame | None) -> DataFrame:
            if at is not None:
                return last_write_wins(rows if prior is None else prior.unionByName(rows), self.key, at)
            return rows if prior is None else prior.join(rows.select(self.key), self.key, "left_anti").unionByName(rows)

        return self.change(rows, merge, number)

    def remove(self, keys: DataFrame) -> DataFrame | None:
        """Take out the rows of some keys."""
        if self.record.read() is None:
            return None
        return self.change(keys, lambda prior: prior.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def clear(self) -> None:
        delete(self.spark, self.root)
