"""Published category maps, reports and exports."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import categories
from .generation import fingerprint
from .stores import Record, delete, names_in, write_text


class CategoryMap:
    """A published map of categories below ``root``: threads (thread_id, category_id) and, of replies, only those that differ from
    their thread (post_id, category_id), both as JSON lines. A record names the version that counts, with counts and order-free
    hashes, signed where a key is given."""

    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.record = Record(spark, self.root, "_MAP")

    def _signature(self, tables: dict) -> str:
        text = json.dumps(tables, sort_keys=True).encode()
        return hmac.new(self.key, text, hashlib.sha256).hexdigest() if self.key else hashlib.sha256(text).hexdigest()

    def publish(self, threads: DataFrame, resolved: DataFrame, differing: DataFrame, posts: DataFrame, taxonomy: DataFrame) -> dict:
        """Check the categories of all posts (post_id, category_id), write the map and switch to it; raises where a rule is broken."""
        faults = {r.fault: r.n for r in categories.publish_faults(resolved, posts, taxonomy).collect()}
        if faults:
            raise ValueError(f"not published: {faults}")
        number = (self.record.numbers() or [0])[-1] + 1
        for name, df in (("threads", threads.select("thread_id", "category_id")), ("replies", differing.select("post_id", "category_id"))):
            df.write.mode("overwrite").json(f"{self.root}/m{number}/{name}")
        tables = {name: fingerprint(self._read(number, name)) for name in ("threads", "replies")}
        manifest = {"version": number, "tables": tables, "signature": self._signature(tables)}
        self.record.write(manifest, number)
        for old in [n for n in names_in(self.spark, self.root) if n.startswith("m") and n[1:].isdigit() and int(n[1:]) < number - 1]:
            delete(self.spark, f"{self.root}/{old}")
        return manifest

    def _read(self, number: int, name: str) -> DataFrame:
        key = "thread_id" if name == "threads" else "post_id"
        return self.spark.read.schema(f"{key} bigint, category_id string").json(f"{self.root}/m{number}/{name}")

    def load(self, name: str = "threads", bundled: DataFrame | None = None) -> DataFrame:
        """The map, after its signature, counts and hashes are checked; the bundled one where it is missing or damaged."""
        try:
            manifest = self.record.read()
            if manifest and hmac.compare_digest(manifest["signature"], self._signature(manifest["tables"])):
                own = self._read(manifest["version"], name)
                if fingerprint(own) == manifest["tables"][name]:
                    return own
        except Exception:  # whatever is wrong with it, a reader still gets categories
            pass
        if bundled is None:
            raise LookupError("no category map, and none bundled")
        return bundled


def write_report(spark: SparkSession, path: str, **parts: DataFrame) -> None:
    """One JSON document of small tables, each a list of objects, replaced as a whole. A part of more than 10,000 rows is refused: a
    report is for people, tables go to Parquet."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(10_001).toJSON().collect()
        if len(rows) > 10_000:
            raise ValueError(f"{name} is no report: it has more than 10,000 rows")
        out[name] = [json.loads(r) for r in rows]
    write_text(spark, path, json.dumps(out, ensure_ascii=False, sort_keys=True))


def export(df: DataFrame, path: str, order: list | None = None) -> None:
    """JSON lines for another program, in an order if one is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
