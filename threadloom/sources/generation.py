"""Immutable index generations on a shared file system: staged, verified, then switched to by one small file.

A generation is a folder with documents, postings and lexicon as Parquet and a manifest of counts and order-free hashes. The
highest numbered ``_ACTIVE`` file names the generation in use; the appearance of the next one is the commit point, so a failure at any time leaves
the old one or the new one in use."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..schema import check_columns
from .stores import Record, delete, names_in, path_of, read_text, write_text

FORMAT, VERSION = "threadloom-index", 1
TABLES = ("documents", "postings", "lexicon")


def fingerprint(df: DataFrame) -> dict:
    """Row count and order-free hash of a table."""
    r = df.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)]).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)") % 1_000_000_007).alias("s")).first()
    return {"rows": r.n, "hash": f"{r.x or 0:x}:{r.s or 0}"}


class Generations:
    """The generations below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = Record(spark, self.root, "_ACTIVE")

    def active(self) -> str | None:
        return (self.pointer.read() or {}).get("generation")

    def list(self) -> list[str]:
        return [n for n in names_in(self.spark, self.root) if not n.startswith(("_", ".")) and path_of(self.spark, self.root)[0].getFileStatus(path_of(self.spark, f"{self.root}/{n}")[1]).isDirectory()]

    def manifest(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.root}/{name}/_manifest.json")
        return json.loads(text) if text else None

    def read(self, table: str, name: str | None = None) -> DataFrame:
        name = name or self.active()
        if name is None:
            raise LookupError("no generation is active")
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")

    def build(self, docs: DataFrame, name: str, watermark: str) -> dict:
        """Write a generation beside the active one. Postings are partitioned by field and laid in ranges of term and document, so that a query
        reads only the row groups of its terms, and the postings of a frequent term are spread over several tasks and files."""
        check_columns(docs)
        base = f"{self.root}/{name}"
        docs.write.mode("overwrite").parquet(f"{base}/documents")
        docs = self.spark.read.parquet(f"{base}/documents")
        S.postings(docs).repartitionByRange("field", "term", "doc_key").sortWithinPartitions("field", "term", "doc_key").write.mode("overwrite").partitionBy("field").parquet(f"{base}/postings")
        S.lexicon(self.spark.read.parquet(f"{base}/postings")).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{base}/lexicon")
        found = {t: fingerprint(self.spark.read.parquet(f"{base}/{t}")) for t in TABLES}
        manifest = {"format": FORMAT, "version": VERSION, "watermark": watermark, "tables": found}
        write_text(self.spark, f"{base}/_manifest.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def verify(self, name: str) -> dict:
        """The manifest; raises where the format is unknown or a table differs from it."""
        manifest = self.manifest(name)
        if not manifest or (manifest.get("format"), manifest.get("version")) != (FORMAT, VERSION):
            raise ValueError(f"{name} is no generation of a known version")
        for t in TABLES:
            if fingerprint(self.spark.read.parquet(f"{self.root}/{name}/{t}")) != manifest["tables"][t]:
                raise ValueError(f"{name}: {t} differs from the manifest")
        return manifest

    def activate(self, name: str) -> bool:
        """Switch to a verified generation, unless the active one is as new; the former one stays for rollback."""
        new, old = self.verify(name), self.active()
        if old and (self.manifest(old) or {}).get("watermark", "") >= new["watermark"]:
            return False
        self.pointer.write({"generation": name, "previous": old})
        return True

    def rollback(self) -> str | None:
        """Switch back to the generation before the active one."""
        previous = (self.pointer.read() or {}).get("previous")
        if previous:
            self.verify(previous)
            self.pointer.write({"generation": previous, "previous": None})
        return previous

    def clean(self) -> list[str]:
        """Delete all but the active generation and the one before it."""
        keep = set((self.pointer.read() or {}).values())
        gone = [g for g in self.list() if g not in keep]
        for g in gone:
            delete(self.spark, f"{self.root}/{g}")
        return gone

    def search(self, query: str, name: str | None = None, **options) -> DataFrame:
        """Hits over a generation: the number of documents comes from its manifest and those of the query's terms from its lexicon, so
        nothing is counted, and the same query scores alike whoever asks and whatever they hide."""
        name = name or self.active()
        n = self.manifest(name)["tables"]["documents"]["rows"] if name else None
        return S.search(self.read("documents", name), query, posts=self.read("postings", name), lex=self.read("lexicon", name), n_docs=n, **options)

    def document(self, doc_key: str, name: str | None = None) -> DataFrame:
        """The document of a key, or no row."""
        return self.read("documents", name).where(F.col("doc_key") == doc_key)

    def status(self) -> dict:
        """What is active, what it holds and what else is there."""
        active = self.active()
        manifest = (self.manifest(active) or {}) if active else {}
        return {"active": active, "watermark": manifest.get("watermark"), "rows": {t: x["rows"] for t, x in manifest.get("tables", {}).items()}, "generations": self.list()}

    def publish(self, docs: DataFrame, name: str, watermark: str) -> bool:
        """Build, verify, switch and clean up in one go; what was active before stays for rollback."""
        self.build(docs, name, watermark)
        switched = self.activate(name)
        self.clean()
        return switched

    def recover(self) -> str | None:
        """Go back to the generation before where the active one is damaged; the name of what is active then."""
        active = self.active()
        try:
            if active:
                self.verify(active)
            return active
        except Exception:
            return self.rollback()

    def clear(self) -> None:
        delete(self.spark, self.root)
