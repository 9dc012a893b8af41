"""Scans of archives and interchange files, with validation: JDBC or Parquet archives, paged JSON, newline-delimited JSON."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

THREAD = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Title", T.StringType()), T.StructField("Message", T.StringType()), T.StructField("PostedByUsername", T.StringType()), T.StructField("CreatedDateTimeUtc", T.StringType()), T.StructField("LastPostDateTimeUtc", T.StringType()), T.StructField("PostCount", T.IntegerType())])
CATALOGUE = T.StructType([T.StructField("PageNumber", T.IntegerType()), T.StructField("ThreadCount", T.IntegerType()), T.StructField("Threads", T.ArrayType(THREAD))])


REPLY = "post_id bigint, thread_id bigint, parent_id bigint, title string, message string, author string, created_utc string"
_SCALAR = json.JSONDecoder()


def decoded(text: str):
    """The value of a JSON document of any depth; the standard decoder recurs, so what is too deep for it is decoded with a stack."""
    try:
        return json.loads(text)
    except RecursionError:
        return _decoded(text)


def _decoded(text: str):
    space = re.compile(r"[ \t\n\r]*")
    skip = lambda i: space.match(text, i).end()
    top: list = []
    open_: list = [top]  # the containers around the place
    keys: list = [None]  # the key in each of them that waits for its value
    at = 0

    def bad(i: int) -> ValueError:
        return json.JSONDecodeError("not JSON", text, i)

    def put(value) -> None:
        if isinstance(open_[-1], dict):
            open_[-1][keys[-1]] = value
        else:
            open_[-1].append(value)

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise bad(i)
        keys[-1], i = _SCALAR.raw_decode(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise bad(i)
        return skip(i + 1)

    at = skip(at)
    while True:
        c = text[at : at + 1]
        if c and c in "[{":
            new = [] if c == "[" else {}
            put(new)
            open_.append(new)
            keys.append(None)
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                at = key(at) if c == "{" else at
                continue
        else:
            value, at = _SCALAR.raw_decode(text, at)
            put(value)
            at = skip(at)
        # a value has ended: close what ends with it, then go on behind a comma
        while len(open_) > 1 and text[at : at + 1] == ("}" if isinstance(open_[-1], dict) else "]"):
            open_.pop()
            keys.pop()
            at = skip(at + 1)
        if len(open_) == 1:
            if at < len(text):
                raise bad(at)
            return top[0]
        if text[at : at + 1] != ",":
            raise bad(at)
        at = skip(at + 1)
        if isinstance(open_[-1], dict):
            at = key(at)


def _whole(x) -> int | None:
    if x is not None and (not isinstance(x, int) or isinstance(x, bool) or not -(2**63) <= x < 2**63):
        raise ValueError(f"not a whole number: {x!r:.40}")
    return x


def _words(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def replies(text: str, depth: int | None = None) -> Iterator[tuple]:
    """The rows of one reply document, on every level; raises where it is malformed, or nested deeper than ``depth``."""
    if not (text := text.removeprefix("\ufeff")).strip():
        return
    roots = decoded(text)
    stack = [(r, None, 1) for r in (roots if isinstance(roots, list) else [roots])]
    while stack:
        r, parent, level = stack.pop()
        r = {} if r is None else r
        if not isinstance(r, dict):
            raise ValueError("a reply is no object")
        if depth is not None and level > depth:
            raise ValueError(f"replies are nested deeper than {depth}")
        own, below = _whole(r.get("Id")), r.get("Replies")
        yield own, _whole(r.get("ThreadId")), parent, *(_words(r.get(k)) for k in ("Title", "Message", "PostedByUsername", "CreatedDateTimeUtc"))
        if below is not None and not isinstance(below, list):
            raise ValueError("Replies is no array")
        stack.extend((x, own, level + 1) for x in below or ())


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """thread_id, title, message, author, created_utc, last_post_utc, reply_count from catalogue pages (one JSON document a file)."""
    pages = spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    t = pages.select(F.explode("Threads").alias("t"))
    return t.select(F.col("t.Id").alias("thread_id"), F.col("t.Title").alias("title"), F.col("t.Message").alias("message"), F.col("t.PostedByUsername").alias("author"), F.col("t.CreatedDateTimeUtc").alias("created_utc"), F.col("t.LastPostDateTimeUtc").alias("last_post_utc"), F.greatest(F.lit(0), F.col("t.PostCount") - 1).alias("reply_count"))


def reply_trees(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """post_id, thread_id, parent_id, title, message, author, created_utc from nested reply JSON (an array a file), of any depth.

    With ``depth`` a file whose replies are nested deeper is an error; none are left out."""
    names = [c.split()[0] for c in REPLY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                rows = replies(text, depth)
                while part := list(itertools.islice(rows, 10_000)):
                    # objects, for a column of numbers with nulls would become floats
                    yield pd.DataFrame(part, columns=names, dtype=object)

    return spark.read.text(path, wholetext=True).mapInPandas(run, REPLY)


def archive_tables(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """threads and posts of an archive database over JDBC; the driver's jar must be on the class path."""
    props = properties or {}
    return spark.read.jdbc(url, "threads", properties=props), spark.read.jdbc(url, "posts", properties=props)


def bootstrap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """header, threads and term shards of a (compressed) newline-delimited JSON export."""
    schema = "type string, schemaVersion int, threadCount bigint, thread struct<threadId bigint, title string, body string, username string, createdUtc string>, field string, prefix string, postings array<struct<term string, docs array<string>>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.where("type = 'header'"), rows.where("type = 'thread'").select("thread.*"), rows.where("type = 'termShard'").select("field", "prefix", F.posexplode("postings").alias("nth", "p")).select("field", "prefix", "nth", "p.term", "p.docs")


def shard_faults(shards: DataFrame) -> DataFrame:
    """field, prefix, term, fault of every term-shard row that breaks a rule."""
    if "nth" in shards.columns:  # the place of a term in its shard: terms must ascend
        shards = shards.withColumn("_before", F.lag("term").over(Window.partitionBy("field", "prefix").orderBy("nth")))
    else:
        shards = shards.withColumn("_before", F.lit(None).cast("string"))
    fault = (
        F.when(~F.col("field").isin("user", "title", "body"), "field")
        .when(F.substring("term", 1, 3) != F.col("prefix"), "prefix")
        .when(F.col("_before") >= F.col("term"), "order")
        .when(F.size("docs") <= 0, "empty")
        .when(F.size(F.array_distinct("docs")) != F.size("docs"), "repeated")
        .when(~F.forall("docs", lambda d: d.rlike(r"^[tr]:\d+$")), "key")
    )
    return shards.withColumn("fault", fault).where("fault IS NOT NULL").select("field", "prefix", "term", "fault")


def verify_export(spark: SparkSession, path: str, size: int | None = None, sha256: str | None = None, threads: int | None = None) -> dict:
    """Size, SHA-256 and number of threads of an export file; raises where one differs from what is expected. Nothing is taken over
    before this pass."""
    own = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("hash")).first()
    header, rows, _ = bootstrap(spark, path)
    first = header.first()
    found = {"size": own["length"], "sha256": own["hash"], "threads": rows.count()}
    for name, want in (("size", size), ("sha256", sha256), ("threads", threads if threads is not None else first and first.threadCount)):
        if want is not None and want != found[name]:
            raise ValueError(f"{name} is {found[name]}, not {want}")
    if first is None:
        raise ValueError("the export has no header")
    return found


def validate(threads: DataFrame, posts: DataFrame, reported_threads: int | None = None, watermark: str | None = None) -> dict[str, int]:
    """Counts of an archive; raises where columns are missing, ids are null or repeated, counts differ or references dangle. With
    ``watermark``, a column of the threads, it must not be empty as a whole."""
    if watermark is not None and threads.agg(F.max(watermark)).first()[0] is None:
        raise ValueError("the archive has no watermark")
    for df, names in ((threads, ("id", "title", "message")), (posts, ("id", "thread_id", "parent_id", "message"))):
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
    n_threads, bad = threads.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull() | F.col("title").isNull())).first()
    if bad or (reported_threads is not None and n_threads != reported_threads):
        raise ValueError("the thread count or a thread is wrong")
    for df in (threads, posts):
        if df.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("repeated id")
    orphans = posts.join(threads.select(F.col("id").alias("thread_id")), "thread_id", "left_anti").count()
    parents = posts.where("parent_id IS NOT NULL AND parent_id <> 0").join(posts.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").count()
    if orphans or parents:
        raise ValueError(f"{orphans} replies without a thread, {parents} without their parent")
    return {"threads": n_threads, "posts": posts.count()}
