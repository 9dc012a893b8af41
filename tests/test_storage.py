"""Sources, generations, streams, categories."""

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F
from threadloom.operators import categories, search
from threadloom.sources import archive, generation
from threadloom.streaming import flows

DOC = "doc_key string, kind string, post_id bigint, thread_id bigint, parent_post_id bigint, username string, title string, body string, created_at timestamp_ntz, board string"


def one(spark, title="Bread"):
    return spark.createDataFrame([("t:1", "t", 1, 1, None, "a", title, "slow bread", dt.datetime(2024, 1, 1), "x")], DOC)


def test_generations(spark, tmp_path):
    g = generation.Generations(spark, str(tmp_path))
    g.build(one(spark), "g1", "2024-01-01")
    assert g.activate("g1") and g.active() == "g1"
    g.build(one(spark, "Rye"), "g2", "2024-02-01")
    assert g.activate("g2") and not g.activate("g1")
    assert search.search(g.read("documents"), "title:rye", posts=g.read("postings")).count() == 1
    assert g.rollback() == "g1" and g.active() == "g1"
    spark.createDataFrame([("x",)], "term string").write.mode("append").parquet(f"{tmp_path}/g2/lexicon")
    with pytest.raises(ValueError):
        g.verify("g2")
    assert g.clean() == ["g2"]
    with pytest.raises(ValueError):
        g.build(one(spark).withColumn("Email", F.lit("x")), "g3", "2024-03-01")


def test_json_sources(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat/p1.json").write_text(json.dumps({"PageNumber": 1, "ThreadCount": 1, "Threads": [{"Id": 101, "Title": "T", "Message": "M", "PostedByUsername": "A", "PostCount": 3}]}))
    assert archive.catalogue(spark, str(tmp_path / "cat")).first().reply_count == 2
    (tmp_path / "rep.json").write_text(json.dumps([{"Id": 201, "ThreadId": 101, "Replies": [{"Id": 202, "ThreadId": 101, "Replies": []}]}]))
    assert {(r.post_id, r.parent_id) for r in archive.reply_trees(spark, str(tmp_path / "rep.json"), 4).collect()} == {(201, None), (202, 201)}
    (tmp_path / "b.json").write_text("\n".join(json.dumps(x) for x in ({"type": "header", "schemaVersion": 2}, {"type": "termShard", "field": "body", "prefix": "bre", "postings": [{"term": "bread", "docs": ["t:1"]}, {"term": "rye", "docs": ["t:1", "t:1"]}]})))
    _, _, shards = archive.bootstrap(spark, str(tmp_path / "b.json"))
    assert [r.fault for r in archive.shard_faults(shards).collect()] == ["prefix"]
    th = spark.createDataFrame([(1, "t", "m")], "id bigint, title string, message string")
    po = spark.createDataFrame([(2, 1, None, "m"), (3, 1, 2, "m")], "id bigint, thread_id bigint, parent_id bigint, message string")
    assert archive.validate(th, po, 1) == {"threads": 1, "posts": 2}
    with pytest.raises(ValueError):
        archive.validate(th, po.unionByName(spark.createDataFrame([(4, 9, None, "m")], po.schema)))


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i) for i in range(20)]
    for n in range(2):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "k bigint, at timestamp_ntz, v bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("k bigint, at timestamp_ntz, v bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.k, r.v) for r in flows.delta_merge(read(), str(tmp_path / "d"), "k", "at").collect()}
    assert got == {(k, 15 + k) for k in range(5)}
    st = flows.read_state(read().selectExpr("concat('r:', k) AS doc_key", "k AS thread_id", "string(v) AS fp", "at"), str(tmp_path / "r"))
    assert st.where("NOT (read_fp <=> current_fp)").count() == 5
    n = flows.notifications(read().selectExpr("concat('r:', v) AS doc_key", "at AS created_at"), str(tmp_path / "n"), 12)
    assert n.count() == 12 and n.where("NOT read").count() == 10


CASES = [("", 0, 0, "ignore_junk", "empty"), ("lol", 0, 0, "ignore_junk", "single_word_non_url"), ("lol", 2, 0, "analyse", None), ("lol", 0, 3, "analyse", None), ("https://x.example/a", 0, 0, "preserve_link", None), ("[quote]a[/quote]", 0, 0, "ignore_junk", "quote_only"), ("😂😂", 0, 0, "ignore_junk", "symbol_only"), ("Yes yes", 0, 0, "ignore_junk", "short_ack"), ("日本語です", 0, 0, "analyse", None), ("a longer reply", 0, 0, "analyse", None), (None, 0, 0, "ignore_junk", "empty")]


def test_prefilter_and_model(spark):
    df = spark.createDataFrame([(i, b, c, d) for i, (b, c, d, _, _) in enumerate(CASES)], "i bigint, b string, c bigint, d bigint")
    got = {r.i: (r.x.decision, r.x.reason) for r in df.select("i", categories.prefilter(F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()}
    assert got == {i: c[3:] for i, c in enumerate(CASES)}
    assert [round(r[0]) for r in spark.range(1, 10).select(categories.back_off(F.col("id"))).collect()] == [300, 600, 1200, 2400, 4800, 9600, 19200, 21600, 21600]

    def model(rows):
        if any(r["title"] == "bad" for r in rows):
            raise RuntimeError
        return [(r["thread_id"], "law", 0.9 if r["title"] == "good" else 0.1) for r in rows]

    items = spark.createDataFrame([(1, "good", ""), (2, "bad", ""), (3, "weak", "")], "thread_id bigint, title string, message string")
    assert {(r.thread_id, r.category_id) for r in categories.classify(items, model).collect()} == {(1, "law"), (2, "unsorted"), (3, "unsorted")}


@pytest.mark.parametrize("n", [13, 30_000])
def test_reply_trees_of_any_depth(spark, tmp_path, n):
    big = 2**62
    text = "".join(f'{{"Id": {big + i}, "ThreadId": 7, "Message": "m{i} \\u00e9 ]}}", "Replies": [' for i in range(n)) + "]}" * n
    (tmp_path / "a.json").write_text(f'[{text}, {{"Id": 1, "Title": null, "PostedByUsername": "A"}}]')
    (tmp_path / "b.json").write_text("[]")
    rows = {r.post_id: r for r in archive.reply_trees(spark, str(tmp_path)).collect()}
    assert {(r.post_id, r.parent_id) for r in rows.values()} == {(big + i, big + i - 1 if i else None) for i in range(n)} | {(1, None)}
    assert rows[big + n - 1].message == f"m{n - 1} é ]}}" and rows[1].author == "A" and rows[1].title is None
    with pytest.raises(Exception, match="deeper than 4"):
        archive.reply_trees(spark, str(tmp_path), 4).collect()
    (tmp_path / "b.json").write_text('[{"Id": 5, "Replies": [}]')
    with pytest.raises(Exception, match="JSONDecodeError"):
        archive.reply_trees(spark, str(tmp_path)).collect()


def test_deep_decoder_agrees():
    for x in ([], {}, [[], {}], {"a": [1, -2.5, None, True, {"b": "\\\"]}", "c": {}}], "d": []}, [{"a": 1}, {"a": [[1]]}], 5, "x"):
        for indent in (None, 2):
            assert archive._decoded(json.dumps(x, indent=indent)) == x
    for bad in ("", "[1", "[1,]", '{"a" 1}', '{"a":1,}', "[1] 2", "{1:2}", "[}", "]"):
        with pytest.raises(ValueError):
            archive._decoded(bad)
