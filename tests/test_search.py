"""Parsing, index and ranking."""

import datetime as dt

import pytest

from threadloom.functions import text as X
from threadloom.operators import members, overlay, search, state, views

AT = dt.datetime(2024, 1, 1)
ROWS = [
    ("t:1", "t", 1, "maker", "Artisinal bread", "slow craft bread", 0), ("r:2", "r", 1, "reader", "Re", "artisinal craft slow", 1), ("t:3", "t", 3, "artisan", "Factory bread", "fast <b>Café</b> &amp; test", 2), ("r:4", "r", 3, "Alice", "", "", 3), ("r:5", "r", 3, "Alice Cooper", None or "", "a testing ground", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, kind, int(k[2:]), th, None, u, t, b, AT + dt.timedelta(days=d), "x") for k, kind, th, u, t, b, d in ROWS]
    return spark.createDataFrame(rows, "doc_key string, kind string, post_id bigint, thread_id bigint, parent_post_id bigint, username string, title string, body string, created_at timestamp_ntz, board string")


def test_parse():
    c = search.parse('user:carol title:"poach an egg" soft')
    assert [(x.field, len(x.tokens), x.phrase) for x in c] == [("user", 1, False), ("title", 3, True), (None, 1, False)]
    assert search.tokenise("Café—records 日本語") == ("cafe", "records", "日本語")
    assert search.parse("x" * 600) == [] and search.parse("--- !!") == []
    assert search.parse("a-b")[0].tokens == ("a", "b")


def keys(df):
    return {r.doc_key for r in df.collect()}


def test_search(docs):
    assert keys(search.search(docs, "artisinal")) == {"t:1", "r:2"}
    assert keys(search.search(docs, "artisinal", kind="r")) == {"r:2"}
    assert keys(search.search(docs, "user:artisan")) == {"t:3"}
    assert keys(search.search(docs, 'body:"slow craft"')) == {"t:1"}
    assert keys(search.search(docs, '"craft slow"')) == {"r:2"}
    assert keys(search.search(docs, "title:fact*")) == {"t:3"}
    assert keys(search.search(docs, "cafe test")) == {"t:3"}
    assert keys(search.search(docs, "bread", scopes=("user",))) == set()
    assert keys(search.search(docs, "bread", hidden=docs.where("thread_id = 1"))) == {"t:3"}
    assert keys(search.search(docs, "")) == set() and keys(search.search(docs.limit(0), "bread")) == set()
    with pytest.raises(ValueError):
        search.search(docs, "a*")
    top = [r.doc_key for r in search.page(search.search(docs, "bread"), 1).collect()]
    assert len(top) == 1


def test_additive_and_index_agree_on_matches(docs):
    for q in ("bread", '"slow craft"', "fact*", "alice", "artisinal slow"):
        assert keys(search.additive(docs, q)) == keys(search.search(docs, q)), q
    score = {r.doc_key: r.score for r in search.additive(docs, "alice").collect()}
    assert score["r:4"] > score["r:5"]


def test_postings_and_lexicon(docs):
    rows = {(r.field, r.term, r.doc_key): (r.tf, r.positions) for r in search.postings(docs).collect()}
    assert rows["title", "bread", "t:1"] == (1, [1]) and rows["body", "amp" if False else "test", "t:3"][0] == 1
    assert {r.term for r in search.lexicon(search.postings(docs)).where("stop").collect()} == {"a"}


def test_overlay_state_views(spark, docs):
    base, delta = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "thread_id bigint, x string"), spark.createDataFrame([(2, "B"), (4, "D")], "thread_id bigint, x string")
    gone = spark.createDataFrame([(3,)], "thread_id bigint")
    assert {tuple(r) for r in overlay.overlay(base, delta, gone).collect()} == {(1, "a"), (2, "B"), (4, "D")}
    assert {(r.thread_id, r.change) for r in overlay.changed(delta, base, "thread_id", ["x"]).collect()} == {(2, "edited"), (4, "new")}
    now = docs.select("doc_key", "thread_id", state.fingerprint("title", "body").alias("fp"))
    first = state.merge_read_state(None, now)
    second = state.merge_read_state(first, now.where("doc_key <> 'r:2'").withColumn("fp", __import__("pyspark").sql.functions.expr("CASE WHEN doc_key = 't:1' THEN 'new' ELSE fp END")))
    assert {(r.thread_id, r.n_unread, r.n_total) for r in state.unread_summary(second).collect()} == {(1, 1, 1), (3, 0, 3)}
    assert state.unread_summary(state.mark_read(second)).where("n_unread > 0").count() == 0
    roll = views.thread_rollup(docs)
    assert {(r.thread_id, r.reply_count) for r in roll.collect()} == {(1, 1), (3, 2)}
    assert views.fit_rows([40, 40, 41], 219, 50) == 5 and views.page_for_anchor(4, 25, 10) == 8 and views.page_for_anchor(8, 10, 25) == 3
    assert {r.member: r.n_replies for r in members.member_stats(docs).collect()}["alice"] == 1
    assert {r.key for r in search.suggest_usernames(docs, "AL").collect()} == {"alice", "alice cooper"}


def test_median_is_upper(spark):
    rows = [("t:1", "t", 1, 1, None, "b", 0.0)] + [(f"r:{i}", "r", i, 1, None, "a", h) for i, h in ((2, 1.0), (3, 2.0), (4, 4.0), (5, 5.0), (6, 24.0 * 40))] + [("r:9", "r", 9, 1, 2, "b", 3.0)]
    d = spark.createDataFrame([(k, kind, p, th, par, u, "", "", AT + dt.timedelta(hours=h)) for k, kind, p, th, par, u, h in rows], "doc_key string, kind string, post_id bigint, thread_id bigint, parent_post_id bigint, username string, title string, body string, created_at timestamp_ntz")
    got = {(r.author, r.target): (r.n_replies, r.n_back, r.median_minutes) for r in members.edges(d).collect()}
    assert got == {("a", "b"): (5, 1, 240.0), ("b", "a"): (1, 5, 120.0)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Ａlice É", "<b>x</b> &amp; https://a.example/q.", "2024-01-03T08:38:05.617Z"), (None, None, "soon")], "a string, b string, c string")
    r = df.select(X.normalise("a").alias("a"), X.strict_identity("a").alias("s"), X.links("b").alias("l"), X.parse_time("c").alias("t")).collect()
    assert r[0].a == "alice e" and r[0].s == "alice é" and r[0].l == ["https://a.example/q"] and r[0].t.year == 2024 and r[1].t is None and r[1].a is None
    X.register(spark)
    assert spark.sql("SELECT search_tokens('Café—x') AS t").first().t == ["cafe", "x"]
    assert X.fnv1a("") == 2166136261


def test_positional_index_is_whole(spark, tmp_path):
    from threadloom import queries

    when = dt.datetime(2024, 1, 1)
    schema = "id bigint, thread_id bigint, parent_id bigint, author string, title string, message string, source_url string, ingested_at timestamp_ntz"
    spark.createDataFrame([(1, 1, None, "Ann", "Espresso bar", "bar <b>Café</b> bar", "x/b/a/", when)], schema).write.parquet(str(tmp_path / "threads.parquet"))
    spark.createDataFrame([(2, 1, None, "Bo", "", "espresso zebra", "x/b/a/", when), (2, 1, None, "Bo", "", "espresso zebra", "x/b/a/", when)], schema).write.parquet(str(tmp_path / "posts.parquet"))
    got = {tuple(r) for r in queries.QUERIES["positional_index"](spark, str(tmp_path)).select("field", "term", "doc_key", "kind", "tf", "positions").collect()}
    assert got == {
        ("user", "ann", "t:1", "t", 1, "0"), ("title", "espresso", "t:1", "t", 1, "0"), ("title", "bar", "t:1", "t", 1, "1"), ("body", "bar", "t:1", "t", 2, "0,2"), ("body", "cafe", "t:1", "t", 1, "1"),
        ("user", "bo", "r:2", "r", 1, "0"), ("body", "espresso", "r:2", "r", 1, "0"), ("body", "zebra", "r:2", "r", 1, "1")}
