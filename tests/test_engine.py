"""The façade and the settings."""

import datetime as dt

import pytest

from threadloom import settings
from threadloom.engine import Forum, Visibility

AT = dt.datetime(2024, 1, 1)


def forum(spark):
    threads = spark.createDataFrame([(1, "Rye bread", "slow", "Ann", "/b/x/1", AT), (2, "Oats", "bread", "Bob", "/b/x/2", AT)], "id bigint, title string, message string, author string, source_url string, ingested_at timestamp_ntz")
    posts = spark.createDataFrame([(5, 1, None, "", "bread!", "Bob", None, AT), (6, 1, 5, "", "no bread", "Ann", None, AT + dt.timedelta(1))], "id bigint, thread_id bigint, parent_id bigint, title string, message string, author string, source_url string, ingested_at timestamp_ntz")
    labels = spark.createDataFrame([(1, "Kitchen/Baking ", 0.9, "manual"), (2, "law", 0.5, "automatic")], "thread_id bigint, category_id string, confidence double, source string")
    return Forum.of(threads, posts, thread_labels=labels, post_labels=labels.selectExpr("thread_id AS post_id", "category_id", "source").limit(0)), posts


def test_forum(spark):
    f, posts = forum(spark)
    keys = lambda df, c="doc_key": [r[c] for r in df.collect()]
    assert keys(f.search("bread"))[0] == "t:1" and len(keys(f.search("bread"))) == 4
    assert set(keys(f.search("bread category:kitchen/baking"))) == {"t:1", "r:5", "r:6"}
    with pytest.raises(ValueError):
        f.search("category:law")
    hid = f.seen_by(Visibility(blocked=("BOB",)))
    assert set(keys(hid.search("bread"))) == {"t:1"}
    assert keys(hid.seen_by(Visibility(blocked=("Bob",), reveal=True)).by_author("bob", "r")) == ["r:5"]
    assert keys(f.classic("subject"), "thread_id") == [2, 1] and keys(f.unloved(), "thread_id") == [2]
    muted = f.docs.where("thread_id = 1").select("thread_id").distinct()
    assert keys(f.seen_by(Visibility(muted=muted)).classic(), "thread_id") == [2]
    assert keys(f.category_threads("kitchen/baking"), "thread_id") == [1] and keys(f.backfill("s", 5), "thread_id") == [2]
    assert [(r.doc_key, r.answered) for r in f.unanswered("Ann").collect()] == [("r:5", True)]
    assert keys(f.notifications("bob")) == ["r:6"] and f.navigation_target("r:6").first().thread_title == "Rye bread"
    assert f.members().first().member == "ann" and keys(f.suggest_usernames("b"), "display") == ["Bob"]
    assert f.read_state().where("read_fp <=> current_fp").count() == 4
    assert {r.category_id for r in f.category_of_replies(posts).collect()} == {"kitchen/baking"}


def test_settings():
    assert settings.blocked_names(["Ａnn", "ann", "Bob"]) == ["Ann", "Bob"]
    for bad in ([""], ["x" * 65], ["a\x07"], [f"n{i}" for i in range(65)]):
        with pytest.raises(ValueError):
            settings.blocked_names(bad)
    names, values = settings.load(settings.dump(["Ann"], {"refresh_minutes": 1, "full_days": 99}))
    assert names == ["Ann"] and values == {"refresh_minutes": 15, "full_days": 30, "reply_days": 7}
    with pytest.raises(ValueError):
        settings.load('{"format": "other"}')
    e = [{"query": "A", "scopes": ["post"], "at": 5.0}, {"query": "a", "scopes": ["post"], "at": 9.0}, {"query": "b", "at": 99.0}, {"query": "", "at": 1.0}, {"at": 3}]
    assert [x["at"] for x in settings.recent_searches(e, 10.0)] == [9.0]
