"""References and hierarchies against brute force on small tables."""

import datetime as dt
import random

from threadloom.operators import conversation, hierarchy, references
from threadloom.plans import skew_join
from threadloom.schema import documents

POSTS = "id bigint, thread_id bigint, parent_id bigint, message string, ingested_at timestamp_ntz, state string"


def t(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def brute(parents):
    out = {}
    for n in parents:
        seen, cur = [n], n
        while parents.get(cur) in parents and parents[cur]:
            cur = parents[cur]
            if cur in seen:
                out[n] = (min(seen[seen.index(cur) :]), -1)
                break
            seen.append(cur)
        else:
            out[n] = (cur, len(seen) - 1)
    return out


def test_hierarchy_matches_brute_force(spark):
    rng = random.Random(5)
    parents = {i: rng.choice([None, 0, rng.randint(1, 80), i - 1]) for i in range(1, 61)} | {100: 101, 101: 102, 102: 100, 103: 100, 104: 104, 105: 104}
    rows = [(i, p) for i, p in parents.items()] + [(1, parents[1]), (None, 3)]
    df = spark.createDataFrame(rows, "id bigint, parent_id bigint")
    got = {r.id: (r.root_id, r.depth) for r in hierarchy.hierarchy(df).collect()}
    assert got == brute(parents)
    paths = {r.id: r.path for r in hierarchy.hierarchy(df, with_path=True).collect()}
    assert all(p is None if got[i][1] == -1 else len(p) == got[i][1] + 1 and p[0] == got[i][0] and p[-1] == i for i, p in paths.items())
    below = {}
    for r in hierarchy.descendants(df).collect():
        below.setdefault(r.ancestor_id, set()).add(r.descendant_id)
    assert {(a, d) for a, ds in below.items() for d in ds} == {(a, i) for i, p in paths.items() if p for a in p[:-1]}
    assert {r.loop_id for r in hierarchy.loops(df).collect()} == {100, 104}


def test_long_chain_and_empty(spark):
    df = spark.range(1, 301).selectExpr("id", "id - 1 AS parent_id")
    assert {r.depth for r in hierarchy.hierarchy(df).where("id = 300").collect()} == {299}
    assert hierarchy.found(df.limit(0)).count() == 0


def test_references(spark):
    posts = spark.createDataFrame(
        [(1, 10, None, "a", t(5), "x"), (1, 10, None, "a", t(9), "x"), (2, 11, 1, "b", t(1), "x"), (3, 12, 99, "c", t(2), "x"), (4, 13, 0, "d", t(3), "x"), (5, None, 4, None, t(4), None), (None, 10, 1, "e", t(4), "x")], POSTS
    )
    threads = spark.createDataFrame([(10, t(6)), (11, t(0)), (13, t(0))], "id bigint, ingested_at timestamp_ntz")
    cats = spark.createDataFrame([(4, t(2)), (7, t(1)), (4, t(8)), (None, t(1))], "post_id bigint, ingested_at timestamp_ntz")
    stones = spark.createDataFrame([("t", 13, t(1)), ("r", 4, t(2)), ("r", 99, t(1)), ("t", 11, t(-5)), ("r", 99, t(1))], "kind string, item_id bigint, deleted_at timestamp_ntz")
    got = {tuple(r) for r in references.found(posts, threads, cats, stones).collect()}
    assert got == {
        ("posts", "thread_id", 1, 10, "late"), ("posts", "parent_id", 2, 1, "late"), ("posts", "thread_id", 3, 12, "missing"), ("posts", "parent_id", 3, 99, "deleted"),
        ("posts", "thread_id", 4, 13, "deleted"), ("post_categories", "post_id", 4, 4, "late"), ("post_categories", "post_id", 7, 7, "missing"),
    }
    assert sum(r.n_refs for r in references.report(posts, threads, cats, stones).collect()) == 7
    assert references.found(posts.limit(0), threads.limit(0), cats.limit(0), stones.limit(0)).count() == 0


def test_skew_join_spreads_hot_keys(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    right = spark.range(3000).selectExpr("id AS k", "id * 2 AS w")
    got = skew_join(left, right, ["k"], least=100)
    assert got.count() == 3000 and got.where("w <> 2 * k").count() == 0
    assert skew_join(left, right.where("k <> 7"), ["k"], "left", least=100).where("w IS NULL").count() == 1000 + left.where("k = 7 AND v = 7").count()


FORUM = [("t", 1, None, "Me"), ("r", 2, None, "Alice"), ("r", 3, 2, "Me"), ("r", 4, 3, "Bob"), ("r", 5, 4, "Carol"), ("r", 6, 5, "Me"), ("r", 7, None, "Blocked"), ("r", 8, 7, "Dora"), ("r", 9, 77, "Eve"), ("r", 10, None, "Me")]


def docs(spark):
    threads = spark.createDataFrame([(i, "t", "m", a, "", t(0)) for k, i, _, a in FORUM if k == "t"], "id bigint, title string, message string, author string, source_url string, ingested_at timestamp_ntz")
    posts = spark.createDataFrame([(i, 1, p, "", "m", a, None, t(i)) for k, i, p, a in FORUM if k == "r"], "id bigint, thread_id bigint, parent_id bigint, title string, message string, author string, source_url string, ingested_at timestamp_ntz")
    return documents(threads, posts)


def test_visible_and_branches(spark):
    d = docs(spark)
    assert {r.post_id for r in conversation.visible(d, ["BLÓCKED"]).collect()} == {1, 2, 3, 4, 5, 6, 10}
    assert conversation.visible(d, ["Me"], hide_threads_of_blocked_roots=True).where("kind = 'r'").count() == 0
    got = {(r.doc_key, r.type, r.answered) for r in conversation.branches(d, "me", ["blocked"]).collect()}
    assert got == {("r:2", "posts", True), ("r:4", "replies", True)}
    assert {r.doc_key for r in conversation.notifications(d, "Me").collect()} == {"r:2", "r:4", "r:5", "r:7", "r:8", "r:9"}
    paths = {(r.doc_key, r.answer_key): r.path for r in conversation.answer_paths(d).collect()}
    assert paths["r:4", "r:6"] == "carol > bob" and paths["r:2", "r:3"] == "alice"
