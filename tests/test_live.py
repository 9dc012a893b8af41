"""Live changes, keyed stores, imports, published maps."""

import datetime as dt
import json
import threading
import time

import pytest

from pyspark.sql import functions as F
from threadloom.engine import Forum
from threadloom.functions import text as X
from threadloom.operators import categories, conversation, delta, hierarchy, search, state
from threadloom.sources import interchange, stores, sync
from threadloom.streaming import flows

DOC = "doc_key string, kind string, post_id bigint, thread_id bigint, parent_post_id bigint, username string, title string, body string, created_at timestamp_ntz, board string"


def doc(kind, post, thread, day, body="text", user="ann", parent=None):
    return (f"{kind}:{post}", kind, post, thread, parent, user, "", body, dt.datetime(2024, 1, day), "b")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([doc("t", 1, 1, 1), doc("r", 5, 1, 2, "old bread"), doc("r", 6, 1, 3, "more", "bob"), doc("t", 2, 2, 4, "rye"), (*doc("r", 9, 0, 5)[:3], None, *doc("r", 9, 0, 5)[4:])], DOC)


def keys(df):
    return {r.doc_key for r in df.collect()}


def test_threads_are_replaced_and_deleted_whole(spark, docs):
    stones = spark.createDataFrame([(1, dt.datetime(2024, 2, 1)), (7, dt.datetime(2024, 2, 1))], "thread_id bigint, deleted_at timestamp_ntz")
    new = spark.createDataFrame([doc("t", 1, 1, 9), doc("r", 8, 1, 9)], DOC)
    after, left = delta.replace_threads(docs, stones, new)
    assert keys(after) == {"t:1", "r:8", "t:2", "r:9"} and [r.thread_id for r in left.collect()] == [7]
    gone = spark.createDataFrame([(2, dt.datetime(2024, 3, 1)), (7, dt.datetime(2024, 3, 1))], stones.schema)
    after, left = delta.delete_threads(after, left, gone)
    assert keys(after) == {"t:1", "r:8", "r:9"} and {(r.thread_id, r.deleted_at.month) for r in left.collect()} == {(2, 3), (7, 3)}
    assert delta.replace_threads(docs.limit(0), stones.limit(0), new.limit(0))[0].count() == 0
    assert {r.thread_id for r in delta.thread_ids_since(docs, dt.datetime(2024, 1, 4)).collect()} == {2, None}


def test_postings_are_kept_up_to_date(spark, docs):
    new = spark.createDataFrame([doc("r", 5, 1, 2, "new rye bread")], DOC)
    removed = spark.createDataFrame([("r:6",)], "doc_key string")
    posts = delta.maintain_postings(search.postings(docs), new, removed)
    whole = docs.where("doc_key NOT IN ('r:5', 'r:6')").unionByName(new)
    rows = lambda df: sorted((r.field, r.term, r.doc_key, r.tf, tuple(r.positions)) for r in df.collect())
    assert rows(posts) == rows(search.postings(whole))
    stale = search.postings(docs).where("doc_key IN ('r:5', 'r:6')")
    lex = delta.maintain_lexicon(search.lexicon(search.postings(docs)), stale, search.postings(new))
    assert sorted(map(tuple, lex.collect())) == sorted(map(tuple, search.lexicon(posts).select(*lex.columns).collect()))


def test_sums_under_nodes_match_brute_force(spark):
    import random

    rng = random.Random(5)
    parent = {i: rng.choice([None, 0, *range(1, i)]) if i > 1 else None for i in range(1, 120)} | {i: i - 1 for i in range(120, 420)} | {500: 501, 501: 500, 502: 501}
    rows = [(i, p, (i * 7) % 50 or None) for i, p in parent.items()] + [(None, 1, 3), (3, parent[3], 21)]
    df = spark.createDataFrame(rows, "id bigint, parent_id bigint, v bigint")
    under: dict[int, list[int]] = {}
    for i in range(1, 420):
        p = parent[i]
        while p in parent:
            under.setdefault(p, []).append(i)
            p = parent[p]
    assert {r.id: r.below for r in hierarchy.below(df).collect()} == {p: len(x) for p, x in under.items()}
    value = {i: (i * 7) % 50 or None for i in parent} | {3: 21}
    want = {p: max((value[i] for i in x if value[i]), default=None) for p, x in under.items()}
    assert {r.id: r.below for r in hierarchy.below(df, value=F.col("v"), how="max").collect()} == {p: v for p, v in want.items() if v is not None}
    assert hierarchy.below(df.limit(0)).count() == 0


def test_records_and_stores(spark, tmp_path):
    r = stores.Record(spark, str(tmp_path / "rec"), "_X")
    assert r.read() is None
    for i in range(4):
        r.write({"n": i})
    assert r.read() == {"n": 3} and len(r.numbers()) == 2
    (tmp_path / "rec/_X.000000000009.next").write_text("half of a wri")  # a crash before the rename
    assert r.read() == {"n": 3}
    store = stores.KeyedStore(spark, str(tmp_path / "kv"), "k", 4)
    assert store.read() is None and store.remove(spark.createDataFrame([(1,)], "k bigint")) is None
    make = lambda rows: spark.createDataFrame(rows, "k bigint, at bigint, v string")
    store.upsert(make([(i, 1, "a") for i in range(20)]))
    store.upsert(make([(3, 2, "b"), (30, 2, "b")]))
    got = {x.k: x.v for x in store.read().collect()}
    assert len(got) == 21 and got[3] == got[30] == "b" and got[4] == "a"
    store.remove(make([(3, 0, ""), (99, 0, "")]).select("k"))
    assert 3 not in {x.k for x in store.read().collect()} and store.read().count() == 20
    store.upsert(make([(4, 0, "late"), (5, 9, "new")]), "at")
    got = {x.k: x.v for x in store.read().collect()}
    assert got[4] == "a" and got[5] == "new"
    n = store.record.numbers()[-1]
    store.upsert(make([(6, 9, "x")]), "at", n)  # the same change again, otherwise
    got = {x.k: x.v for x in store.read().collect()}
    assert got[6] == "x" and got[5] == "a" and len(store.record.numbers()) == 2
    assert len([p for p in (tmp_path / "kv").iterdir() if p.name.startswith("v")]) <= 8
    store.clear()
    assert store.read() is None


def test_importer_goes_on_where_it_stopped(spark, tmp_path):
    pages = {p: [(p * 10 + i, f"t{p}") for i in range(3)] for p in range(1, 6)}
    fails = {3}

    def fetch(p):
        if p in fails:
            fails.discard(p)
            raise OSError("offline")
        return pages.get(p, [])

    imp = sync.Importer(spark, str(tmp_path / "imp"), "thread_id bigint, title string")
    assert imp.read().count() == 0
    assert imp.run(fetch) | {"error": "offline", "phase": "paused", "next_page": 3} == imp.state()
    assert imp.run(fetch, 1)["next_page"] == 4 and imp.run(fetch)["phase"] == "complete"
    assert imp.read().count() == 15
    known = imp.read().select("thread_id", "title")
    asked = []

    def newest(p):
        asked.append(p)
        return {1: [(11, "t1"), (90, "new")], 2: [(10, "t1")], 3: [(12, "t1")], 4: [(20, "changed")]}.get(p, [])

    changed, removed = imp.update(newest, known, ["title"], dt.datetime(2024, 1, 3), full=False)
    assert {r.thread_id for r in changed.collect()} == {90} and asked == [1, 2, 3] and removed.count() == 0
    changed, removed = imp.update(newest, known, ["title"], dt.datetime(2024, 1, 4))  # never compared in full before
    assert {r.thread_id for r in changed.collect()} == {90, 20} and removed.count() == 11
    assert imp.state()["reconciled"] == "2024-01-04T00:00:00" and not sync.due(imp.state()["reconciled"], dt.datetime(2024, 1, 10), days=7)
    imp.pause()
    assert imp.state()["phase"] == "paused"
    imp.clear()
    assert imp.state()["phase"] == "idle"


def test_pages_until_two_are_unchanged(spark):
    pages = lambda s: spark.createDataFrame([(i, c == "x") for i, c in enumerate(s, 1)], "page int, changed boolean")
    for given, read in (("xx..x", 4), ("..xxx", 2), (".x.x.x", 6), ("x.x..", 5), ("", 0)):
        assert sync.until_unchanged(pages(given)).count() == read, given


def test_overlapping_calls_run_once():
    flight, runs, out = sync.SingleFlight(), [], []

    def work():
        runs.append(1)
        time.sleep(0.3)
        return len(runs)

    threads = [threading.Thread(target=lambda: out.append(flight("a", work))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out == [1] * 4 and flight("a", work) == 2
    with pytest.raises(ZeroDivisionError):
        flight("b", lambda: 1 / 0)


def test_published_maps(spark, tmp_path):
    posts = spark.createDataFrame([(1, 1), (2, 1)], "id bigint, thread_id bigint")
    tax = spark.createDataFrame([("law",), ("unsorted",)], "category_id string")
    threads = spark.createDataFrame([(1, "law")], "thread_id bigint, category_id string")
    resolved = spark.createDataFrame([(1, "law"), (2, "Unsorted ")], "post_id bigint, category_id string")
    m = interchange.CategoryMap(spark, str(tmp_path / "map"), b"secret")
    bundled = spark.createDataFrame([(1, "bundled")], "thread_id bigint, category_id string")
    assert m.load("threads", bundled).first().category_id == "bundled"
    m.publish(threads, resolved, resolved.where("post_id = 2"), posts, tax)
    assert m.load("threads", bundled).first().category_id == "law" and m.load("replies").count() == 1
    with pytest.raises(ValueError, match="uncovered"):
        m.publish(threads, resolved.limit(0), resolved, posts, tax)
    assert interchange.CategoryMap(spark, str(tmp_path / "map"), b"other").load("threads", bundled).first().category_id == "bundled"
    bundled.write.mode("append").json(str(tmp_path / "map/m1/threads"))
    assert m.load("threads", bundled).first().category_id == "bundled"
    interchange.write_report(spark, str(tmp_path / "r.json"), a=threads, b=resolved)
    assert json.loads((tmp_path / "r.json").read_text())["a"] == [{"thread_id": 1, "category_id": "law"}]
    with pytest.raises(ValueError):
        interchange.write_report(spark, str(tmp_path / "r.json"), a=spark.range(10_001))


def test_categories_upkeep(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    cur = spark.createDataFrame([(1, "law", day(1)), (2, "sport", day(1))], "thread_id bigint, category_id string, updated_at timestamp_ntz")
    ch = spark.createDataFrame([(1, None, day(3)), (1, "art", day(2)), (3, " Art ", day(2)), (None, "x", day(2))], "thread_id bigint, category_id string, at timestamp_ntz")
    assert {(r.thread_id, r.category_id) for r in categories.override(cur, ch).collect()} == {(2, "sport"), (3, "art")}
    out = spark.createDataFrame([(1, "a", day(1)), (2, "b", day(5))], "thread_id bigint, category_id string, submitted_at timestamp_ntz")
    box = categories.submit_reviews(out, spark.createDataFrame([(1, "c", day(4)), (None, "z", day(4))], out.schema))
    assert {(r.thread_id, r.category_id) for r in categories.acknowledge(box, out).collect()} == {(1, "c")}
    tax = spark.createDataFrame([("law/x", "Law of X"), ("y", "law/x"), (None, "n")], "category_id string, name string")
    names = spark.createDataFrame([(" LAW/X",), ("law of x",), ("?",), (None,)], "name string")
    assert {r.name: r.category_id for r in categories.resolve_ids(names, tax).collect()} == {" LAW/X": "law/x", "law of x": "law/x", "?": None, None: None}
    assert categories.latest_version(tax.limit(0).withColumn("taxonomy_version", F.lit(1))).first().version == 0


def test_entities(spark):
    cases = {"a &amp; b": "a & b", "&#64;&#x41;&#X1F600;": "@A😀", "&eacute;&nope; &": "é&nope; &", "&amp;lt;": "&lt;", "&#0;&#xD800;": "��", "x": "x", None: None, "": "", "&": "&", "&&amp;": "&&"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.withColumn("y", X.unescaped("x")).collect()} == cases
    got = df.limit(0).unionByName(spark.createDataFrame([("<p>a&nbsp; b</p>&lt;c&gt;",)], "x string")).select(X.clean_text("x", 4)).first()[0]
    assert got == "a b "[:4].rstrip() + " " or got == "a b <"[:4]


def test_lists_and_filters(spark, docs):
    marks = state.merge_read_state(state.merge_read_state(None, docs.where("post_id < 6").selectExpr("doc_key", "thread_id", "body AS fp")), docs.selectExpr("doc_key", "thread_id", "body AS fp"))
    assert [r.doc_key for r in state.unread_list(marks, docs).collect()] == ["r:9", "r:6"]
    assert {(r.thread_id, r.first_unread) for r in state.first_unread(marks, docs).collect()} == {(1, "r:6"), (None, "r:9")}
    labels = spark.createDataFrame([(1, "law/x", 1.0, "manual")], "thread_id bigint, category_id string, confidence double, source string")
    tax = spark.createDataFrame([("law/x", "Law of X")], "category_id string, name string")
    forum = Forum(docs, thread_labels=labels, taxonomy=tax)
    assert keys(forum.search('category:"law of x" bread')) == {"r:5"} and keys(forum.search("category:law/x rye")) == set() and keys(forum.search("rye")) == {"t:2"}
    with pytest.raises(ValueError):
        forum.search("category:law/x")
    with pytest.raises(ValueError):
        forum.navigation_target("x:1")
    kept = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (77, dt.datetime(2024, 1, 2))], "thread_id bigint, at timestamp_ntz")
    assert [(r.thread_id, r.missing, r.n_unread) for r in forum.saved(kept, marks).collect()] == [(77, True, 0), (1, False, 1)]
    assert search.highlight_terms('category:law title:Bread "rye bread" a ' + " ".join(f"w{i}" for i in range(30)))[:3] == ["bread", "rye", "w0"]
    assert search.search(docs, "email:ann").count() == 0


def test_shown_documents_and_bounds(spark, docs):
    marks = state.merge_read_state(None, docs.selectExpr("doc_key", "thread_id", "body AS fp"))
    shown = spark.createDataFrame([("r:5", 1, "newer"), ("r:77", 7, "x")], "doc_key string, thread_id bigint, fp string")
    after = state.present(marks, shown)
    assert after.count() == 6 and after.where("doc_key = 'r:5' AND read_fp = 'newer' AND source = 'presented'").count() == 1
    kept = state.merge_read_state(after, docs.where("doc_key <> 'r:5'").selectExpr("doc_key", "thread_id", "body AS fp"))
    assert {"r:5", "r:77"} <= keys(kept)
    assert keys(state.bounded(after, docs, 2)) == {"r:9", "t:2"}
    with pytest.raises(ValueError):
        state.present(marks, shown, 1)


def test_lookups_refuse_rather_than_cut(spark, docs):
    lex = search.lexicon(search.postings(docs))
    assert [r.term for r in search.terms(lex, "body", "B").collect()] == ["bread"] and search.term_info(lex, "body", "Rye").first().df == 1
    with pytest.raises(ValueError):
        search.terms(lex, "body", "", 2)
    assert {r.doc_key: r.hidden for r in conversation.flagged(docs, ["bob"]).collect()}["r:6"] == "blocked"
    forum = Forum(docs)
    assert forum.navigate("r:5")["thread_title"] == ""
    with pytest.raises(LookupError):
        forum.navigate("r:9")


def test_links_and_exports(spark, tmp_path):
    df = spark.createDataFrame([('see <a href="https://a.example/x?a=1&amp;b=2">the <b>page</b></a>, https://b.example/y. <a href="javascript:1">no</a>',), (None,)], "x string")
    assert [tuple(p) for p in df.select(X.link_parts("x").alias("p")).first().p] == [("the page", "https://a.example/x?a=1&b=2"), ("https://b.example/y", "https://b.example/y")]
    rows = [{"type": "header", "schemaVersion": 2, "threadCount": 1}, {"type": "thread", "thread": {"threadId": 1, "title": "a"}}, {"type": "termShard", "field": "body", "prefix": "bre", "postings": [{"term": "breads", "docs": ["t:1"]}, {"term": "bread", "docs": ["t:1"]}]}]
    path = tmp_path / "x.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    from threadloom.sources import archive

    found = archive.verify_export(spark, str(path))
    assert found["threads"] == 1 and archive.verify_export(spark, str(path), **found) == found
    for wrong in ({"size": 1}, {"sha256": "0"}, {"threads": 2}):
        with pytest.raises(ValueError):
            archive.verify_export(spark, str(path), **wrong)
    assert [r.fault for r in archive.shard_faults(archive.bootstrap(spark, str(path))[2]).collect()] == ["order"]


def test_live_delta_stream(spark, tmp_path):
    schema = "doc_key string, thread_id bigint, ingested_at bigint"
    for rows in ([("t:1", 1, 1), ("r:2", 1, 1), ("t:5", 5, 1)], [("t:1", 1, 2), ("r:3", 1, 2)], [("r:2", 1, 1), ("t:6", 6, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert keys(flows.live_delta(stream, str(tmp_path / "own"))) == {"t:1", "r:3", "t:5", "t:6"}
    last = lambda prior, batch: state.last_write_wins(batch if prior is None else prior.unionByName(batch), "doc_key", "ingested_at")
    query = flows.keep_running(stream, str(tmp_path / "on"), last, "doc_key", "1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    store = stores.KeyedStore(spark, str(tmp_path / "on/state"), "doc_key")
    assert {r.doc_key: r.ingested_at for r in store.read().collect()} == {"t:1": 2, "r:2": 1, "r:3": 2, "t:5": 1, "t:6": 3}
