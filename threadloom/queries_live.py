"""Queries over live changes, lists of a reader, and the upkeep of categories, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .engine import Forum
from .functions import text as X
from .operators import categories, conversation, delta, overlay, search, state, views
from .operators.members import member_stats
from .plans import shared_folder
from .queries_forum import _LABEL, _VISIBLE, BLOCKED, _folder
from .queries_search import _POSTINGS, INDEX, _rank_sql, docs_of, index_of
from .registry import SQL, query
from .sources import sync, table
from .sqltext import DOCS, ROLLUP
from .streaming import flows

SPLIT = "2025-01-01 00:00:00"
_AT = f"TIMESTAMP '{SPLIT}'"


def _split(spark, folder):
    """Documents, those first seen before the split, and the whole of the threads that have a document after it."""
    docs = docs_of(spark, folder)
    at = F.to_timestamp_ntz(F.lit(SPLIT))
    before = docs.where(F.col("created_at") < at)
    return docs, before, docs.join(delta.thread_ids_since(docs, at), "thread_id", "left_semi").select(*docs.columns)


def _stones(spark, folder):
    return table(spark, folder, "tombstones").where("kind = 't'").groupBy(F.col("item_id").alias("thread_id")).agg(F.max("deleted_at").alias("deleted_at"))


_CHANGED = f"""{DOCS}, before_ AS (SELECT * FROM docs WHERE created_at < {_AT}), since AS (SELECT DISTINCT thread_id FROM docs WHERE created_at >= {_AT}), changed AS (SELECT * FROM docs WHERE thread_id IN (SELECT thread_id FROM since)),
stones AS (SELECT item_id AS thread_id, max(deleted_at) AS deleted_at FROM tombstones WHERE kind = 't' GROUP BY 1)"""


@query(f"WITH {_CHANGED} SELECT doc_key, thread_id, username, created_at FROM before_ WHERE thread_id IS NULL OR thread_id NOT IN (SELECT thread_id FROM since) UNION ALL SELECT doc_key, thread_id, username, created_at FROM changed")
def delta_replace(spark, folder):
    _, before, changed = _split(spark, folder)
    return delta.replace_threads(before, _stones(spark, folder), changed)[0].select("doc_key", "thread_id", "username", "created_at")


@query(f"WITH {_CHANGED} SELECT * FROM stones WHERE thread_id NOT IN (SELECT thread_id FROM since)")
def delta_revived(spark, folder):
    _, before, changed = _split(spark, folder)
    return delta.replace_threads(before, _stones(spark, folder), changed)[1]


@query(f"WITH {_CHANGED}, gone AS (SELECT DISTINCT thread_id FROM changed WHERE thread_id % 3 = 0) SELECT doc_key, thread_id FROM docs WHERE thread_id IS NULL OR thread_id NOT IN (SELECT thread_id FROM gone)")
def delta_delete(spark, folder):
    """Every third changed thread is deleted, for the tables' own tombstones rarely name threads that are there."""
    docs, _, changed = _split(spark, folder)
    gone = changed.where("thread_id % 3 = 0").groupBy("thread_id").agg(F.max("created_at").alias("deleted_at"))
    return delta.delete_threads(docs, _stones(spark, folder), gone)[0].select("doc_key", "thread_id")


@query(f"WITH {_CHANGED}, gone AS (SELECT thread_id, max(created_at) AS deleted_at FROM changed WHERE thread_id % 3 = 0 GROUP BY 1) SELECT thread_id, max(deleted_at) AS deleted_at FROM (SELECT * FROM stones UNION ALL SELECT * FROM gone) GROUP BY 1")
def delta_tombstones(spark, folder):
    docs, _, changed = _split(spark, folder)
    gone = changed.where("thread_id % 3 = 0").groupBy("thread_id").agg(F.max("created_at").alias("deleted_at"))
    return delta.delete_threads(docs, _stones(spark, folder), gone)[1]


@query(f"WITH {_CHANGED} SELECT thread_id FROM since")
def threads_since(spark, folder):
    return delta.thread_ids_since(docs_of(spark, folder), F.to_timestamp_ntz(F.lit(SPLIT)))


_LEFT = f"{DOCS.replace('docs AS (', 'every AS (', 1)}, docs AS (SELECT * FROM every WHERE thread_id IS NULL OR thread_id % 3 <> 0), {_POSTINGS}"


def _maintained(spark, folder):
    """The postings of the documents before the split, the documents after it, and the keys of every third thread, which is removed."""
    docs, before, _ = _split(spark, folder)
    return search.postings(before), docs.join(before.select("doc_key"), "doc_key", "left_anti").select(*docs.columns), docs.where("thread_id % 3 = 0").select("doc_key")


@query(f"WITH {_LEFT} SELECT field, term, doc_key, tf FROM post")
def postings_maintained(spark, folder):
    return delta.maintain_postings(*_maintained(spark, folder)).select("field", "term", "doc_key", "tf")


@query(f"WITH {_LEFT} SELECT field, term, df FROM lex")
def lexicon_maintained(spark, folder):
    posts, changed, removed = _maintained(spark, folder)
    kept = changed.join(removed, "doc_key", "left_anti").select(*changed.columns)
    return delta.maintain_lexicon(search.lexicon(posts), posts.join(removed, "doc_key", "left_semi"), search.postings(kept)).select("field", "term", "df")


def _hits_sql(where: str) -> str:
    return f"(WITH docs AS (SELECT * FROM every WHERE {where}), {_POSTINGS}, ranked AS ({_rank_sql('deposit landlord')}) SELECT d.doc_key, d.kind, d.thread_id, d.username, d.created_at, r.score FROM ranked r JOIN docs d ON d.doc_key = r.doc_key)"


@query(
    f"""WITH {DOCS.replace('docs AS (', 'every AS (', 1)}, b AS {_hits_sql(f'created_at < {_AT}')}, n AS {_hits_sql(f'created_at >= {_AT}')}, keys AS (SELECT doc_key FROM every WHERE created_at >= {_AT})
    SELECT * FROM b WHERE doc_key NOT IN (SELECT doc_key FROM keys) AND thread_id NOT IN (SELECT item_id FROM tombstones WHERE kind = 't') UNION ALL SELECT * FROM n"""
)
def merged_search_two(spark, folder):
    """Two indexes, each with its own counts."""
    docs, before, _ = _split(spark, folder)
    late = docs.where(F.col("created_at") >= F.to_timestamp_ntz(F.lit(SPLIT)))
    return delta.search_both(before, None, late, None, _stones(spark, folder), "deposit landlord").select("doc_key", "kind", "thread_id", "username", "created_at", "score")


@query(SQL["member_stats"])
def members_updated(spark, folder):
    docs, before, changed = _split(spark, folder)
    return delta.update_members(member_stats(before), before, docs, changed.select("thread_id"))


@query(SQL["thread_rollup"])
def rollup_updated(spark, folder):
    docs, before, changed = _split(spark, folder)
    return delta.update_by_thread(views.thread_rollup(before).drop("body"), docs, changed.select("thread_id"), lambda d: views.thread_rollup(d).drop("body"))


@query(
    f"""WITH {_CHANGED}, gone AS (SELECT DISTINCT thread_id FROM docs WHERE thread_id % 5 = 0), dead AS (SELECT thread_id FROM stones UNION SELECT thread_id FROM gone)
    SELECT doc_key, thread_id FROM changed WHERE thread_id NOT IN (SELECT thread_id FROM dead)"""
)
def backfill_delta(spark, folder):
    docs = docs_of(spark, folder)
    now = docs.where("thread_id IS NULL OR thread_id % 5 <> 0")
    return delta.backfill(docs, F.to_timestamp_ntz(F.lit(SPLIT)), now, _stones(spark, folder))[0].select("doc_key", "thread_id")


@query(f"WITH {DOCS} SELECT DISTINCT thread_id FROM docs WHERE thread_id % 5 = 0")
def threads_removed(spark, folder):
    """What a full comparison finds gone, where every fifth thread is."""
    docs = docs_of(spark, folder)
    return overlay.removed(docs.where("thread_id IS NULL OR thread_id % 5 <> 0").select("thread_id"), docs.where("thread_id IS NOT NULL"), "thread_id")


_PAGES = f"""{DOCS}, {ROLLUP}, t AS (SELECT (row_number() OVER (ORDER BY last_post_at DESC, thread_id DESC) - 1) // 4 + 1 AS page, last_post_at >= TIMESTAMP '2025-02-20 00:00:00' AS c FROM rollup_),
p AS (SELECT page, bool_or(c) AS changed FROM t GROUP BY page)"""


@query(
    f"""WITH {_PAGES}, n AS (SELECT page, changed, lag(changed) OVER (ORDER BY page) AS was FROM p), e AS (SELECT min(page) AS last FROM n WHERE NOT changed AND NOT was)
    SELECT p.page, p.changed FROM p, e WHERE e.last IS NULL OR p.page <= e.last"""
)
def update_pages(spark, folder):
    """Pages of four threads by activity; an update reads to the second page in a row without a change."""
    roll = views.thread_rollup(docs_of(spark, folder)).select("thread_id", "last_post_at")
    ranked = roll.withColumn("nth", F.row_number().over(_activity())).withColumn("page", F.floor((F.col("nth") - 1) / 4) + 1)
    pages = ranked.groupBy("page").agg(F.bool_or(F.col("last_post_at") >= F.to_timestamp_ntz(F.lit("2025-02-20 00:00:00"))).alias("changed"))
    return sync.until_unchanged(pages)


def _activity():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("last_post_at"), F.desc("thread_id"))


@query(
    f"""{INDEX}, ranked AS ({_rank_sql('deposit')}), hits AS (SELECT d.doc_key, d.kind, d.thread_id, d.username, d.created_at, r.score FROM ranked r JOIN docs d ON d.doc_key = r.doc_key),
    c AS (SELECT thread_id, min(CASE WHEN kind = 't' THEN title END) AS thread_title, count(*) FILTER (kind = 'r') AS reply_count FROM docs GROUP BY thread_id)
    SELECT h.*, c.thread_title, c.reply_count, c.reply_count >= 10 AS archived, (SELECT count(*) FROM hits) AS total FROM hits h LEFT JOIN c ON c.thread_id = h.thread_id ORDER BY h.score DESC, h.created_at DESC, h.doc_key LIMIT 25"""
)
def search_items(spark, folder):
    """A page of hits with their threads and the total."""
    g = index_of(spark, folder)
    return search.items(g.search("deposit"), g.read("documents"), archived_from=10)


@query(
    f"""{INDEX}, ranked AS ({_rank_sql('deposit')}), hits AS (SELECT d.doc_key, d.thread_id FROM ranked r JOIN docs d ON d.doc_key = r.doc_key)
    SELECT count(*) AS total, (SELECT count(*) FROM hits) AS of_all FROM hits WHERE thread_id % 4 <> 0 AND doc_key NOT IN (SELECT doc_key FROM docs WHERE created_at >= {_AT})"""
)
def search_suppressed(spark, folder):
    """Totals without replaced documents and every fourth thread."""
    g = index_of(spark, folder)
    docs = g.read("documents")
    late = docs.where(F.col("created_at") >= F.to_timestamp_ntz(F.lit(SPLIT)))
    kept = g.search("deposit", hidden=late, gone=docs.where("thread_id % 4 = 0").select("thread_id").distinct()).agg(F.count(F.lit(1)).alias("total"))
    return kept.join(F.broadcast(g.search("deposit").agg(F.count(F.lit(1)).alias("of_all"))))


@query(f"{INDEX} SELECT field, term, df FROM lex WHERE field = 'title' AND starts_with(term, 'ch') ORDER BY term")
def terms_of_prefix(spark, folder):
    return search.terms(index_of(spark, folder).read("lexicon"), "title", "CH").select("field", "term", "df")


@query(
    f"""WITH RECURSIVE {_VISIBLE} SELECT k.doc_key, CASE WHEN k.thread_id IN (SELECT item_id FROM tombstones WHERE kind = 't') THEN 'muted' WHEN v.doc_key IS NULL THEN 'blocked' END AS hidden
    FROM keyed k LEFT JOIN vis v ON v.doc_key = k.doc_key"""
)
def hidden_reasons(spark, folder):
    return conversation.flagged(docs_of(spark, folder), BLOCKED, _stones(spark, folder)).select("doc_key", "hidden")


# ---- lists of a reader ------------------------------------------------------------------------------------------------
def _marks(spark, folder):
    """Read marks: everything before the split was read; bodies in capitals since then have changed."""
    docs, before, _ = _split(spark, folder)
    fp = lambda df: df.select("doc_key", "thread_id", F.sha2("body", 256).alias("fp"))
    return docs, state.merge_read_state(state.merge_read_state(None, fp(before)), fp(docs))


_UNREAD = f"{DOCS}, unread AS (SELECT doc_key, thread_id, created_at FROM docs WHERE created_at IS NULL OR created_at >= {_AT})"


@query(f"WITH {_UNREAD} SELECT * FROM unread")
def unread_list(spark, folder):
    docs, marks = _marks(spark, folder)
    return state.unread_list(marks, docs)


@query(f"WITH {_UNREAD} SELECT thread_id, first(doc_key ORDER BY created_at, doc_key) AS first_unread, count(*) AS n_unread FROM unread GROUP BY thread_id")
def first_unread(spark, folder):
    docs, marks = _marks(spark, folder)
    return state.first_unread(marks, docs)


@query(f"WITH {_UNREAD} SELECT (SELECT count(*) FROM unread) AS n_unread, (SELECT count(DISTINCT thread_id) FROM unread) AS n_threads, (SELECT count(*) FROM docs) AS n_total")
def unread_totals(spark, folder):
    return state.unread_totals(_marks(spark, folder)[1])


_KEPT = "kept AS (SELECT thread_id, max(ingested_at) AS at FROM (SELECT thread_id, ingested_at FROM thread_categories WHERE source = 'manual' UNION ALL SELECT item_id, deleted_at FROM tombstones WHERE kind = 't') GROUP BY 1)"


def _kept(spark, folder):
    manual = table(spark, folder, "thread_categories").where("source = 'manual'").select("thread_id", F.col("ingested_at").alias("at"))
    return manual.unionByName(_stones(spark, folder).select("thread_id", F.col("deleted_at").alias("at"))).groupBy("thread_id").agg(F.max("at").alias("at"))


@query(
    f"""WITH {_UNREAD}, {ROLLUP}, {_KEPT}, u AS (SELECT thread_id, count(*) AS n FROM unread GROUP BY 1)
    SELECT k.thread_id, k.at, r.title, r.reply_count, r.last_post_at, coalesce(u.n, 0) AS n_unread, r.thread_id IS NULL AS missing FROM kept k LEFT JOIN rollup_ r ON r.thread_id = k.thread_id LEFT JOIN u ON u.thread_id = k.thread_id"""
)
def saved_list(spark, folder):
    """Manually labelled threads and those with a tombstone stand for saved ones."""
    docs, marks = _marks(spark, folder)
    return state.thread_list(_kept(spark, folder), views.thread_rollup(docs), marks)


@query(f"WITH {DOCS}, {ROLLUP}, {_KEPT} SELECT k.thread_id, k.at, r.title, r.thread_id IS NULL AS missing FROM kept k LEFT JOIN rollup_ r ON r.thread_id = k.thread_id ORDER BY k.at DESC, k.thread_id DESC LIMIT 10")
def muted_page(spark, folder):
    """The first ten of the muted list."""
    return state.thread_list(_kept(spark, folder), views.thread_rollup(docs_of(spark, folder))).limit(10).select("thread_id", "at", "title", "missing")


# ---- upkeep of categories ----------------------------------------------------------------------------------------------
@query(
    f"""WITH tl AS {_LABEL}, c AS (SELECT item_id AS thread_id, max(deleted_at) AS at_ FROM tombstones WHERE kind = 't' GROUP BY 1), m AS (SELECT thread_id, max(ingested_at) AS at_ FROM thread_categories WHERE source = 'manual' GROUP BY 1),
    cur AS (SELECT tl.thread_id, tl.category_id, m.at_ AS updated_at FROM tl JOIN m ON m.thread_id = tl.thread_id WHERE tl.source = 'manual'),
    chg AS (SELECT thread_id, at_, thread_id % 2 <> 0 AS law FROM c UNION ALL SELECT thread_id, updated_at, thread_id % 4 <> 0 FROM cur WHERE thread_id % 2 = 0)
    SELECT * FROM cur WHERE thread_id NOT IN (SELECT thread_id FROM chg) UNION ALL SELECT thread_id, 'law', max(at_) FROM chg GROUP BY thread_id HAVING arg_max(law, at_)"""
)
def category_override(spark, folder):
    """Manual labels; threads with a tombstone and every other labelled one get an override, half of them back to the inherited."""
    rows = table(spark, folder, "thread_categories")
    when = rows.where("source = 'manual'").groupBy("thread_id").agg(F.max("ingested_at").alias("updated_at"))
    current = categories.latest_labels(rows, "thread_id").where("source = 'manual'").join(when, "thread_id").select("thread_id", "category_id", "updated_at")
    law = lambda n: F.when(F.col("thread_id") % n != 0, F.lit("law"))
    changes = _stones(spark, folder).select("thread_id", law(2).alias("category_id"), F.col("deleted_at").alias("at")).unionByName(current.where("thread_id % 2 = 0").select("thread_id", law(4).alias("category_id"), F.col("updated_at").alias("at")))
    return categories.override(current, changes)


@query(
    """WITH s AS (SELECT thread_id, category_id, ingested_at AS submitted_at FROM thread_categories WHERE thread_id IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY submitted_at DESC, category_id DESC) AS rn FROM s),
    d AS (SELECT thread_id, min(submitted_at) AS done FROM s WHERE thread_id % 2 = 0 GROUP BY 1)
    SELECT l.thread_id, l.category_id, l.submitted_at FROM l LEFT JOIN d ON d.thread_id = l.thread_id WHERE rn = 1 AND (d.done IS NULL OR l.submitted_at > d.done)"""
)
def review_outbox(spark, folder):
    """Labels stand for reviews; the first review of every other thread was taken over."""
    rows = table(spark, folder, "thread_categories").select("thread_id", "category_id", F.col("ingested_at").alias("submitted_at"))
    outbox = categories.submit_reviews(rows.limit(0), rows)
    return categories.acknowledge(outbox, rows.where("thread_id % 2 = 0").groupBy("thread_id").agg(F.min("submitted_at").alias("submitted_at")))


_CONTEXT = """p AS (SELECT id AS post_id, min(thread_id) AS thread_id, min(CASE WHEN parent_id <> 0 THEN parent_id END) AS parent_id, min(message) AS message, min(author) AS author FROM posts WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT id AS thread_id, min(title) AS thread_title, min(message) AS thread_message FROM threads WHERE id IS NOT NULL GROUP BY id),
context AS (SELECT p.post_id, p.thread_id, p.parent_id, p.message, t.thread_title, t.thread_message, a.message AS parent_message, a.author AS parent_author FROM p JOIN t ON t.thread_id = p.thread_id LEFT JOIN p a ON a.post_id = p.parent_id)"""


@query(f"WITH {_CONTEXT} SELECT * FROM context")
def reply_context(spark, folder):
    return categories.with_context(table(spark, folder, "posts"), table(spark, folder, "threads"))


_OWN = "own AS (SELECT post_id, arg_min(source, source) AS decision, min(lower(trim(category_id))) AS category_id FROM post_categories WHERE post_id IS NOT NULL GROUP BY post_id)"


@query(f"WITH {_CONTEXT}, tl AS {_LABEL}, {_OWN} SELECT c.post_id, c.thread_id, c.parent_author, o.decision, tl.category_id AS thread_category_id FROM context c JOIN own o ON o.post_id = c.post_id JOIN tl ON tl.thread_id = c.thread_id WHERE o.decision IN ('manual', 'reply-refined')")
def refinement_candidates(spark, folder):
    decided = table(spark, folder, "post_categories").where("post_id IS NOT NULL").groupBy("post_id").agg(F.min("source").alias("decision"))
    rows = categories.refinement_candidates(reply_context(spark, folder), table(spark, folder, "thread_categories"), decided, ["manual", "reply-refined"])
    return rows.select("post_id", "thread_id", "parent_author", "decision", "thread_category_id")


@query(
    f"""WITH p AS (SELECT id AS post_id, min(thread_id) AS thread_id FROM posts WHERE id IS NOT NULL GROUP BY id), tl AS {_LABEL}, {_OWN},
    m AS (SELECT post_id, min(lower(trim(category_id))) AS c FROM post_categories WHERE source = 'manual' GROUP BY 1)
    SELECT p.post_id, coalesce(m.c, CASE WHEN o.category_id IS NOT NULL AND p.post_id % 5 IN (0, 1) THEN o.category_id WHEN o.category_id IS NOT NULL AND p.post_id % 5 = 2 THEN o.category_id END, tl.category_id, 'unsorted') AS category_id,
      CASE WHEN m.c IS NOT NULL THEN 'manual' WHEN o.category_id IS NOT NULL AND p.post_id % 5 IN (0, 1) THEN 'refined' WHEN o.category_id IS NOT NULL AND p.post_id % 5 = 2 THEN 'reused' ELSE 'pending' END AS origin
    FROM p LEFT JOIN m ON m.post_id = p.post_id LEFT JOIN own o ON o.post_id = p.post_id LEFT JOIN tl ON tl.thread_id = p.thread_id"""
)
def decision_reuse(spark, folder):
    """Of every five labelled posts two have a refinement and one a decision made from the hashes they have now; two have changed since."""
    items = table(spark, folder, "posts").where("id IS NOT NULL").groupBy(F.col("id").alias("post_id")).agg(F.min("thread_id").alias("thread_id"), F.sha2(F.coalesce(F.min("message"), F.lit("")), 256).alias("content_hash")).withColumn("context_hash", F.lit("c"))
    labels = categories.latest_labels(table(spark, folder, "thread_categories"), "thread_id").select("thread_id", F.col("category_id").alias("thread_category_id"))
    items = items.join(labels, "thread_id", "left")
    rows = table(spark, folder, "post_categories").where("post_id IS NOT NULL")
    own = rows.groupBy("post_id").agg(F.min(F.lower(F.trim("category_id"))).alias("category_id")).join(items.select("post_id", "content_hash", "context_hash"), "post_id")
    fifth = F.col("post_id") % 5
    old = own.withColumn("content_hash", F.when(fifth > 2, F.lit("before")).otherwise(F.col("content_hash")))
    return categories.reuse(items, old.where(fifth >= 2), old.where((fifth < 2) | (fifth == 4)), rows.where("source = 'manual'").select("post_id", "category_id"))


@query(
    """WITH i AS (SELECT id AS thread_id, length(coalesce(min(message), '')) AS size FROM threads WHERE id IS NOT NULL GROUP BY id), a AS (SELECT thread_id, bool_or(confidence < 0.5) AS failed, bool_or(source = 'manual') AS complete FROM thread_categories GROUP BY 1)
    SELECT i.thread_id, coalesce(a.failed, false) AS failed FROM i LEFT JOIN a ON a.thread_id = i.thread_id WHERE NOT coalesce(a.complete, false) ORDER BY coalesce(a.failed, false) DESC, i.size, i.thread_id LIMIT 60"""
)
def work_queue(spark, folder):
    items = table(spark, folder, "threads").where("id IS NOT NULL").groupBy(F.col("id").alias("thread_id")).agg(F.length(F.coalesce(F.min("message"), F.lit(""))).alias("size"))
    attempts = table(spark, folder, "thread_categories").select("thread_id", (F.col("confidence") < 0.5).alias("failed"), (F.col("source") == "manual").alias("complete"))
    return categories.work_queue(items, attempts, 60, "size").select("thread_id", "failed")


@query("SELECT CAST(coalesce(max(taxonomy_version), 0) AS BIGINT) AS version FROM post_categories")
def label_version(spark, folder):
    return categories.latest_version(table(spark, folder, "post_categories"))


@query(
    """WITH n AS (SELECT DISTINCT upper(name) AS name FROM category_taxonomy UNION SELECT DISTINCT ' ' || upper(category_id) || ' ' FROM category_taxonomy UNION SELECT DISTINCT category_id FROM thread_categories),
    k AS (SELECT lower(trim(category_id)) AS key, 0 AS r, category_id FROM category_taxonomy UNION ALL SELECT lower(trim(name)), 1, category_id FROM category_taxonomy)
    SELECT n.name, (SELECT category_id FROM k WHERE k.key = lower(trim(n.name)) ORDER BY r, category_id LIMIT 1) AS category_id FROM n"""
)
def category_names(spark, folder):
    tax = table(spark, folder, "category_taxonomy")
    names = tax.select(F.upper("name").alias("name")).union(tax.select(F.concat(F.lit(" "), F.upper("category_id"), F.lit(" ")))).union(table(spark, folder, "thread_categories").select("category_id")).distinct()
    return categories.resolve_ids(names, tax)


@query(
    f"""{INDEX}, ranked AS ({_rank_sql('deposit')}), tl AS {_LABEL}, c AS (SELECT lower(category_id) AS id FROM category_taxonomy WHERE lower(name) = (SELECT lower(min(name)) FROM category_taxonomy WHERE category_id = 'law/tenancy'))
    SELECT d.doc_key, d.thread_id, r.score FROM ranked r JOIN docs d ON d.doc_key = r.doc_key JOIN tl ON tl.thread_id = d.thread_id WHERE tl.category_id IN (SELECT id FROM c) ORDER BY r.score DESC, d.created_at DESC, d.doc_key LIMIT 25"""
)
def search_category(spark, folder):
    """A search within a category named by its label."""
    tax = table(spark, folder, "category_taxonomy")
    forum = Forum(docs_of(spark, folder), thread_labels=table(spark, folder, "thread_categories"), taxonomy=tax)
    label = tax.where("category_id = 'law/tenancy'").agg(F.min("name")).first()[0]
    return forum.search(f'category:"{(label or "law/tenancy").upper()}" deposit').select("doc_key", "thread_id", "score")


@query(
    f"""WITH p AS (SELECT id AS post_id FROM posts WHERE id IS NOT NULL GROUP BY id), r AS ({SQL['category_resolve']}), x AS (SELECT post_id, category_id FROM r WHERE post_id % 7 <> 0 UNION ALL SELECT post_id, category_id FROM r WHERE post_id % 11 = 0 AND post_id % 7 <> 0 UNION ALL SELECT -1, 'nonsense'),
    f AS (SELECT 'uncovered' AS fault, count(*) AS n FROM p WHERE post_id NOT IN (SELECT post_id FROM x) UNION ALL SELECT 'unknown post', count(*) FROM x WHERE post_id NOT IN (SELECT post_id FROM p)
      UNION ALL SELECT 'repeated', count(*) FROM (SELECT post_id FROM x GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown category', count(*) FROM x WHERE lower(trim(category_id)) NOT IN (SELECT lower(trim(category_id)) FROM category_taxonomy))
    SELECT * FROM f WHERE n > 0"""
)
def publish_check(spark, folder):
    """The faults of a map that lacks every seventh post, repeats every eleventh and has one that is not there."""
    posts, tax = table(spark, folder, "posts"), table(spark, folder, "category_taxonomy")
    own = categories.resolve(posts, table(spark, folder, "thread_categories"), table(spark, folder, "post_categories")).select("post_id", "category_id").where("post_id % 7 <> 0")
    odd = spark.createDataFrame([(-1, "nonsense")], "post_id bigint, category_id string")
    return categories.publish_faults(own.unionByName(own.where("post_id % 11 = 0")).unionByName(odd), posts, tax)


# ---- texts -------------------------------------------------------------------------------------------------------------
def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unescaped_sql(x: str) -> str:
    names = ", ".join(f"{_quoted(n)}: {_quoted(c)}" for n, c in X.named_entities().items())
    body = "regexp_extract(p, '^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);', 1)"
    number = f"CASE WHEN regexp_matches({body}, '^#[xX]') THEN CAST('0x' || substring({body}, 3) AS BIGINT) WHEN starts_with({body}, '#') THEN CAST(substring({body}, 2) AS BIGINT) END"
    plain = f"CASE WHEN starts_with({body}, '#') THEN chr(CAST({number} AS INT)) WHEN {body} <> '' THEN MAP {{{names}}}[{body}] END"
    return f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: CASE WHEN {plain} IS NOT NULL THEN {plain} || substring(p, length({body}) + 2) ELSE '&' || p END), ''))"


@query(f"WITH {DOCS}, d AS (SELECT doc_key, regexp_replace(body, '<[^>]*>', ' ', 'g') AS bare FROM docs) SELECT doc_key, trim(regexp_replace({unescaped_sql('bare')}, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS plain FROM d")
def plain_text(spark, folder):
    """Bodies without tags, with all entities decoded."""
    return docs_of(spark, folder).select("doc_key", X.plain_text("body").alias("plain"))


@query("SELECT DISTINCT CAST(ingested_at AS DATE) AS day, '8.1.' || day(ingested_at) || '+' || strftime(ingested_at, '%Y%m%d') AS title FROM threads")
def release_titles(spark, folder):
    day = F.to_date("ingested_at")
    return table(spark, folder, "threads").select(day.alias("day"), X.release_title(F.concat(F.lit("8.1."), F.dayofmonth("ingested_at").cast("string")), "ingested_at").alias("title")).distinct()


# ---- streams of several batches ---------------------------------------------------------------------------------------
_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def _batches(spark, folder):
    """The events as a stream of three files in the order of time, one to a batch, and the folder of its state."""
    own, events = _folder(spark), table(spark, folder, "events")
    at = [F.to_timestamp_ntz(F.lit(x)) for x in _CUTS]
    for part in (F.col("ts") < at[0], (F.col("ts") >= at[0]) & (F.col("ts") < at[1]), F.col("ts") >= at[1]):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{own}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{own}/in"), f"{own}/{uuid.uuid4().hex}"


@query(
    f"""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts < TIMESTAMP '{_CUTS[0]}' THEN 0 ELSE 1 END AS later FROM events), f AS (SELECT user_id, max(ts) FILTER (later = 0) AS base, max(ts) AS last FROM e GROUP BY 1)
    SELECT 'r:' || user_id AS doc_key, user_id % 20 AS thread_id, base IS NOT NULL AND base = last AS is_read FROM f"""
)
def stream_read_batches(spark, folder):
    """Read marks over three batches: the first is the baseline, what comes or changes later is unread."""
    stream, own = _batches(spark, folder)
    ev = stream.select(F.concat(F.lit("r:"), "user_id").alias("doc_key"), (F.col("user_id") % 20).alias("thread_id"), F.col("ts").cast("string").alias("fp"), F.col("ts").alias("at"))
    return flows.read_state(ev, own).select("doc_key", "thread_id", F.col("read_fp").eqNullSafe(F.col("current_fp")).alias("is_read"))


@query(f"SELECT 'r:' || event_id AS doc_key, ts AS created_at, ts < TIMESTAMP '{_CUTS[0]}' AS read, ts < TIMESTAMP '{_CUTS[0]}' AS dismissed FROM events WHERE event_type = 'signup' ORDER BY ts DESC, 1 DESC LIMIT 1000")
def stream_notification_batches(spark, folder):
    stream, own = _batches(spark, folder)
    return flows.notifications(stream.where("event_type = 'signup'").select(F.concat(F.lit("r:"), "event_id").alias("doc_key"), F.col("ts").alias("created_at")), own)


@query(
    """WITH v AS (SELECT 'r:' || event_id AS doc_key, user_id AS thread_id, CAST(ts AS DATE) AS day FROM events), l AS (SELECT thread_id, max(day) AS day FROM v GROUP BY 1)
    SELECT v.doc_key, v.thread_id FROM v JOIN l ON l.thread_id = v.thread_id AND l.day = v.day"""
)
def stream_live_delta(spark, folder):
    """Each day's events of a user stand for a delivery of a thread: the last delivery replaces all before."""
    stream, own = _batches(spark, folder)
    docs = stream.select(F.concat(F.lit("r:"), "event_id").alias("doc_key"), F.col("user_id").alias("thread_id"), F.to_date("ts").alias("ingested_at"))
    return flows.live_delta(docs, own).select("doc_key", "thread_id")


@query(
    f"""WITH e AS (SELECT user_id, ts FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, max(ts) AS ts FROM e WHERE ts < TIMESTAMP '{_CUTS[1]}' GROUP BY user_id HAVING user_id % 4 <> 0"""
)
def keyed_store(spark, folder):
    """A keyed table after two changes and a removal of every fourth key."""
    from .sources.stores import KeyedStore

    events = table(spark, folder, "events").where("event_type IN ('click', 'view')").select("user_id", "ts")
    store = KeyedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "user_id", 8)
    at = [F.to_timestamp_ntz(F.lit(x)) for x in _CUTS]
    store.upsert(events.where(F.col("ts") < at[0]), "ts")
    store.upsert(events.where((F.col("ts") >= at[0]) & (F.col("ts") < at[1])), "ts")
    return store.remove(events.where("user_id % 4 = 0").select("user_id"))
