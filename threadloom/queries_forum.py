"""Queries over conversations, members, views, categories, state and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as X
from .operators import categories, conversation, members, state, views
from .queries_search import docs_of
from .plans import bounded_broadcast, shared_folder
from .registry import query
from .sources import table
from .sqltext import DOCS, KEYED, ROLLUP, collapsed, norm
from .streaming import flows

ME, BLOCKED = "tealrooferban", ["BrassVicarban", "salt-acrobatban", "gravelpainterban"]
_BAD = "member IN ('brassvicarban', 'salt-acrobatban', 'gravelpainterban')"

_VISIBLE = f"""{DOCS}, {KEYED},
seen AS (
  SELECT post_id FROM keyed WHERE kind = 'r' AND parent_post_id IS NULL AND NOT {_BAD}
  UNION ALL
  SELECT c.post_id FROM seen s JOIN keyed p ON p.kind = 'r' AND p.post_id = s.post_id JOIN keyed c ON c.kind = 'r' AND c.parent_post_id = p.post_id AND c.thread_id = p.thread_id AND NOT (c.{_BAD})),
vis AS (SELECT k.* FROM keyed k WHERE (kind = 't' AND NOT {_BAD}) OR (kind = 'r' AND post_id IN (SELECT post_id FROM seen)))"""

_PAIRS = """walk AS (
  SELECT c.post_id AS descendant_id, c.parent_post_id AS ancestor_id, 1 AS distance FROM own c JOIN own p ON p.post_id = c.parent_post_id
  UNION ALL
  SELECT w.descendant_id, p.parent_post_id, w.distance + 1 FROM walk w JOIN own p ON p.post_id = w.ancestor_id JOIN own g ON g.post_id = p.parent_post_id WHERE w.distance < 300),
looped AS (SELECT DISTINCT descendant_id FROM walk WHERE distance >= 300),
pairs AS (SELECT * FROM walk WHERE descendant_id NOT IN (SELECT descendant_id FROM looped))"""


@query(f"WITH RECURSIVE {_VISIBLE} SELECT doc_key FROM vis")
def visible_subtree(spark, folder):
    return conversation.visible(docs_of(spark, folder), BLOCKED).select("doc_key")


@query(f"WITH RECURSIVE {_VISIBLE} SELECT doc_key FROM vis WHERE thread_id IS NULL OR thread_id NOT IN (SELECT thread_id FROM keyed WHERE kind = 't' AND {_BAD})")
def privacy_filter(spark, folder):
    return conversation.visible(docs_of(spark, folder), BLOCKED, hide_threads_of_blocked_roots=True).select("doc_key")


@query(f"WITH {DOCS} SELECT parent_post_id AS post_id, count(*) AS n_children FROM docs WHERE parent_post_id IS NOT NULL GROUP BY 1")
def child_counts(spark, folder):
    return conversation.child_counts(docs_of(spark, folder))


@query(f"WITH RECURSIVE {DOCS}, own AS (SELECT post_id, parent_post_id FROM docs WHERE kind = 'r'), {_PAIRS} SELECT ancestor_id AS post_id, count(*) AS n_descendants FROM pairs GROUP BY 1")
def descendant_counts(spark, folder):
    return conversation.descendant_counts(docs_of(spark, folder))


@query(
    f"""WITH RECURSIVE {_VISIBLE}, own AS (SELECT * FROM vis WHERE kind = 'r'), {_PAIRS},
    mine AS (SELECT CASE WHEN kind = 't' THEN 't:' ELSE 'r:' END || post_id AS target, CASE WHEN kind = 't' THEN 'posts' ELSE 'replies' END AS type FROM vis WHERE member = '{ME}'),
    inc AS (SELECT o.doc_key, o.post_id, m.type, o.created_at FROM own o JOIN mine m ON m.target = coalesce('r:' || o.parent_post_id, 't:' || o.thread_id) WHERE o.member <> '{ME}'),
    ans AS (SELECT p.ancestor_id, max(o.created_at) AS answered_at FROM pairs p JOIN own o ON o.post_id = p.descendant_id WHERE o.member = '{ME}' GROUP BY 1)
    SELECT i.doc_key, i.type, coalesce(a.answered_at > i.created_at, false) AS answered, i.created_at FROM inc i LEFT JOIN ans a ON a.ancestor_id = i.post_id"""
)
def unanswered_branches(spark, folder):
    return conversation.branches(docs_of(spark, folder), ME, BLOCKED)


@query(
    f"""WITH RECURSIVE {DOCS}, {KEYED}, own AS (SELECT post_id, parent_post_id, thread_id, member, created_at FROM keyed WHERE kind = 'r'), {_PAIRS},
    people AS (SELECT 't:' || post_id AS target, member AS recipient FROM keyed WHERE kind = 't' UNION ALL SELECT 'r:' || post_id, member FROM own),
    inc AS (SELECT o.post_id, p.recipient, o.created_at FROM own o JOIN people p ON p.target = coalesce('r:' || o.parent_post_id, 't:' || o.thread_id) WHERE o.member <> '' AND p.recipient <> '' AND o.member <> p.recipient),
    hit AS (SELECT i.post_id, i.recipient, a.post_id AS answer, w.distance FROM inc i JOIN pairs w ON w.ancestor_id = i.post_id JOIN own a ON a.post_id = w.descendant_id AND a.member = i.recipient AND a.created_at > i.created_at)
    SELECT 'r:' || h.post_id AS doc_key, h.recipient, 'r:' || h.answer AS answer_key, string_agg(o.member, ' > ' ORDER BY w.distance) AS path
    FROM hit h JOIN pairs w ON w.descendant_id = h.answer AND w.distance <= h.distance JOIN own o ON o.post_id = w.ancestor_id GROUP BY 1, 2, 3"""
)
def answer_paths(spark, folder):
    return conversation.answer_paths(docs_of(spark, folder))


@query(
    f"""WITH {DOCS}, n AS (SELECT *, lower(trim(username)) AS who FROM docs)
    SELECT doc_key, thread_id, created_at, substring({collapsed('body')}, 1, 240) AS snippet FROM n WHERE kind = 'r' AND who <> '{ME}'
    AND (thread_id IN (SELECT thread_id FROM n WHERE kind = 't' AND who = '{ME}') OR parent_post_id IN (SELECT post_id FROM n WHERE kind = 'r' AND who = '{ME}'))"""
)
def notification_candidates(spark, folder):
    return conversation.notifications(docs_of(spark, folder), ME)


@query(f"WITH {DOCS}, {ROLLUP} SELECT thread_id, title, username, created_at, reply_count, last_post_at FROM rollup_")
def thread_rollup(spark, folder):
    return views.thread_rollup(docs_of(spark, folder)).drop("body")


@query(f"WITH {DOCS}, {ROLLUP} SELECT thread_id, created_at FROM rollup_ WHERE reply_count = 0")
def unloved_threads(spark, folder):
    return views.unloved(views.thread_rollup(docs_of(spark, folder))).select("thread_id", "created_at")


@query(f"WITH {DOCS}, {ROLLUP} SELECT thread_id, reply_count FROM rollup_ WHERE reply_count = 7")
def archived_threads(spark, folder):
    return views.archived(views.thread_rollup(docs_of(spark, folder)), 7).select("thread_id", "reply_count")


for _sort, _sql in (("datedesc", "thread_id = 150 DESC, last_post_at DESC, thread_id DESC"), ("postedby", f"trim({norm('username')}), thread_id"), ("subject", f"trim({norm('title')}), thread_id"), ("subjectdesc", f"trim({norm('title')}) DESC, thread_id DESC"), ("sizedesc", "reply_count DESC, thread_id DESC")):

    def _classic(spark, folder, _sort=_sort):
        return views.classic(views.thread_rollup(docs_of(spark, folder)), _sort, 25, 25 if _sort == "sizedesc" else 0, 150).select("thread_id", "title", "reply_count")

    _classic.__name__ = f"classic_{_sort}"
    query(f"WITH {DOCS}, {ROLLUP} SELECT thread_id, title, reply_count FROM rollup_ ORDER BY {_sql} LIMIT 25 OFFSET {25 if _sort == 'sizedesc' else 0}")(_classic)


@query(f"WITH {DOCS}, {KEYED} SELECT t.thread_id FROM keyed t WHERE t.kind = 't' AND NOT {_BAD} AND t.thread_id NOT IN (SELECT item_id FROM tombstones WHERE kind = 't')")
def unmuted_catalogue(spark, folder):
    roll = views.unblocked(views.thread_rollup(docs_of(spark, folder)), BLOCKED)
    return views.unmuted(roll, table(spark, folder, "tombstones").where("kind = 't'").select(F.col("item_id").alias("thread_id"))).select("thread_id")


@query(
    f"""WITH {DOCS}, {ROLLUP}, z AS (SELECT thread_id, row_number() OVER (ORDER BY thread_id) - 1 AS rn, count(*) OVER () AS n FROM rollup_ WHERE reply_count = 0)
    SELECT thread_id FROM z ORDER BY (rn - {X.fnv1a('spring')} % n + n) % n LIMIT 20"""
)
def backfill_sample(spark, folder):
    return views.backfill(views.thread_rollup(docs_of(spark, folder)), "spring", 20)


@query(f"WITH {DOCS}, r AS (SELECT thread_id, post_id, length(body) AS size, row_number() OVER (PARTITION BY thread_id ORDER BY length(body) DESC, post_id) AS rank FROM docs WHERE kind = 'r' AND length(body) > 40) SELECT thread_id, CAST(rank AS INT) AS rank, post_id, CAST(size AS INT) AS size FROM r WHERE rank <= 8")
def top8_longest_per_thread(spark, folder):
    return views.longest_replies(docs_of(spark, folder))


@query(
    f"""WITH {DOCS}, {KEYED}, s AS (SELECT member, trim(username) AS display, max(created_at) AS at_ FROM keyed WHERE member <> '' GROUP BY ALL), best AS (SELECT member, display, row_number() OVER (PARTITION BY member ORDER BY at_ DESC, display) AS rn FROM s),
    a AS (SELECT member, count(*) FILTER (kind = 't') AS n_topics, count(*) FILTER (kind = 'r') AS n_replies, max(CASE WHEN kind = 't' THEN created_at END) AS latest_topic, max(CASE WHEN kind = 'r' THEN created_at END) AS latest_reply, max(created_at) AS last_active FROM keyed WHERE member <> '' GROUP BY member)
    SELECT a.member, b.display AS username, n_topics, n_replies, latest_topic, latest_reply, last_active FROM a JOIN best b ON b.member = a.member AND b.rn = 1"""
)
def member_stats(spark, folder):
    return members.member_stats(docs_of(spark, folder))


@query(
    f"""WITH {DOCS}, {KEYED} SELECT author, count(*) FILTER (kind = 't') AS threads, count(*) FILTER (kind = 'r') AS replies, count(*) AS posts, count(DISTINCT CAST(created_at AS DATE)) AS active_days,
    floor(count(*) * 100.0 / greatest(1, count(DISTINCT CAST(created_at AS DATE))) + 0.5) / 100 AS posts_per_day FROM keyed WHERE author <> '' GROUP BY author"""
)
def user_activity(spark, folder):
    return members.user_activity(docs_of(spark, folder))


_HOURS = f"{DOCS}, {KEYED}, h AS (SELECT author, CAST(hour(created_at) AS INT) AS hour, count(*) AS n FROM keyed WHERE author <> '' AND created_at IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_HOURS}, t AS (SELECT author, sum(n) AS all_ FROM h GROUP BY author), e AS (SELECT h.author, round(-sum(n / all_ * log2(n / all_)), 3) AS entropy FROM h JOIN t ON t.author = h.author GROUP BY h.author) SELECT author, CASE WHEN entropy = 0 THEN 0.0 ELSE entropy END AS entropy FROM e")
def hour_entropy(spark, folder):
    return members.hour_entropy(docs_of(spark, folder))


@query(f"WITH {_HOURS}, r AS (SELECT author, hour, n, CAST(row_number() OVER (PARTITION BY author ORDER BY n DESC, hour) AS INT) AS rank FROM h) SELECT author, rank, hour, n FROM r WHERE rank <= 3")
def peak_hours(spark, folder):
    return members.peak_hours(docs_of(spark, folder)).select("author", "rank", "hour", "n")


_EDGES = f"""{DOCS}, {KEYED}, r AS (SELECT * FROM keyed WHERE kind = 'r'), t AS (SELECT * FROM keyed WHERE kind = 't'),
i AS (SELECT r.author, CASE WHEN p.post_id IS NOT NULL THEN p.author ELSE t.author END AS target, r.created_at AS b, CASE WHEN p.post_id IS NOT NULL THEN p.created_at ELSE t.created_at END AS a
  FROM r LEFT JOIN r p ON p.post_id = r.parent_post_id LEFT JOIN t ON t.thread_id = r.thread_id),
e AS (SELECT author, target, date_diff('microsecond', a, b) / 1e6 AS s FROM i WHERE author <> '' AND target <> '' AND author <> target),
c AS (SELECT author, target, count(*) AS n_replies FROM e GROUP BY ALL),
m AS (SELECT author, target, list_sort(list(s))[len(list(s)) // 2 + 1] AS s FROM e WHERE s BETWEEN 0 AND 86400 * 30 GROUP BY ALL)"""


@query(f"WITH {_EDGES} SELECT c.author, c.target, c.n_replies, coalesce(k.n_replies, 0) AS n_back, round(m.s / 60, 1) AS median_minutes FROM c LEFT JOIN c k ON k.author = c.target AND k.target = c.author LEFT JOIN m ON m.author = c.author AND m.target = c.target")
def interaction_edges(spark, folder):
    return members.edges(docs_of(spark, folder))


@query(f"WITH {_EDGES} SELECT author, target, n_replies FROM c ORDER BY n_replies DESC, author, target LIMIT 250")
def strongest_interactions(spark, folder):
    return members.edges(docs_of(spark, folder)).select("author", "target", "n_replies").orderBy(F.desc("n_replies"), "author", "target").limit(250)


_NAMES = ["tealrooferban", "brassvicarban", "ambergoblinban", "knotty glazier ban"]


@query(f"WITH {DOCS}, {KEYED}, o AS (SELECT DISTINCT thread_id, author FROM keyed WHERE author IN ({', '.join(repr(n) for n in _NAMES)})) SELECT x.author AS a, y.author AS b, count(*) AS n_threads FROM o x JOIN o y ON y.thread_id = x.thread_id AND x.author < y.author GROUP BY ALL")
def shared_threads(spark, folder):
    return members.shared_threads(docs_of(spark, folder), _NAMES)


@query("SELECT t.id AS thread_id, count(p.id) AS n_replies FROM (SELECT DISTINCT id FROM threads) t LEFT JOIN (SELECT DISTINCT id, thread_id FROM posts) p ON p.thread_id = t.id GROUP BY t.id")
def left_count(spark, folder):
    p = table(spark, folder, "posts").groupBy("id").agg(F.min("thread_id").alias("thread_id")).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "threads").select(F.col("id").alias("thread_id")).distinct().join(p, "thread_id", "left").select("thread_id", F.coalesce("n", F.lit(0)).alias("n_replies"))


@query("SELECT DISTINCT p.id AS post_id, p.thread_id FROM posts p WHERE p.thread_id NOT IN (SELECT id FROM threads)")
def orphan_check(spark, folder):
    return table(spark, folder, "posts").select(F.col("id").alias("post_id"), "thread_id").distinct().join(table(spark, folder, "threads").select(F.col("id").alias("thread_id")), "thread_id", "left_anti").select("post_id", "thread_id")


@query("SELECT 'thread_categories' AS table_name, category_id, count(*) AS n FROM thread_categories WHERE category_id NOT IN (SELECT category_id FROM category_taxonomy) GROUP BY ALL UNION ALL SELECT 'post_categories', category_id, count(*) FROM post_categories WHERE category_id NOT IN (SELECT category_id FROM category_taxonomy) GROUP BY ALL")
def fk_check(spark, folder):
    known = bounded_broadcast(table(spark, folder, "category_taxonomy").select("category_id").distinct(), 100_000)
    parts = [table(spark, folder, t).join(known, "category_id", "left_anti").groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "category_id", "n") for t in ("thread_categories", "post_categories")]
    return parts[0].unionByName(parts[1])


@query("SELECT kind, count(*) AS n, min(at_) AS first_at, max(at_) AS last_at FROM (SELECT 't' AS kind, id, ingested_at AS at_ FROM threads UNION ALL SELECT 'r', id, ingested_at FROM posts) GROUP BY kind")
def union_all_check(spark, folder):
    parts = [table(spark, folder, t).select(F.lit(k).alias("kind"), F.col("ingested_at").alias("at")) for k, t in (("t", "threads"), ("r", "posts"))]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


_ACK = ", ".join(f"'{w}'" for w in categories.ACKNOWLEDGEMENTS)
_DECIDED = f"""own AS (SELECT post_id, parent_post_id FROM docs WHERE kind = 'r'), {_PAIRS},
k AS (SELECT parent_post_id AS post_id, count(*) AS n FROM docs WHERE parent_post_id IS NOT NULL GROUP BY 1), d AS (SELECT ancestor_id AS post_id, count(*) AS n FROM pairs GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {DOCS}, {_DECIDED},
    x AS (SELECT docs.post_id, {collapsed('body')} AS whole, coalesce(k.n, 0) AS n_children, coalesce(d.n, 0) AS n_descendants FROM docs LEFT JOIN k ON k.post_id = docs.post_id LEFT JOIN d ON d.post_id = docs.post_id WHERE kind = 'r'),
    y AS (SELECT *, {collapsed("regexp_replace(whole, '(?is)' || chr(92) || '[quote[^' || chr(92) || ']]*' || chr(92) || '].*?' || chr(92) || '[/quote' || chr(92) || ']|<blockquote' || chr(92) || 'b.*?</blockquote>', ' ', 'g')")} AS bare FROM x),
    z AS (SELECT *, regexp_extract_all(lower(bare), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_''-]*') AS w FROM y),
    v AS (SELECT *, CASE WHEN whole = '' THEN 1 WHEN bare = '' THEN 2 WHEN regexp_matches(bare, '(?i)^((https?://|www\\.)\\S+|\\S+\\.(com|net|org|co|io|gg|tv|uk|me|edu|gov)(/\\S*)?)$') THEN 3
      WHEN NOT regexp_matches(bare, '[\\p{{L}}\\p{{N}}]') AND length(bare) <= 80 THEN 4 WHEN len(w) = 1 AND NOT regexp_matches(w[1], '[a-z0-9]') THEN 5
      WHEN len(w) = 1 AND (n_children >= 2 OR n_descendants >= 3) THEN 6 WHEN len(w) = 1 THEN 7
      WHEN len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda q: q NOT IN ({_ACK}))) = 0 THEN 8 ELSE 9 END AS rule FROM z)
    SELECT post_id, CASE WHEN rule IN (1, 2, 4, 7, 8) THEN 'ignore_junk' WHEN rule = 3 THEN 'preserve_link' ELSE 'analyse' END AS decision,
      CASE rule WHEN 1 THEN 'empty' WHEN 2 THEN 'quote_only' WHEN 4 THEN 'symbol_only' WHEN 7 THEN 'single_word_non_url' WHEN 8 THEN 'short_ack' END AS reason,
      CASE rule WHEN 3 THEN 'link_only' WHEN 6 THEN 'engagement_anchor' END AS relationship, n_children, n_descendants FROM v"""
)
def reply_prefilter(spark, folder):
    return categories.reply_decisions(docs_of(spark, folder))


_LABEL = "(SELECT thread_id, category_id, confidence, source FROM (SELECT thread_id, lower(trim(category_id)) AS category_id, confidence, source, row_number() OVER (PARTITION BY thread_id ORDER BY source <> 'manual', coalesce(confidence, 0) DESC, lower(trim(category_id)), source) AS rn FROM thread_categories WHERE thread_id IS NOT NULL) WHERE rn = 1)"


@query(
    f"""WITH RECURSIVE {DOCS}, {_DECIDED}, tl AS {_LABEL},
    h AS (SELECT post_id, thread_id, parent_post_id, sha256({collapsed('body')}) AS content_hash FROM docs WHERE kind = 'r'),
    r AS (SELECT parent_post_id AS post_id, content_hash AS hh, row_number() OVER (PARTITION BY parent_post_id ORDER BY content_hash) AS rn FROM h WHERE parent_post_id IS NOT NULL),
    c AS (SELECT post_id, string_agg(hh, '|' ORDER BY hh) AS children FROM r WHERE rn <= 16 GROUP BY post_id)
    SELECT h.post_id, h.content_hash, sha256(h.content_hash || '|' || coalesce(k.n, 0) || '|' || coalesce(d.n, 0) || '|' || coalesce(c.children, '') || '|' || coalesce(tl.category_id, '') || '|1') AS context_hash
    FROM h LEFT JOIN k ON k.post_id = h.post_id LEFT JOIN d ON d.post_id = h.post_id LEFT JOIN c ON c.post_id = h.post_id LEFT JOIN tl ON tl.thread_id = h.thread_id"""
)
def context_hash(spark, folder):
    return categories.context_hashes(docs_of(spark, folder), categories.latest_labels(table(spark, folder, "thread_categories"), "thread_id"))


@query(
    f"""WITH tl AS {_LABEL}, o AS (SELECT post_id, min(CASE WHEN source = 'manual' THEN lower(trim(category_id)) END) AS manual, min(CASE WHEN source = 'reply-refined' THEN lower(trim(category_id)) END) AS refined FROM post_categories WHERE post_id IS NOT NULL GROUP BY post_id),
    p AS (SELECT id AS post_id, min(thread_id) AS thread_id FROM posts WHERE id IS NOT NULL GROUP BY id)
    SELECT p.post_id, coalesce(o.manual, CASE WHEN tl.source = 'manual' THEN tl.category_id END, o.refined, tl.category_id, 'unsorted') AS category_id,
      CASE WHEN o.manual IS NOT NULL THEN 'reply' WHEN tl.source = 'manual' THEN 'thread-manual' WHEN o.refined IS NOT NULL THEN 'refined' WHEN tl.category_id IS NOT NULL THEN 'thread' ELSE 'none' END AS source
    FROM p LEFT JOIN o ON o.post_id = p.post_id LEFT JOIN tl ON tl.thread_id = p.thread_id"""
)
def category_resolve(spark, folder):
    return categories.resolve(table(spark, folder, "posts"), table(spark, folder, "thread_categories"), table(spark, folder, "post_categories"))


@query(
    f"""WITH tl AS {_LABEL}, pl AS (SELECT post_id, thread_id, category_id FROM (SELECT post_id, min(thread_id) OVER (PARTITION BY post_id) AS thread_id, lower(trim(category_id)) AS category_id, row_number() OVER (PARTITION BY post_id ORDER BY source <> 'manual', coalesce(confidence, 0) DESC, lower(trim(category_id)), source) AS rn FROM post_categories WHERE post_id IS NOT NULL) WHERE rn = 1)
    SELECT pl.post_id, pl.category_id, tl.category_id AS thread_category_id FROM pl JOIN tl ON tl.thread_id = pl.thread_id WHERE pl.category_id <> tl.category_id"""
)
def category_diff(spark, folder):
    return categories.differences(table(spark, folder, "post_categories"), table(spark, folder, "thread_categories"))


_ITEMS = "items AS (SELECT id AS thread_id, sha256(coalesce(min(title), '') || '|' || coalesce(min(message), '')) AS content_hash FROM threads WHERE id IS NOT NULL GROUP BY id)"


def _items(spark, folder):
    return table(spark, folder, "threads").where("id IS NOT NULL").groupBy(F.col("id").alias("thread_id")).agg(F.sha2(F.concat(F.coalesce(F.min("title"), F.lit("")), F.lit("|"), F.coalesce(F.min("message"), F.lit(""))), 256).alias("content_hash"))


@query(
    f"""WITH {_ITEMS}, tl AS {_LABEL}, i AS (SELECT items.*, thread_id % 7 AS m FROM items)
    SELECT i.thread_id, CASE WHEN m = 0 THEN 'law' WHEN tl.source = 'manual' THEN tl.category_id WHEN m = 1 THEN 'sport' WHEN tl.category_id IS NOT NULL AND m <> 2 THEN tl.category_id ELSE 'unsorted' END AS category_id,
      CASE WHEN m = 0 THEN 1.0 WHEN tl.source = 'manual' THEN tl.confidence WHEN m = 1 THEN 0.5 WHEN tl.category_id IS NOT NULL AND m <> 2 THEN tl.confidence ELSE 0.0 END AS confidence,
      CASE WHEN m = 0 THEN 'review' WHEN tl.source = 'manual' THEN 'manual' WHEN m = 1 THEN 'decision' WHEN tl.category_id IS NOT NULL AND m <> 2 THEN 'preserved' ELSE 'pending' END AS classifier
    FROM i LEFT JOIN tl ON tl.thread_id = i.thread_id"""
)
def category_precedence(spark, folder):
    """Reviews, decisions and changed contents are derived from the ids, for the tables have none."""
    items = _items(spark, folder)
    m = F.col("thread_id") % 7
    reviews = items.where(m == 0).select("thread_id", F.lit("law").alias("category_id"))
    decisions = items.where(m.isin(1, 3)).select("thread_id", F.lit("sport").alias("category_id"), F.lit(0.5).alias("confidence"), "content_hash", (m == 3).alias("failed"))
    old = categories.latest_labels(table(spark, folder, "thread_categories"), "thread_id").join(items, "thread_id").withColumn("content_hash", F.when(m == 2, F.lit("changed")).otherwise(F.col("content_hash")))
    return categories.precedence(items, reviews, old, decisions)


@query(
    f"""WITH {_ITEMS}, d AS (SELECT thread_id, thread_id % 5 AS m FROM items)
    SELECT thread_id FROM d WHERE m = 0 OR (m IN (1, 2) AND (thread_id % 3 = 0 OR thread_id % 2 = 0))"""
)
def retry_due(spark, folder):
    """Decisions and attempts are derived from the ids: a fifth have new content, two fifths are uncertain, of which a third have
    a new context and every other one is due."""
    items = _items(spark, folder).withColumn("context_hash", F.lit("c"))
    i = F.col("thread_id")
    decisions = items.select("thread_id", F.when(i % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), (i % 5).isin(1, 2).alias("uncertain"))
    attempts = items.select("thread_id", F.when(i % 3 == 0, "other").otherwise("c").alias("context_hash"), F.when(i % 2 == 0, 10.0).otherwise(30.0).alias("next_at"), F.lit(False).alias("complete"))
    return categories.retry_due(items, decisions, attempts, 20.0)


@query("SELECT category_id, source, count(*) AS n FROM thread_categories GROUP BY ALL")
def category_counts(spark, folder):
    return table(spark, folder, "thread_categories").groupBy("category_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT thread_id, evidence_json ->> '$[0]' AS model, evidence_json ->> '$[1].alternative' AS alternative FROM thread_categories")
def category_evidence(spark, folder):
    e = F.from_json("evidence_json", "array<string>")
    return table(spark, folder, "thread_categories").select("thread_id", F.get(e, F.lit(0)).alias("model"), F.get_json_object(F.get(e, F.lit(1)), "$.alternative").alias("alternative")).distinct()


@query(f"WITH {DOCS}, tl AS {_LABEL}, {ROLLUP} SELECT r.thread_id, r.title, r.last_post_at FROM rollup_ r JOIN tl ON tl.thread_id = r.thread_id WHERE tl.category_id = 'travel/rail' ORDER BY r.last_post_at DESC, r.thread_id DESC LIMIT 25")
def category_threads(spark, folder):
    labels = categories.latest_labels(table(spark, folder, "thread_categories"), "thread_id").where("category_id = 'travel/rail'")
    return views.thread_rollup(docs_of(spark, folder)).join(labels.select("thread_id"), "thread_id", "left_semi").orderBy(F.desc("last_post_at"), F.desc("thread_id")).limit(25).select("thread_id", "title", "last_post_at")


_CUT = "TIMESTAMP '2024-01-15 00:00:00'"
_STATE = f"""was AS (SELECT 'r:' || user_id AS doc_key, max(ts) AS fp FROM events WHERE ts < {_CUT} GROUP BY user_id), now_ AS (SELECT 'r:' || user_id AS doc_key, max(ts) AS fp FROM events WHERE ts >= {_CUT} GROUP BY user_id)"""


def _read_states(spark, folder):
    """What each user did last, before and after a time, as content that has changed or not."""
    ev = table(spark, folder, "events")
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    side = lambda df: df.groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fp")).select(F.concat(F.lit("r:"), "user_id").alias("doc_key"), (F.col("user_id") % 20).alias("thread_id"), "fp")
    return side(ev.where(F.col("ts") < cut)), side(ev.where(F.col("ts") >= cut))


@query(
    f"""WITH {_STATE} SELECT n.doc_key, CAST(substring(n.doc_key, 3) AS BIGINT) % 20 AS thread_id, w.fp IS NOT DISTINCT FROM n.fp AS is_read FROM now_ n LEFT JOIN was w ON w.doc_key = n.doc_key"""
)
def read_state_merge(spark, folder):
    before, after = _read_states(spark, folder)
    merged = state.merge_read_state(state.merge_read_state(None, before), after)
    return merged.select("doc_key", "thread_id", F.col("read_fp").eqNullSafe(F.col("current_fp")).alias("is_read"))


@query(f"WITH {_STATE} SELECT CAST(substring(n.doc_key, 3) AS BIGINT) % 20 AS thread_id, count(*) FILTER (w.fp IS DISTINCT FROM n.fp) AS n_unread, count(*) AS n_total FROM now_ n LEFT JOIN was w ON w.doc_key = n.doc_key GROUP BY 1")
def unread_summary(spark, folder):
    before, after = _read_states(spark, folder)
    return state.unread_summary(state.merge_read_state(state.merge_read_state(None, before), after))


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def keyed_cap(spark, folder):
    ev = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return state.newest_per_key(ev, "user_id", 10, F.desc("ts"), F.desc("event_id"))


@query("WITH m AS (SELECT max(ts) AS now_ FROM events) SELECT e.event_id, e.ts FROM events e, m WHERE e.ts >= m.now_ - INTERVAL 7 DAYS")
def ttl_recent(spark, folder):
    ev = table(spark, folder, "events").select("event_id", "ts")
    top = ev.agg(F.max("ts").alias("_now"))
    return state.expire(ev.join(F.broadcast(top)), "ts", F.col("_now"), 7).drop("_now")


@query("WITH g AS (SELECT user_id AS thread_id, count(*) AS n, min(ts) AS at0, max(ts) AS at_ FROM events WHERE event_type = 'click' GROUP BY 1) SELECT thread_id, at_ AS at FROM g WHERE n % 2 = 1")
def saved_toggle(spark, folder):
    t = table(spark, folder, "events").where("event_type = 'click'").select(F.col("user_id").alias("thread_id"), F.col("ts").alias("at"))
    return state.toggle(t.select("thread_id", "at").limit(0), t)


def _folder(spark) -> str:
    """A fresh folder for a stream's state, beside the checkpoints that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder.rstrip('/')}/{name}*.parquet")


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS rn FROM events) WHERE rn = 1")
def stream_delta_merge(spark, folder):
    ev = _stream(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return flows.delta_merge(ev, _folder(spark), "user_id", "ts")


@query("SELECT 'r:' || user_id AS doc_key, user_id % 20 AS thread_id, true AS is_read FROM events GROUP BY user_id")
def stream_read_state(spark, folder):
    ev = _stream(spark, folder, "events").select(F.concat(F.lit("r:"), "user_id").alias("doc_key"), (F.col("user_id") % 20).alias("thread_id"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("fp"), F.col("ts").alias("at"))
    return flows.read_state(ev, _folder(spark)).select("doc_key", "thread_id", F.col("read_fp").eqNullSafe(F.col("current_fp")).alias("is_read"))


@query("SELECT 'r:' || event_id AS doc_key, ts AS created_at, true AS read, true AS dismissed FROM events WHERE event_type = 'signup' ORDER BY ts DESC, 1 DESC LIMIT 1000")
def stream_notifications(spark, folder):
    ev = _stream(spark, folder, "events").where("event_type = 'signup'").select(F.concat(F.lit("r:"), "event_id").alias("doc_key"), F.col("ts").alias("created_at"))
    return flows.notifications(ev, _folder(spark))


@query("SELECT title, true AS valid FROM (VALUES ('7.0.20+20260801'), ('8.0.10+20260901')) v(title) UNION ALL SELECT title, false FROM (VALUES ('7.0.36+20260229'), ('8.0.10+20261301'), ('8.0.10+19991231'), ('8.0+20260901'), ('x 8.0.10+20260901')) v(title)")
def release_title_valid(spark, folder):
    rows = spark.createDataFrame([(t,) for t in ("7.0.20+20260801", "8.0.10+20260901", "7.0.36+20260229", "8.0.10+20261301", "8.0.10+19991231", "8.0+20260901", "x 8.0.10+20260901")], "title string")
    return rows.select("title", X.valid_release_title("title").alias("valid"))


@query(
    """WITH p AS (SELECT id, min(created_utc) AS created_utc FROM posts WHERE id IS NOT NULL GROUP BY id), c AS (SELECT id, trim(created_utc) AS x FROM p)
    SELECT id AS post_id, try_cast(replace(regexp_replace(CASE WHEN regexp_matches(x, '^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d(\\.\\d{1,6})?)?(Z|\\+00:?00)?$') THEN x END, '(Z|\\+00:?00)$', ''), 'T', ' ') AS TIMESTAMP) AS created FROM c"""
)
def parsed_times(spark, folder):
    p = table(spark, folder, "posts").where("id IS NOT NULL").groupBy("id").agg(F.min("created_utc").alias("created_utc"))
    return p.select(F.col("id").alias("post_id"), X.parse_time("created_utc").alias("created"))
