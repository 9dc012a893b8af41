"""Reply trees: what is visible, what is unanswered, how many replies hang below.

All are built on the pointer doubling of ``hierarchy``, so depth costs logarithmic rounds. A node that must hide its subtree has
its own pointer cut: walking up from any node then ends at the nearest such ancestor, or at the thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import cut
from .hierarchy import below, descendants, hierarchy


def blocked_keys(names: list[str] | tuple[str, ...]) -> list[str]:
    from .search import fold

    return sorted({fold(n).strip() for n in names} - {""})


def visible(docs: DataFrame, blocked: list[str] | tuple[str, ...], hide_threads_of_blocked_roots: bool = False, reveal: bool = False) -> DataFrame:
    """The documents of which neither they nor an ancestor is by a blocked author. A reply whose parent is missing, or lies in
    another thread, is hidden with all below it; a blocked root hides its replies only if asked for."""
    if reveal:
        return docs
    keys = blocked_keys(blocked) or ["\0"]
    bad = X.identity_key("username").isin(*keys)
    roots = docs.where((F.col("kind") == "t") & ~bad)
    replies = docs.where("kind = 'r'")
    nodes = replies.select(F.col("post_id").alias("id"), F.col("thread_id").alias("thread"), F.col("parent_post_id").alias("parent"), bad.alias("bad"))
    above = nodes.select(F.col("id").alias("parent"), F.col("thread").alias("thread2"))
    placed = nodes.join(above, "parent", "left").withColumn("stop", F.col("bad") | (F.col("parent").isNotNull() & ~F.coalesce(F.col("thread") == F.col("thread2"), F.lit(False))))
    placed = cut(placed.select("id", F.when(~F.col("stop"), F.col("parent")).alias("parent_id"), "stop"))
    tops = placed.where("NOT stop AND parent_id IS NULL").select(F.col("id").alias("root_id"))
    seen = hierarchy(placed).where("depth >= 0").join(tops, "root_id", "left_semi").select(F.col("id").alias("post_id"))
    kept = replies.join(seen, "post_id", "left_semi")
    if hide_threads_of_blocked_roots:
        kept = kept.join(docs.where((F.col("kind") == "t") & bad).select("thread_id"), "thread_id", "left_anti")
    return roots.unionByName(kept.select(*roots.columns))


def flagged(docs: DataFrame, blocked: list[str] | tuple[str, ...], muted: DataFrame | None = None) -> DataFrame:
    """All documents with ``hidden``: why a reader does not see them ('blocked': its author or one above it is; 'muted': its thread
    is), or null. What is hidden is kept, so that it can be shown again."""
    seen = visible(docs, blocked).select("doc_key", F.lit(True).alias("_seen"))
    quiet = (muted if muted is not None else docs.limit(0)).select("thread_id").where("thread_id IS NOT NULL").distinct().withColumn("_muted", F.lit(True))
    both = docs.join(seen, "doc_key", "left").join(quiet, "thread_id", "left")
    return both.select(*docs.columns, F.when(F.col("_muted"), "muted").when(F.col("_seen").isNull(), "blocked").alias("hidden"))


def child_counts(docs: DataFrame) -> DataFrame:
    """post_id, n_children of every reply that has replies."""
    return docs.where("parent_post_id IS NOT NULL").groupBy(F.col("parent_post_id").alias("post_id")).agg(F.count(F.lit(1)).alias("n_children"))


def descendant_counts(docs: DataFrame) -> DataFrame:
    """post_id, n_descendants of every reply that has replies."""
    return below(docs.where("kind = 'r'"), "post_id", "parent_post_id").select(F.col("id").alias("post_id"), F.col("below").alias("n_descendants"))


def branches(docs: DataFrame, me: str, blocked: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_key, type, answered, created_at: visible replies by others to me; 'posts' where they answer my thread, 'replies'
    where they answer my reply; answered where I wrote later anywhere below."""
    from .search import fold

    key = fold(me).strip()
    seen = cut(visible(docs, blocked).withColumn("author", X.identity_key("username")))
    replies = seen.where("kind = 'r'")
    mine = seen.where(F.col("author") == key).select(F.when(F.col("kind") == "t", F.concat(F.lit("t:"), "post_id")).otherwise(F.concat(F.lit("r:"), "post_id")).alias("target"), F.when(F.col("kind") == "t", "posts").otherwise("replies").alias("type"))
    to = F.coalesce(F.concat(F.lit("r:"), "parent_post_id"), F.concat(F.lit("t:"), "thread_id"))
    incoming = replies.where(F.col("author") != key).withColumn("target", to).join(mine, "target").select("doc_key", "post_id", "type", "created_at")
    mine_at = F.when(F.col("author") == key, F.col("created_at"))
    answers = below(replies, "post_id", "parent_post_id", mine_at, "max").select(F.col("id").alias("post_id"), F.col("below").alias("answered_at"))
    return incoming.join(answers, "post_id", "left").select("doc_key", "type", F.coalesce(F.col("answered_at") > F.col("created_at"), F.lit(False)).alias("answered"), "created_at")


def answer_paths(docs: DataFrame) -> DataFrame:
    """doc_key, recipient, answer_key, path: for every reply to another author, the later replies below it by the recipient, with
    the authors on the way up from the answer to that reply, joined by ' > '."""
    named = cut(docs.where("kind = 'r'").withColumn("author", X.identity_key("username")))
    pairs = descendants(named, "post_id", "parent_post_id")
    roots = docs.where("kind = 't'").select(F.concat(F.lit("t:"), "post_id").alias("target"), X.identity_key("username").alias("recipient"))
    people = roots.unionByName(named.select(F.concat(F.lit("r:"), "post_id").alias("target"), F.col("author").alias("recipient")))
    to = F.coalesce(F.concat(F.lit("r:"), "parent_post_id"), F.concat(F.lit("t:"), "thread_id"))
    incoming = named.withColumn("target", to).join(people, "target").where("author <> '' AND recipient <> '' AND author <> recipient").select(F.col("post_id").alias("ancestor_id"), "recipient", F.col("created_at").alias("asked_at"))
    answers = named.select(F.col("post_id").alias("descendant_id"), F.col("author").alias("recipient"), F.col("created_at").alias("answered_at"))
    hits = cut(pairs.join(incoming, "ancestor_id").join(answers, ["descendant_id", "recipient"]).where("answered_at > asked_at").select("ancestor_id", "descendant_id", "recipient", "distance"))
    # nodes between the answer (left out) and the asked reply (kept): those above the answer and not above the reply
    above = pairs.select("descendant_id", F.col("ancestor_id").alias("mid"), F.col("distance").alias("up"))
    way = hits.join(above, "descendant_id").where("up <= distance").join(named.select(F.col("post_id").alias("mid"), "author"), "mid")
    listed = way.groupBy("ancestor_id", "descendant_id", "recipient").agg(F.sort_array(F.collect_list(F.struct("up", "author"))).alias("a"))
    return listed.select(F.concat(F.lit("r:"), "ancestor_id").alias("doc_key"), "recipient", F.concat(F.lit("r:"), "descendant_id").alias("answer_key"), F.array_join(F.transform("a", lambda x: x["author"]), " > ").alias("path"))


def notifications(docs: DataFrame, me: str) -> DataFrame:
    """doc_key, thread_id, created_at, snippet of replies by others in my threads or to my replies."""
    name = F.lower(F.trim("username"))
    own = me.strip().lower()
    replies = docs.where((F.col("kind") == "r") & (name != own))
    threads = docs.where((F.col("kind") == "t") & (name == own)).select("thread_id")
    posts = docs.where((F.col("kind") == "r") & (name == own)).select(F.col("post_id").alias("parent_post_id"))
    both = replies.join(threads, "thread_id", "left_semi").unionByName(replies.join(posts, "parent_post_id", "left_semi").select(*replies.columns))
    return both.dropDuplicates(["doc_key"]).select("doc_key", "thread_id", "created_at", F.substring(X.collapsed("body"), 1, 240).alias("snippet"))
