"""Categories of threads and replies: rules before a model, hashes for incremental work, precedence, differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import skew_join

# Words that make a short reply a mere acknowledgement, the shapes of a bare link and of a quote.
ACKNOWLEDGEMENTS = "lol lmao rofl haha yes yep yeah no nah ok okay thanks cheers same agreed true based nice cool wow bump this".split()
LINK = r"(?i)^((https?://|www\.)\S+|\S+\.(com|net|org|co|io|gg|tv|uk|me|edu|gov)(/\S*)?)$"
QUOTE = r"(?is)\[quote[^\]]*\].*?\[/quote\]|<blockquote\b.*?</blockquote>"
LEAST_CONFIDENCE = 0.68


def prefilter(body: Column, n_children: Column, n_descendants: Column) -> Column:
    """decision, reason and relationship of a reply, by ordered rules and without any model."""
    whole = X.collapsed(F.coalesce(body, F.lit("")))
    bare = X.collapsed(F.regexp_replace(whole, QUOTE, " "))
    words = F.regexp_extract_all(F.lower(bare), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"), F.lit(0))
    n = F.size(words)
    answer = lambda decision, reason=None, relationship=None: F.struct(F.lit(decision).alias("decision"), F.lit(reason).cast("string").alias("reason"), F.lit(relationship).cast("string").alias("relationship"))
    anchor = (n_children >= 2) | (n_descendants >= 3)
    return (
        F.when(whole == "", answer("ignore_junk", "empty"))
        .when(bare == "", answer("ignore_junk", "quote_only"))
        .when(bare.rlike(LINK), answer("preserve_link", None, "link_only"))
        .when(~bare.rlike(r"[\p{L}\p{N}]") & (F.length(bare) <= 80), answer("ignore_junk", "symbol_only"))
        .when((n == 1) & ~words[0].rlike("[a-z0-9]"), answer("analyse"))
        .when((n == 1) & anchor, answer("analyse", None, "engagement_anchor"))
        .when(n == 1, answer("ignore_junk", "single_word_non_url"))
        .when((n <= 3) & (n > 0) & F.forall(words, lambda w: w.isin(*ACKNOWLEDGEMENTS)), answer("ignore_junk", "short_ack"))
        .otherwise(answer("analyse"))
    )


def reply_decisions(docs: DataFrame) -> DataFrame:
    """post_id, decision, reason, relationship, n_children, n_descendants of every reply."""
    from .conversation import child_counts, descendant_counts

    replies = docs.where("kind = 'r'").select("post_id", "body")
    both = replies.join(child_counts(docs), "post_id", "left").join(descendant_counts(docs), "post_id", "left").fillna(0, ["n_children", "n_descendants"])
    return both.withColumn("d", prefilter(F.col("body"), F.col("n_children"), F.col("n_descendants"))).select("post_id", "d.decision", "d.reason", "d.relationship", "n_children", "n_descendants")


def context_hashes(docs: DataFrame, thread_category: DataFrame, version: int = 1) -> DataFrame:
    """post_id, content_hash, context_hash: the context changes with the counts below a reply, with the smallest sixteen
    hashes of its direct answers and with its thread's category.

    The sixteen smallest are kept by rank within salted parts, so a reply with very many answers stays within bounds."""
    from .conversation import child_counts, descendant_counts

    replies = docs.where("kind = 'r'").select("post_id", "thread_id", "parent_post_id", F.sha2(X.collapsed("body"), 256).alias("content_hash"))
    given = replies.where("parent_post_id IS NOT NULL").select(F.col("parent_post_id").alias("post_id"), F.col("content_hash").alias("h"), F.pmod("post_id", F.lit(16)).alias("salt"))
    first = given.withColumn("r", F.row_number().over(Window.partitionBy("post_id", "salt").orderBy("h"))).where("r <= 16")
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("post_id").orderBy("h"))).where("r <= 16")
    below = kept.groupBy("post_id").agg(F.array_join(F.sort_array(F.collect_list("h")), "|").alias("children"))
    full = replies.join(child_counts(docs), "post_id", "left").join(descendant_counts(docs), "post_id", "left").fillna(0, ["n_children", "n_descendants"]).join(below, "post_id", "left").join(thread_category.select("thread_id", "category_id"), "thread_id", "left")
    parts = ["content_hash", F.col("n_children").cast("string"), F.col("n_descendants").cast("string"), F.coalesce("children", F.lit("")), F.coalesce("category_id", F.lit("")), F.lit(str(version))]
    return full.select("post_id", "content_hash", F.sha2(F.concat_ws("|", *parts), 256).alias("context_hash"))


def latest_labels(labels: DataFrame, key: str) -> DataFrame:
    """One label for each key: a manual one before an automatic one, then the most confident, then the smallest id; ids are
    compared trimmed and in lower case."""
    clean = labels.where(F.col(key).isNotNull()).select(key, F.lower(F.trim("category_id")).alias("category_id"), "confidence", "source")
    best = F.min(F.struct((F.col("source") != "manual").alias("rank"), (-F.coalesce("confidence", F.lit(0.0))).alias("less"), "category_id", "source"))
    return clean.groupBy(key).agg(best.alias("x")).select(key, "x.category_id", (-F.col("x.less")).alias("confidence"), "x.source")


def resolve(posts: DataFrame, thread_labels: DataFrame, post_labels: DataFrame, default: str = "unsorted") -> DataFrame:
    """post_id, category_id, source: a manual label of the reply, then a manual label of its thread, then a refined label of
    the reply, then the thread's label, else the default."""
    threads = latest_labels(thread_labels, "thread_id").select("thread_id", F.col("category_id").alias("t_cat"), F.col("source").alias("t_src"))
    clean = post_labels.where("post_id IS NOT NULL").select("post_id", F.lower(F.trim("category_id")).alias("c"), "source")
    own = clean.groupBy("post_id").agg(F.min(F.when(F.col("source") == "manual", F.col("c"))).alias("manual"), F.min(F.when(F.col("source") == "reply-refined", F.col("c"))).alias("refined"))
    both = posts.where("id IS NOT NULL").groupBy(F.col("id").alias("post_id")).agg(F.min("thread_id").alias("thread_id")).join(own, "post_id", "left").join(threads, "thread_id", "left")
    root = F.when(F.col("t_src") == "manual", F.col("t_cat"))
    source = F.when(F.col("manual").isNotNull(), "reply").when(root.isNotNull(), "thread-manual").when(F.col("refined").isNotNull(), "refined").when(F.col("t_cat").isNotNull(), "thread").otherwise("none")
    return both.select("post_id", F.coalesce("manual", root, "refined", "t_cat", F.lit(default)).alias("category_id"), source.alias("source"))


def differences(post_labels: DataFrame, thread_labels: DataFrame) -> DataFrame:
    """post_id, category_id, thread_category_id of replies whose label differs from their thread's."""
    own = latest_labels(post_labels, "post_id").select("post_id", "category_id")
    where = post_labels.groupBy("post_id").agg(F.min("thread_id").alias("thread_id"))
    threads = latest_labels(thread_labels, "thread_id").select("thread_id", F.col("category_id").alias("thread_category_id"))
    return own.join(where, "post_id").join(threads, "thread_id").where("category_id <> thread_category_id").select("post_id", "category_id", "thread_category_id")


def precedence(items: DataFrame, reviews: DataFrame, previous: DataFrame, decisions: DataFrame) -> DataFrame:
    """thread_id, category_id, confidence, classifier: a review, then an earlier manual label, then a decision on the same
    content that did not fail, then an earlier label on the same content, else pending.

    items: thread_id, content_hash. reviews: thread_id, category_id. previous: thread_id, category_id, confidence, source,
    content_hash. decisions: thread_id, category_id, confidence, content_hash, failed."""
    r = reviews.select("thread_id", F.col("category_id").alias("r"))
    p = previous.select("thread_id", F.col("category_id").alias("p"), F.col("confidence").alias("pc"), F.col("source").alias("ps"), F.col("content_hash").alias("ph"))
    d = decisions.where("NOT failed").select("thread_id", F.col("category_id").alias("d"), F.col("confidence").alias("dc"), F.col("content_hash").alias("dh"))
    j = items.join(r, "thread_id", "left").join(p, "thread_id", "left").join(d, "thread_id", "left")
    manual, fresh = F.col("ps") == "manual", F.col("dh") == F.col("content_hash")
    kept = F.col("p").isNotNull() & (F.col("ph").isNull() | (F.col("ph") == F.col("content_hash")))
    pick = lambda a, b, c, e, z: F.when(F.col("r").isNotNull(), a).when(manual, b).when(fresh, c).when(kept, e).otherwise(z)
    return j.select("thread_id", pick(F.col("r"), F.col("p"), F.col("d"), F.col("p"), F.lit("unsorted")).alias("category_id"), pick(F.lit(1.0), F.col("pc"), F.col("dc"), F.col("pc"), F.lit(0.0)).alias("confidence"), pick(F.lit("review"), F.lit("manual"), F.lit("decision"), F.lit("preserved"), F.lit("pending")).alias("classifier"))


def retry_due(items: DataFrame, decisions: DataFrame, attempts: DataFrame, now) -> DataFrame:
    """thread_id of items to classify (again): new or changed content; uncertain or failed decisions only when their context has
    changed or their next attempt is due and not complete."""
    d = decisions.select("thread_id", F.col("content_hash").alias("dh"), "uncertain")
    a = attempts.select("thread_id", F.col("context_hash").alias("ah"), "next_at", "complete")
    j = items.join(d, "thread_id", "left").join(a, "thread_id", "left")
    same = F.col("dh").eqNullSafe(F.col("content_hash"))
    tried = F.col("ah").eqNullSafe(F.col("context_hash"))
    return j.where(~same | (F.col("uncertain") & (~tried | (~F.col("complete") & (F.col("next_at") <= F.lit(now)))))).select("thread_id")


def back_off(attempts: Column) -> Column:
    """Seconds until the next attempt: 300, doubled each time, at most six hours."""
    return F.least(F.lit(21_600.0), 300 * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(7))))


def classify(items: DataFrame, model: Callable[[list[dict]], list[tuple[int, str, float]]], batch: int = 16, default: str = "unsorted") -> DataFrame:
    """thread_id, category_id, confidence by a pluggable model over (thread_id, title, message), in batches.

    A batch whose answer lacks an id or fails is cut in halves; a single item that fails gets the default. Answers below the
    least confidence become the default."""

    def ask(rows: list[dict]) -> list[tuple[int, str, float]]:
        try:
            got = model(rows)
            if sorted(g[0] for g in got) != sorted(r["thread_id"] for r in rows):
                raise ValueError("ids do not match")
            return got
        except Exception:
            if len(rows) == 1:
                return [(rows[0]["thread_id"], default, 0.0)]
            half = len(rows) // 2
            return ask(rows[:half]) + ask(rows[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.to_dict("records")
            out = [x for s in range(0, len(rows), batch) for x in ask(rows[s : s + batch])]
            yield pd.DataFrame([(i, c if p >= LEAST_CONFIDENCE else default, p) for i, c, p in out], columns=["thread_id", "category_id", "confidence"])

    return items.select("thread_id", "title", "message").mapInPandas(run, "thread_id bigint, category_id string, confidence double")


def refinement_hash(*parts: Column) -> Column:
    """The key of a refined decision: a hash of all that it was made from."""
    return X.digest(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def resolve_ids(names: DataFrame, taxonomy: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with category_id: the taxonomy entry of that id or, failing that, of that label; case and outer blanks do not matter.
    Of several entries with one label the smallest id counts; what is neither gets null."""
    key = F.lower(F.trim(name))
    ids = taxonomy.where("category_id IS NOT NULL").select(F.lower(F.trim("category_id")).alias("_key"), F.struct(F.lit(0).alias("r"), "category_id").alias("_x"))
    labels = taxonomy.where("category_id IS NOT NULL AND name IS NOT NULL").select(F.lower(F.trim(taxonomy["name"])).alias("_key"), F.struct(F.lit(1).alias("r"), "category_id").alias("_x"))
    known = ids.unionByName(labels).groupBy("_key").agg(F.min("_x").alias("_x"))
    return names.withColumn("_key", key).join(known, "_key", "left").withColumn("category_id", F.col("_x.category_id")).drop("_key", "_x")


def override(current: DataFrame, changes: DataFrame, key: str = "thread_id") -> DataFrame:
    """Manual categories (key, category_id, updated_at) after a batch of changes (key, category_id, at): the last change of a key
    counts (ties: the largest id), a null category gives the key back to its inherited one. Keys without a change stay."""
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("at", F.coalesce("category_id", F.lit("")).alias("c"))).alias("x"))
    kept = current.join(last.select(key), key, "left_anti").select(key, "category_id", "updated_at")
    return kept.unionByName(last.where("x.c <> ''").select(key, F.lower(F.trim("x.c")).alias("category_id"), F.col("x.at").alias("updated_at")))


def submit_reviews(outbox: DataFrame, submitted: DataFrame) -> DataFrame:
    """The outbox (thread_id, category_id, submitted_at) with new reviews: the last write of a thread wins."""
    both = outbox.select("thread_id", "category_id", "submitted_at").unionByName(submitted.select("thread_id", "category_id", "submitted_at"))
    return both.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.max(F.struct("submitted_at", "category_id")).alias("x")).select("thread_id", "x.category_id", "x.submitted_at")


def acknowledge(outbox: DataFrame, taken: DataFrame) -> DataFrame:
    """The outbox without the reviews that were taken over (thread_id, submitted_at); a later review of the same thread stays."""
    done = taken.groupBy("thread_id").agg(F.max("submitted_at").alias("_done"))
    return outbox.join(done, "thread_id", "left").where(F.col("_done").isNull() | (F.col("submitted_at") > F.col("_done"))).drop("_done")


def with_context(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """post_id, thread_id, parent_id, message, thread_title, thread_message, parent_message, parent_author of every reply whose thread is
    there; the parent's are null where there is none. Of several deliveries of a row the smallest texts count."""
    p = posts.where("id IS NOT NULL").groupBy(F.col("id").alias("post_id")).agg(F.min("thread_id").alias("thread_id"), F.min(F.when(F.col("parent_id") != 0, F.col("parent_id"))).alias("parent_id"), F.min("message").alias("message"), F.min("author").alias("author"))
    t = threads.where("id IS NOT NULL").groupBy(F.col("id").alias("thread_id")).agg(F.min("title").alias("thread_title"), F.min("message").alias("thread_message"))
    above = p.select(F.col("post_id").alias("parent_id"), F.col("message").alias("parent_message"), F.col("author").alias("parent_author"))
    return skew_join(skew_join(p, t, ["thread_id"]), above, ["parent_id"], "left").select("post_id", "thread_id", "parent_id", "message", "thread_title", "thread_message", "parent_message", "parent_author")


def refinement_candidates(context: DataFrame, thread_labels: DataFrame, decisions: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``context`` rows with thread_category_id and decision, for replies that rules did not settle; with ``wanted`` only those
    whose decision is one of these."""
    labels = latest_labels(thread_labels, "thread_id").select("thread_id", F.col("category_id").alias("thread_category_id"))
    d = decisions.select("post_id", "decision")
    return skew_join(context.join(d.where(F.col("decision").isin(*wanted)) if wanted is not None else d, "post_id"), labels, ["thread_id"])


def reuse(items: DataFrame, decisions: DataFrame, refinements: DataFrame, manual: DataFrame, default: str = "unsorted") -> DataFrame:
    """post_id, category_id, origin of every item (post_id, content_hash, context_hash, thread_category_id): a manual label; a refinement
    made from both hashes; a decision made from both; else the thread's category, and the item is to be decided ('pending').

    decisions and refinements: post_id, category_id, content_hash, context_hash; one row for each post."""
    made = lambda df, name: df.select("post_id", "content_hash", "context_hash", F.lower(F.trim("category_id")).alias(name))
    own = manual.where("post_id IS NOT NULL").groupBy("post_id").agg(F.min(F.lower(F.trim("category_id"))).alias("m"))
    hashes = ["post_id", "content_hash", "context_hash"]
    j = items.join(own, "post_id", "left").join(made(refinements, "r"), hashes, "left").join(made(decisions, "d"), hashes, "left")
    origin = F.when(F.col("m").isNotNull(), "manual").when(F.col("r").isNotNull(), "refined").when(F.col("d").isNotNull(), "reused").otherwise("pending")
    return j.select("post_id", F.coalesce("m", "r", "d", "thread_category_id", F.lit(default)).alias("category_id"), origin.alias("origin"))


def work_queue(items: DataFrame, attempts: DataFrame, limit: int, priority: str | None = None) -> DataFrame:
    """The next ``limit`` items to work on: what failed before comes first, then by ``priority`` (a column, smallest first) if
    given, then by thread_id. attempts: thread_id, failed, complete; complete items are left out."""
    a = attempts.groupBy("thread_id").agg(F.max("failed").alias("failed"), F.max("complete").alias("complete"))
    left = items.join(a, "thread_id", "left").where(~F.coalesce("complete", F.lit(False))).withColumn("failed", F.coalesce("failed", F.lit(False))).drop("complete")
    return left.orderBy(F.desc("failed"), *([F.asc(priority)] if priority else []), F.asc("thread_id")).limit(limit)


def latest_version(labels: DataFrame, column: str = "taxonomy_version") -> DataFrame:
    """version: the greatest, 0 where there is none."""
    return labels.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("version"))


def publish_faults(published: DataFrame, posts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """fault, n: what forbids publishing (post_id, category_id): posts without a category, categories of unknown posts, repeated posts
    and ids that are not in the taxonomy. Empty where all is well."""
    ids = posts.where("id IS NOT NULL").select(F.col("id").alias("post_id")).distinct()
    known = taxonomy.select(F.lower(F.trim("category_id")).alias("category_id")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    parts = [
        count(ids.join(published, "post_id", "left_anti"), "uncovered"), count(published.join(ids, "post_id", "left_anti"), "unknown post"),
        count(published.groupBy("post_id").count().where("count > 1"), "repeated"), count(published.withColumn("category_id", F.lower(F.trim("category_id"))).join(known, "category_id", "left_anti"), "unknown category"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
