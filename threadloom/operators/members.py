"""Member statistics and interaction dynamics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def member_stats(docs: DataFrame) -> DataFrame:
    """One row for each author key: counts and latest times of topics and replies, shown in the latest spelling.

    Partial aggregation makes a member with a third of all posts one row a task."""
    key = X.identity_key("username")
    topic, reply = F.col("kind") == "t", F.col("kind") == "r"
    out = docs.withColumn("member", key).where(F.col("member") != "")
    # the latest spelling; ties go to the smaller one: first the best time of each spelling, then of each member
    spelled = out.groupBy("member", F.trim("username").alias("display")).agg(F.max("created_at").alias("last_used"), F.count_if(topic).alias("n_topics"), F.count_if(reply).alias("n_replies"), F.max(F.when(topic, F.col("created_at"))).alias("latest_topic"), F.max(F.when(reply, F.col("created_at"))).alias("latest_reply"))
    best = spelled.groupBy("member").agg(F.max("last_used").alias("at"), F.sum("n_topics").alias("n_topics"), F.sum("n_replies").alias("n_replies"), F.max("latest_topic").alias("latest_topic"), F.max("latest_reply").alias("latest_reply"))
    shown = spelled.join(best.select("member", F.col("at").alias("last_used")), ["member", "last_used"]).groupBy("member").agg(F.min("display").alias("username"))
    return best.join(shown, "member").select("member", "username", "n_topics", "n_replies", "latest_topic", "latest_reply", F.greatest("latest_topic", "latest_reply").alias("last_active"))


def user_activity(docs: DataFrame) -> DataFrame:
    """author, threads, replies, posts, active_days, posts_per_day."""
    own = docs.withColumn("author", F.lower(X.collapsed("username"))).where("author <> ''")
    days = F.countDistinct(F.to_date("created_at"))
    return own.groupBy("author").agg(F.count_if(F.col("kind") == "t").alias("threads"), F.count_if(F.col("kind") == "r").alias("replies"), F.count(F.lit(1)).alias("posts"), days.alias("active_days")).withColumn("posts_per_day", F.round(F.col("posts") / F.greatest(F.lit(1), F.col("active_days")), 2))


def hours(docs: DataFrame) -> DataFrame:
    own = docs.withColumn("author", F.lower(X.collapsed("username"))).where("author <> '' AND created_at IS NOT NULL")
    return own.groupBy("author", F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def hour_entropy(docs: DataFrame) -> DataFrame:
    """author, entropy of the hours of posting in bits."""
    h = hours(docs)
    total = h.groupBy("author").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return h.join(total, "author").groupBy("author").agg(F.round(-F.sum(p * F.log2(p)), 3).alias("entropy")).withColumn("entropy", F.when(F.col("entropy") == 0, 0.0).otherwise(F.col("entropy")))


def peak_hours(docs: DataFrame, n: int = 3) -> DataFrame:
    """author, rank, hour, n: the busiest hours (at most 24 rows an author are ranked)."""
    w = Window.partitionBy("author").orderBy(F.desc("n"), "hour")
    return hours(docs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def interactions(docs: DataFrame) -> DataFrame:
    """author, target, asked_at, answered_at of every reply to somebody else: to the parent reply, else to the thread."""
    who = F.lower(X.collapsed("username"))
    replies = docs.where("kind = 'r'").select("post_id", "thread_id", F.col("parent_post_id").alias("parent"), who.alias("author"), F.col("created_at").alias("answered_at"))
    parents = replies.select(F.col("post_id").alias("parent"), F.col("author").alias("parent_author"), F.col("answered_at").alias("parent_at"), F.lit(True).alias("has_parent"))
    roots = docs.where("kind = 't'").select("thread_id", who.alias("root_author"), F.col("created_at").alias("root_at"))
    # the thread side has one row a thread and AQE splits the partition of a hot thread
    both = replies.join(parents, "parent", "left").join(roots, "thread_id", "left")
    target = F.when(F.col("has_parent"), F.col("parent_author")).otherwise(F.col("root_author"))
    asked = F.when(F.col("has_parent"), F.col("parent_at")).otherwise(F.col("root_at"))
    return both.select("author", target.alias("target"), asked.alias("asked_at"), "answered_at").where("author <> '' AND target <> '' AND author <> target")


def edges(docs: DataFrame) -> DataFrame:
    """author, target, n_replies, n_back, median_minutes: upper median of the delays between 0 and 30 days."""
    every = interactions(docs)
    seconds = F.expr("CAST(CAST(answered_at - asked_at AS INTERVAL SECOND) AS DECIMAL(20, 6))").cast("double")
    held = F.when((seconds >= 0) & (seconds <= 86_400 * 30), seconds)
    counts = every.withColumn("s", held).groupBy("author", "target").agg(F.count(F.lit(1)).alias("n_replies"), F.count("s").alias("n"))
    # the upper median by rank: first the minute it falls into, from counts (at most 43,201 a pair), then its place among the delays of
    # that minute alone, so no pair's delays are sorted or gathered as a whole
    pair = ["author", "target"]
    delays = every.withColumn("s", held).where("s IS NOT NULL").withColumn("m", F.floor(F.col("s") / 60))
    upto = Window.partitionBy(*pair).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    minutes = delays.groupBy(*pair, "m").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(upto)).join(counts.select(*pair, "n"), pair)
    want = F.floor(F.col("n") / 2) + 1
    place = minutes.where((want <= F.col("upto")) & (want > F.col("upto") - F.col("k"))).select(*pair, "m", (want - F.col("upto") + F.col("k")).alias("nth"))
    among = delays.join(place, [*pair, "m"]).groupBy(*pair, "nth", "s").agg(F.count(F.lit(1)).alias("k"))
    ranked = among.withColumn("upto", F.sum("k").over(Window.partitionBy(*pair).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    middle = ranked.where((F.col("nth") <= F.col("upto")) & (F.col("nth") > F.col("upto") - F.col("k"))).select(*pair, F.round(F.col("s") / 60, 1).alias("median_minutes"))
    back = counts.select(F.col("target").alias("author"), F.col("author").alias("target"), F.col("n_replies").alias("n_back"))
    return counts.drop("n").join(back, ["author", "target"], "left").join(middle, ["author", "target"], "left").select("author", "target", "n_replies", F.coalesce("n_back", F.lit(0)).alias("n_back"), "median_minutes")


def shared_threads(docs: DataFrame, names: list[str]) -> DataFrame:
    """a, b, n_threads: threads in which both of two of the named authors take part; the names are the query set."""
    own = docs.withColumn("author", F.lower(X.collapsed("username"))).where(F.col("author").isin(*names)).select("thread_id", "author").distinct()
    a, b = own.withColumnRenamed("author", "a"), own.withColumnRenamed("author", "b")
    return a.join(b, "thread_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_threads"))
