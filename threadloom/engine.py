"""One object over a forum's tables: the views a reader uses, each a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import categories, conversation, members, search, state, views
from .schema import documents


@dataclass(frozen=True)
class Visibility:
    """What a reader does not want to see: authors with all below them, and threads; ``reveal`` shows everything."""

    blocked: tuple[str, ...] = ()
    muted: DataFrame | None = None
    reveal: bool = False


@dataclass
class Forum:
    docs: DataFrame
    thread_labels: DataFrame | None = None
    post_labels: DataFrame | None = None
    postings: DataFrame | None = None
    lexicon: DataFrame | None = None
    n_docs: int | None = None
    taxonomy: DataFrame | None = None
    visibility: Visibility = field(default_factory=Visibility)

    @classmethod
    def of(cls, threads: DataFrame, posts: DataFrame, **rest) -> Forum:
        return cls(documents(threads, posts), **rest)

    def seen_by(self, visibility: Visibility) -> Forum:
        return replace(self, visibility=visibility)

    def visible(self) -> DataFrame:
        v = self.visibility
        if v.reveal:
            return self.docs
        own = conversation.visible(self.docs, v.blocked) if v.blocked else self.docs
        return views.unmuted(own, v.muted) if v.muted is not None else own

    def rollup(self) -> DataFrame:
        return views.thread_rollup(self.visible())

    def search(self, query: str, limit: int = 25, offset: int = 0, **options) -> DataFrame:
        """A page of hits. ``category:id`` and ``category:"a label"`` terms keep hits of that category's threads (of a category
        that is not known, none); they need another term beside them."""
        wanted, rest = search.categories_of(query)
        if wanted and not search.parse(rest):
            raise ValueError("a category needs another term beside it")
        hits = search.search(self.visible(), rest, posts=self.postings, lex=self.lexicon, n_docs=self.n_docs, **options)
        for category in wanted:
            hits = hits.join(self.threads_of(category), "thread_id", "left_semi")
        return search.page(hits, limit, offset)

    def threads_of(self, category: str) -> DataFrame:
        """thread_id of the threads labelled with a category, given by id or, where the taxonomy is there, by label."""
        name = self.docs.sparkSession.createDataFrame([(category.strip('"'),)], "name string")
        known = name.select(F.lower(F.trim("name")).alias("category_id")) if self.taxonomy is None else categories.resolve_ids(name, self.taxonomy).select(F.lower(F.trim("category_id")).alias("category_id"))
        return categories.latest_labels(self.thread_labels, "thread_id").join(F.broadcast(known), "category_id", "left_semi").select("thread_id")

    def by_author(self, name: str, kind: str) -> DataFrame:
        from .functions.text import identity_key

        return self.visible().where((F.col("kind") == kind) & (identity_key("username") == search.fold(name).strip())).orderBy(F.desc("created_at"), F.desc("post_id"))

    def classic(self, sort: str = "datedesc", limit: int = 25, offset: int = 0, pinned: int | None = None) -> DataFrame:
        return views.classic(self.rollup(), sort, limit, offset, pinned)

    def unloved(self) -> DataFrame:
        return views.unloved(self.rollup()).orderBy("created_at", "thread_id")

    def backfill(self, seed: str, count: int, exclude: list[int] | None = None) -> DataFrame:
        return views.backfill(self.rollup(), seed, count, exclude)

    def category_threads(self, category: str, limit: int = 25, offset: int = 0) -> DataFrame:
        own = self.rollup().join(self.threads_of(category), "thread_id", "left_semi")
        return own.orderBy(F.desc("last_post_at"), F.desc("thread_id")).offset(offset).limit(limit)

    def members(self) -> DataFrame:
        return members.member_stats(self.visible()).orderBy(F.desc("last_active"), "member")

    def suggest_usernames(self, prefix: str, exclude: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        return search.suggest_usernames(self.docs, prefix, exclude, limit)

    def unanswered(self, me: str) -> DataFrame:
        return conversation.branches(self.docs, me, () if self.visibility.reveal else self.visibility.blocked).orderBy(F.desc("created_at"), F.desc("doc_key"))

    def notifications(self, me: str) -> DataFrame:
        return conversation.notifications(self.visible(), me).orderBy(F.desc("created_at"), F.desc("doc_key"))

    def navigation_target(self, doc_key: str) -> DataFrame:
        """The document and its thread's root in one row; empty where either is missing or hidden. Of a key that is not of the form
        ``t:1`` or ``r:1`` a ValueError tells."""
        if not re.fullmatch(r"[tr]:\d+", doc_key):
            raise ValueError(f"no document key: {doc_key!r:.40}")
        own = self.visible()
        root = own.where("kind = 't'").select("thread_id", F.col("title").alias("thread_title"), F.col("username").alias("thread_author"))
        return own.where(F.col("doc_key") == doc_key).join(root, "thread_id")

    def navigate(self, doc_key: str) -> dict:
        """The one row of ``navigation_target``; a LookupError where the document or its root is missing or hidden."""
        row = self.navigation_target(doc_key).first()
        if row is None:
            raise LookupError(f"{doc_key} is not there")
        return row.asDict()

    def read_state(self, prior: DataFrame | None = None) -> DataFrame:
        now = self.docs.select("doc_key", "thread_id", state.fingerprint("thread_id", "parent_post_id", "username", "title", "body").alias("fp"))
        return state.merge_read_state(prior, now)

    def unread(self, marks: DataFrame) -> DataFrame:
        """The unread documents that are visible, the newest first."""
        return state.unread_list(marks, self.visible())

    def saved(self, kept: DataFrame, marks: DataFrame | None = None) -> DataFrame:
        """Saved threads, the latest first; what is hidden or gone is marked as missing."""
        return state.thread_list(kept, self.rollup(), marks)

    def page_of(self, rows: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
        """A page of any list; the limit is held within 1 and 100."""
        return rows.offset(max(0, offset)).limit(max(1, min(100, limit)))

    def category_of_replies(self, posts: DataFrame) -> DataFrame:
        return categories.resolve(posts, self.thread_labels, self.post_labels)
