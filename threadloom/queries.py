"""The queries of the core: name, plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import hierarchy, references
from .registry import QUERIES, SQL, query
from .sources import table

__all__ = ["QUERIES", "SQL"]


def _forum(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, folder, t) for t in ("posts", "threads", "post_categories", "tombstones"))


_REFS = """
refs AS (
  SELECT 'posts' AS table_name, 'thread_id' AS field_name, id AS record_id, 't' AS kind, thread_id AS ref_id, min(ingested_at) AS seen_at
    FROM posts WHERE id IS NOT NULL AND thread_id IS NOT NULL GROUP BY id, thread_id
  UNION ALL
  SELECT 'posts', 'parent_id', id, 'r', parent_id, min(ingested_at) FROM posts WHERE id IS NOT NULL AND parent_id <> 0 GROUP BY id, parent_id
  UNION ALL
  SELECT 'post_categories', 'post_id', post_id, 'r', post_id, min(ingested_at) FROM post_categories WHERE post_id IS NOT NULL GROUP BY post_id),
parents AS (
  SELECT 't' AS kind, id, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM threads GROUP BY id
  UNION ALL SELECT 'r', id, min(ingested_at), max(ingested_at) FROM posts GROUP BY id),
stones AS (SELECT kind, item_id, max(deleted_at) AS gone_at FROM tombstones GROUP BY kind, item_id),
judged AS (
  SELECT r.table_name, r.field_name, r.record_id, r.ref_id, r.seen_at,
    CASE WHEN s.gone_at IS NOT NULL AND (p.last_at IS NULL OR p.last_at <= s.gone_at) THEN 'deleted'
         WHEN p.id IS NULL THEN 'missing'
         WHEN p.first_at > r.seen_at THEN 'late' END AS state
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.id = r.ref_id LEFT JOIN stones s ON s.kind = r.kind AND s.item_id = r.ref_id)
"""


@query(f"WITH {_REFS} SELECT table_name, field_name, record_id, ref_id, state FROM judged WHERE state IS NOT NULL")
def p4_found(spark, folder):
    return references.found(*_forum(spark, folder))


@query(f"WITH {_REFS} SELECT table_name, field_name, strftime(seen_at, '%Y-%m') AS month, state, count(*) AS n_refs, count(DISTINCT ref_id) AS n_keys FROM judged WHERE state IS NOT NULL GROUP BY 1, 2, 3, 4")
def p4_report(spark, folder):
    return references.report(*_forum(spark, folder))


_WALK = """
node AS (SELECT id, min(CASE WHEN parent_id <> 0 THEN parent_id END) AS parent FROM posts WHERE id IS NOT NULL GROUP BY id),
walk AS (
  SELECT id AS start, id AS cur, 0 AS steps, [id] AS seen, false AS looped FROM node
  UNION ALL
  SELECT w.start, n.parent, w.steps + 1, list_append(w.seen, n.parent), list_contains(w.seen, n.parent)
    FROM walk w JOIN node n ON n.id = w.cur JOIN node p ON p.id = n.parent WHERE NOT w.looped),
last AS (SELECT start, max(steps) AS steps FROM walk GROUP BY start),
whole AS (
  SELECT w.start AS id, n.parent,
    CASE WHEN w.looped THEN list_min(list_slice(w.seen, list_position(w.seen, w.cur), len(w.seen))) ELSE w.cur END AS root_id,
    CASE WHEN w.looped THEN -1 ELSE w.steps END AS depth,
    CASE WHEN w.looped THEN NULL ELSE list_reverse(w.seen) END AS path
  FROM walk w JOIN last l ON l.start = w.start AND l.steps = w.steps JOIN node n ON n.id = w.start)
"""


@query(f"WITH RECURSIVE {_WALK} SELECT id AS post_id, root_id, CAST(depth AS BIGINT) AS depth FROM whole WHERE parent IS NOT NULL")
def p6_found(spark, folder):
    return hierarchy.found(table(spark, folder, "posts"))


@query(
    f"""WITH RECURSIVE {_WALK},
    pairs AS (SELECT unnest(path[:-2]) AS id FROM whole WHERE depth > 0), below AS (SELECT id, count(*) AS n FROM pairs GROUP BY id)
    SELECT w.id, w.root_id, CAST(w.depth AS BIGINT) AS depth, coalesce(array_to_string(w.path, '/'), '') AS path, CASE WHEN w.depth >= 0 THEN coalesce(b.n, 0) ELSE -1 END AS n_descendants
    FROM whole w LEFT JOIN below b ON b.id = w.id"""
)
def p6_trees(spark, folder):
    return hierarchy.trees(table(spark, folder, "posts"))


@query(
    f"""WITH RECURSIVE {_WALK}, pairs AS (SELECT id AS descendant_id, depth, unnest(path) AS ancestor_id, unnest(range(len(path))) AS pos FROM whole WHERE depth > 0)
    SELECT ancestor_id, descendant_id, CAST(depth - pos AS BIGINT) AS distance FROM pairs WHERE pos < depth"""
)
def p6_descendants(spark, folder):
    return hierarchy.descendants(table(spark, folder, "posts"))


@query(f"WITH RECURSIVE {_WALK} SELECT root_id AS loop_id, count(*) AS n_nodes FROM whole WHERE depth = -1 GROUP BY root_id")
def p6_loops(spark, folder):
    return hierarchy.loops(table(spark, folder, "posts"))


from . import queries_forum, queries_live, queries_search  # noqa: E402, F401
