"""Parts of the SQL that the queries are compared with: the documents and the text functions, said in the other engine's words."""

from __future__ import annotations

from .functions.text import fold_map


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    src, dst = fold_map()
    return f"lower(translate({x}, {_quoted(src)}, {_quoted(dst)}))"


def visible(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{plain}')"
    return out


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"


DOCS = r"""docs AS (
  SELECT 't:' || id AS doc_key, 't' AS kind, id AS post_id, id AS thread_id, CAST(NULL AS BIGINT) AS parent_post_id, coalesce(min(author), '') AS username, coalesce(min(title), '') AS title,
    coalesce(min(message), '') AS body, min(ingested_at) AS created_at, regexp_extract(coalesce(min(source_url), ''), '/b/([^/?#]+)', 1) AS board FROM threads WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'r:' || id, 'r', id, min(thread_id), min(CASE WHEN parent_id <> 0 THEN parent_id END), coalesce(min(author), ''), coalesce(min(title), ''),
    coalesce(min(message), ''), min(ingested_at), regexp_extract(coalesce(min(source_url), ''), '/b/([^/?#]+)', 1) FROM posts WHERE id IS NOT NULL GROUP BY id)"""

KEYED = f"keyed AS (SELECT *, trim({norm('username')}) AS member, lower({collapsed('username')}) AS author FROM docs)"

ROLLUP = """rollup_ AS (
  SELECT t.thread_id, t.title, t.username, t.body, t.created_at, coalesce(r.n, 0) AS reply_count, greatest(t.created_at, coalesce(r.last_at, t.created_at)) AS last_post_at
  FROM docs t LEFT JOIN (SELECT thread_id, count(*) AS n, max(created_at) AS last_at FROM docs WHERE kind = 'r' GROUP BY thread_id) r ON r.thread_id = t.thread_id WHERE t.kind = 't')"""
