"""The SQL of those queries of the subpackage that SQL can say over whole tables."""

from __future__ import annotations

import unicodedata

from .lookalike import plain_rewriter
from .spans import LENGTH


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form(x: str) -> str:
    """The consistent form of a text with plain representatives, by composition and replacement of single characters."""
    table = {f: p for f, p in plain_rewriter().table.items() if len(f) == 1}
    one = {f: p for f, p in table.items() if len(p) == 1}
    gone = [f for f, p in table.items() if not p]
    out = x
    for f, p in table.items():
        if len(p) > 1 and unicodedata.normalize("NFC", p) == p:
            out = f"replace({out}, {_quoted(f)}, {_quoted(p)})"
    src, dst = "".join(one) + "".join(gone), "".join(one.values())
    step = lambda y: f"nfc_normalize(translate(nfc_normalize({y}), {_quoted(src)}, {_quoted(dst)}))"
    return step(step(out))


LOOKALIKES = f"""WITH m AS (SELECT DISTINCT id, message AS t FROM posts WHERE id IS NOT NULL AND message IS NOT NULL), a AS (SELECT author AS t, min(id) AS id FROM posts WHERE author IS NOT NULL GROUP BY author),
every AS (SELECT 'message' AS field_name, id, t FROM m UNION ALL SELECT 'author', id, t FROM a WHERE id IS NOT NULL), distinct_ AS (SELECT DISTINCT t FROM every), formed AS (SELECT t, {form('t')} AS f FROM distinct_), keyed AS (SELECT e.*, f.f FROM every e JOIN formed f ON f.t = e.t)
SELECT DISTINCT x.field_name, least(x.id, y.id) AS post_id_a, greatest(x.id, y.id) AS post_id_b FROM keyed x JOIN keyed y ON y.field_name = x.field_name AND y.f = x.f AND y.t <> x.t AND y.id <> x.id"""

_WINDOWS = f"""d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= {LENGTH}),
w AS (SELECT doc_id, pos, md5(substring(text, CAST(pos + 1 AS BIGINT), {LENGTH})) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - {LENGTH - 1})) AS pos FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), at_ AS (SELECT w.doc_id, w.pos FROM w JOIN s ON s.h = w.h),
g AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM at_), r AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
runs AS (SELECT doc_id, min(pos) AS start, max(pos) - min(pos) + {LENGTH} AS n_chars FROM r GROUP BY doc_id, run)"""

SHARED_PAIRS = f"WITH {_WINDOWS}, k AS (SELECT DISTINCT w.doc_id, w.h FROM w JOIN s ON s.h = w.h) SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM k x JOIN k y ON y.h = x.h AND x.doc_id < y.doc_id"

STRETCHES = f"WITH {_WINDOWS} SELECT doc_id, start, n_chars FROM runs"

COVERAGE = f"""WITH {_WINDOWS}, c AS (SELECT doc_id, sum(n_chars) AS n FROM runs GROUP BY doc_id), a AS (SELECT doc_id, max(length(text)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT a.doc_id, coalesce(a.n_chars, 0) AS n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS shared_chars, CASE WHEN a.n_chars > 0 THEN round(coalesce(c.n, 0) / a.n_chars, 4) ELSE 0.0 END AS shared_part FROM a LEFT JOIN c ON c.doc_id = a.doc_id"""
