"""Queries of full-text search and the overlay, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as X
from .operators import overlay, search
from .plans import shared_folder
from .registry import query
from .schema import documents
from .sources import table
from .sources.generation import Generations
from .sources.stores import path_of
from .sqltext import DOCS, KEYED, collapsed, norm, visible, words


def docs_of(spark, folder):
    return documents(table(spark, folder, "threads"), table(spark, folder, "posts"))


_INDEXES: dict[tuple, Generations] = {}


def index_of(spark, folder) -> Generations:
    """The index over a folder's forum, built once a session, in the shared folder; built anew where the tables' files have changed."""
    state = []
    for name in ("threads", "posts"):
        fs, p = path_of(spark, f"{folder.rstrip('/')}/{name}.parquet")
        state += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    key = (spark.sparkContext.applicationId, *state)
    if key not in _INDEXES:
        g = Generations(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        g.publish(docs_of(spark, folder), "whole", "1")
        _INDEXES[key] = g
    return _INDEXES[key]


_POSTINGS = f"""forms AS (SELECT doc_key, kind, 'user' AS field, {norm('username')} AS form FROM docs UNION ALL SELECT doc_key, kind, 'title', {norm(visible('title'))} FROM docs UNION ALL SELECT doc_key, kind, 'body', {norm(visible('body'))} FROM docs),
listed AS (SELECT doc_key, kind, field, {words('form')} AS w FROM forms),
toks AS (SELECT doc_key, kind, field, unnest(w) AS term, unnest(range(len(w))) AS pos FROM listed),
post AS (SELECT field, term, doc_key, kind, count(*) AS tf FROM toks GROUP BY ALL),
lex AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL), size AS (SELECT count(*) AS n FROM docs)"""
INDEX = f"WITH {DOCS}, {_POSTINGS}"


def _rank_sql(text: str, scopes=search.SCOPES) -> str:
    """The ranking of a query as SQL: one sub-query for each token, joined for clauses and fields."""
    ok = f"(p.field = 'user' AND {str('user' in scopes).lower()}) OR (p.field <> 'user' AND ((p.kind = 't' AND {str('post' in scopes).lower()}) OR (p.kind = 'r' AND {str('replies' in scopes).lower()})))"
    parts = []
    clauses = search.parse(text)
    for i, c in enumerate(clauses):
        toks = []
        for j, t in enumerate(c.tokens):
            cond = f"starts_with(p.term, '{t}')" if c.prefix else f"p.term = '{t}'"
            only = f"AND p.field = '{c.field}'" if c.field else ""
            toks.append(
                f"(SELECT p.doc_key, p.field, sum((CASE p.field WHEN 'user' THEN 5.0 WHEN 'title' THEN 4.0 ELSE 1.0 END) * ln(1 + (size.n - l.df + 0.5) / (l.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2)) AS s "
                f"FROM post p JOIN lex l ON l.field = p.field AND l.term = p.term, size WHERE {cond} {only} AND ({ok}) GROUP BY p.doc_key, p.field) t{j}"
            )
        joined = toks[0] + "".join(f" JOIN {x} ON t{j + 1}.doc_key = t0.doc_key AND t{j + 1}.field = t0.field" for j, x in enumerate(toks[1:]))
        total = " + ".join(f"t{j}.s" for j in range(len(toks)))
        phrase = ""
        if c.phrase:
            chain = "toks a0" + "".join(f" JOIN toks a{j} ON a{j}.doc_key = a0.doc_key AND a{j}.field = a0.field AND a{j}.pos = a0.pos + {j} AND a{j}.term = '{t}'" for j, t in enumerate(c.tokens) if j)
            phrase = f" WHERE EXISTS (SELECT 1 FROM {chain} WHERE a0.term = '{c.tokens[0]}' AND a0.doc_key = t0.doc_key AND a0.field = t0.field)"
            total += " + 6.0"
        parts.append(f"(SELECT doc_key, max(s) AS s FROM (SELECT t0.doc_key, {total} AS s FROM {joined}{phrase}) GROUP BY doc_key) c{i}")
    joined = parts[0] + "".join(f" JOIN {x} ON c{i + 1}.doc_key = c0.doc_key" for i, x in enumerate(parts[1:]))
    return f"SELECT c0.doc_key, round({' + '.join(f'c{i}.s' for i in range(len(parts)))}, 4) AS score FROM {joined}"


def _search_sql(text: str, where: str = "true", scopes=search.SCOPES, top: str = "") -> str:
    return f"{INDEX}, ranked AS ({_rank_sql(text, scopes)}) SELECT d.doc_key, d.kind, d.thread_id, d.username, d.created_at, r.score FROM ranked r JOIN docs d ON d.doc_key = r.doc_key WHERE {where}{top}"


def _register(name: str, text: str, where: str = "true", scopes=search.SCOPES, **options) -> None:
    def run(spark, folder):
        return index_of(spark, folder).search(text, scopes=scopes, **options)

    run.__name__ = name
    query(_search_sql(text, where, scopes))(run)


_register("search_term", "espresso")
_register("search_and", "deposit landlord")
_register("search_field_title", "title:harness")
_register("search_field_user", "user:tealrooferban")
_register("search_phrase", '"sleep diary" pillow')
_register("search_prefix", "title:re* dep*")
_register("search_scoped", "deposit", scopes=("post",))
_register("search_kind", "deposit", "d.kind = 'r'", kind="r")
_register("search_author_exact", "after", f"trim({norm('d.username')}) = 'tealrooferban'", author="TealRooferban")


@query(_search_sql("deposit", top=" ORDER BY r.score DESC, d.created_at DESC, d.doc_key LIMIT 25 OFFSET 25"))
def search_page(spark, folder):
    return search.page(index_of(spark, folder).search("deposit"), 25, 25)


@query(f"{INDEX}, ranked AS ({_rank_sql('deposit landlord')}) SELECT count(*) AS total, count(*) > 1000 AS truncated FROM ranked")
def search_total(spark, folder):
    return index_of(spark, folder).search("deposit landlord").agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > 1000)


@query(f"{INDEX} SELECT field, term, doc_key, tf FROM post WHERE starts_with(term, 'es')")
def inverted_index(spark, folder):
    posts = search.postings(docs_of(spark, folder), [search.Clause(None, ("es",), prefix=True)])
    return posts.select("field", "term", "doc_key", "tf")


@query(f"{INDEX}, p AS (SELECT field, term, doc_key, string_agg(pos, ',' ORDER BY pos) AS positions FROM toks WHERE term = 'espresso' GROUP BY ALL) SELECT * FROM p")
def posting_positions(spark, folder):
    posts = search.postings(docs_of(spark, folder), search.parse("espresso"))
    return posts.select("field", "term", "doc_key", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"{INDEX}, p AS (SELECT field, term, doc_key, kind, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM toks GROUP BY ALL) SELECT * FROM p")
def positional_index(spark, folder):
    """The whole index: every posting of every term, with its positions."""
    return search.postings(docs_of(spark, folder)).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"{INDEX} SELECT field, term, df, term IN ({_STOP}) AS stop FROM lex")
def lexicon(spark, folder):
    return index_of(spark, folder).read("lexicon")


@query(f"{INDEX} SELECT substring(term, 1, 3) AS prefix, field, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings FROM lex GROUP BY ALL")
def term_shards(spark, folder):
    lex = index_of(spark, folder).read("lexicon")
    return lex.groupBy(F.substring("term", 1, 3).alias("prefix"), "field").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))


@query(f"{INDEX} SELECT (SELECT n FROM size) AS n_docs, (SELECT count(*) FROM docs WHERE kind = 't') AS n_threads, (SELECT count(*) FROM docs WHERE kind = 'r') AS n_replies, (SELECT count(DISTINCT term) FROM lex) AS n_terms, (SELECT max(created_at) FROM docs) AS watermark")
def index_stats(spark, folder):
    docs = docs_of(spark, folder)
    terms = index_of(spark, folder).read("lexicon").select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    counts = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("kind") == "t").alias("n_threads"), F.count_if(F.col("kind") == "r").alias("n_replies"), F.max("created_at").alias("watermark"))
    return counts.join(F.broadcast(terms)).select("n_docs", "n_threads", "n_replies", "n_terms", "watermark")


@query(
    f"""WITH {DOCS}, {KEYED}, forms AS (SELECT doc_key, kind, member, ' ' || array_to_string({words(norm('username'))}, ' ') || ' ' AS u, ' ' || array_to_string({words(norm(visible('title')))}, ' ') || ' ' AS t, ' ' || array_to_string({words(norm(visible('body')))}, ' ') || ' ' AS b FROM keyed),
    s AS (SELECT doc_key,
      (CASE WHEN contains(t, ' sleep diary ') THEN 10.0 ELSE 0 END + CASE WHEN contains(b, ' sleep diary ') THEN 7.0 ELSE 0 END + CASE WHEN contains(u, ' sleep diary ') THEN 11.0 ELSE 0 END) AS c1,
      (CASE WHEN contains(u, ' pil') THEN 5.0 ELSE 0 END + CASE WHEN contains(t, ' pil') THEN 4.0 ELSE 0 END + CASE WHEN contains(b, ' pil') THEN 1.0 ELSE 0 END) AS c2 FROM forms)
    SELECT doc_key, c1 + c2 AS score FROM s WHERE c1 > 0 AND c2 > 0"""
)
def search_additive(spark, folder):
    return search.additive(docs_of(spark, folder), '"sleep diary" pil*')


@query(
    f"""WITH {DOCS}, f AS (SELECT doc_key, {collapsed('body')} AS flat FROM docs), a AS (SELECT doc_key, flat, instr({norm('flat')}, 'espresso') AS at_ FROM f), b AS (SELECT *, greatest(1, at_ - 80) AS st FROM a WHERE at_ > 0)
    SELECT doc_key, (CASE WHEN st > 1 THEN '…' ELSE '' END) || substring(flat, st, 240) || (CASE WHEN length(flat) >= st + 240 THEN '…' ELSE '' END) AS snippet FROM b"""
)
def snippet_window(spark, folder):
    docs = docs_of(spark, folder).where(F.instr(X.normalise(X.collapsed("body")), "espresso") > 0)
    return docs.select("doc_key", X.snippet(F.col("body"), "espresso").alias("snippet"))


@query(f"WITH {DOCS}, w AS (SELECT doc_key, unnest({words(norm(visible('title')))}) AS term FROM docs) SELECT doc_key, term, count(*) AS n FROM w GROUP BY ALL")
def tokenise_terms(spark, folder):
    return docs_of(spark, folder).select("doc_key", F.explode(X.tokens(X.visible_text("title"))).alias("term")).groupBy("doc_key", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS} SELECT username, trim({norm('username')}) AS member, count(*) AS n FROM docs GROUP BY ALL")
def normalise_usernames(spark, folder):
    return docs_of(spark, folder).groupBy("username", X.identity_key("username").alias("member")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS}, {KEYED} SELECT member AS key, min(trim(username)) AS display FROM keyed WHERE member <> '' AND starts_with(member, 'br') AND member <> 'brasscompassban' GROUP BY member ORDER BY 1, 2 LIMIT 20")
def username_suggest(spark, folder):
    return search.suggest_usernames(docs_of(spark, folder), "BR", ("BrassCompassban",))


@query(f"WITH {DOCS}, v AS (SELECT doc_key, {visible('body')} AS visible_text FROM docs) SELECT * FROM v")
def visible_text(spark, folder):
    return docs_of(spark, folder).select("doc_key", X.visible_text("body").alias("visible_text"))


@query(
    f"""WITH {DOCS}, l AS (SELECT doc_key, unnest(regexp_extract_all({visible('body')}, 'https?://[^\\s<>"'']+')) AS u FROM docs)
    SELECT doc_key, regexp_replace(u, '[.,;:!?\\])}}]+$', '') AS href, count(*) AS n FROM l GROUP BY ALL"""
)
def safe_links(spark, folder):
    return docs_of(spark, folder).select("doc_key", F.explode(X.links("body")).alias("href")).groupBy("doc_key", "href").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = "TIMESTAMP '2025-01-01 00:00:00'"
_BASE = f"""{DOCS}, base AS (SELECT thread_id, title, username, created_at FROM docs WHERE kind = 't' AND created_at < {_SPLIT}),
delta AS (SELECT id AS thread_id, coalesce(min(title), '') AS title, coalesce(min(author), '') AS username, max(ingested_at) AS created_at FROM threads WHERE id IS NOT NULL AND ingested_at >= {_SPLIT} GROUP BY id),
gone AS (SELECT DISTINCT item_id AS thread_id FROM tombstones WHERE kind = 't'),
laid AS (SELECT * FROM base WHERE thread_id NOT IN (SELECT thread_id FROM delta) AND thread_id NOT IN (SELECT thread_id FROM gone) UNION ALL SELECT * FROM delta WHERE thread_id NOT IN (SELECT thread_id FROM gone))"""


def _sides(spark, folder):
    split = F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    threads = table(spark, folder, "threads")
    base = docs_of(spark, folder).where((F.col("kind") == "t") & (F.col("created_at") < split)).select("thread_id", "title", "username", "created_at")
    delta = threads.where(F.col("id").isNotNull() & (F.col("ingested_at") >= split)).groupBy(F.col("id").alias("thread_id")).agg(F.coalesce(F.min("title"), F.lit("")).alias("title"), F.coalesce(F.min("author"), F.lit("")).alias("username"), F.max("ingested_at").alias("created_at"))
    gone = table(spark, folder, "tombstones").where("kind = 't'").select(F.col("item_id").alias("thread_id")).distinct()
    return base, delta, gone


@query(f"WITH {_BASE} SELECT * FROM laid")
def overlay_catalogue(spark, folder):
    return overlay.overlay(*_sides(spark, folder))


@query(
    f"""{INDEX}, ranked AS ({_rank_sql('deposit')}), hits AS (SELECT d.doc_key, d.kind, d.thread_id, d.username, d.created_at, r.score FROM ranked r JOIN docs d ON d.doc_key = r.doc_key),
    gone AS (SELECT DISTINCT item_id AS thread_id FROM tombstones WHERE kind = 't'), d AS (SELECT * FROM hits WHERE created_at >= {_SPLIT}),
    both_ AS (SELECT * FROM hits WHERE created_at < {_SPLIT} AND thread_id NOT IN (SELECT thread_id FROM d) AND thread_id NOT IN (SELECT thread_id FROM gone) UNION ALL SELECT * FROM d WHERE thread_id NOT IN (SELECT thread_id FROM gone))
    SELECT doc_key, kind, thread_id, username, created_at, score FROM both_"""
)
def merged_search(spark, folder):
    hits = index_of(spark, folder).search("deposit")
    split = F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    gone = table(spark, folder, "tombstones").where("kind = 't'").select(F.col("item_id").alias("thread_id")).distinct()
    return overlay.merged(hits.where(F.col("created_at") < split), hits.where(F.col("created_at") >= split), gone).select("doc_key", "kind", "thread_id", "username", "created_at", "score")


@query(
    f"""WITH {_BASE}, was AS (SELECT thread_id, title, username, created_at FROM base) SELECT d.thread_id, d.title, d.username, d.created_at, CASE WHEN w.thread_id IS NULL THEN 'new' ELSE 'edited' END AS change
    FROM delta d LEFT JOIN was w ON w.thread_id = d.thread_id WHERE w.thread_id IS NULL OR w.title IS DISTINCT FROM d.title OR w.username IS DISTINCT FROM d.username OR w.created_at IS DISTINCT FROM d.created_at"""
)
def delta_changes(spark, folder):
    base, delta, _ = _sides(spark, folder)
    return overlay.changed(delta, base, "thread_id", ["title", "username", "created_at"])


@query(f"WITH {_BASE} SELECT DISTINCT thread_id FROM base WHERE thread_id NOT IN (SELECT thread_id FROM laid)")
def removed_threads(spark, folder):
    base, delta, gone = _sides(spark, folder)
    return overlay.removed(overlay.overlay(base, delta, gone), base, "thread_id")


@query(f"WITH {_BASE} SELECT * FROM delta WHERE created_at > TIMESTAMP '2025-02-01 00:00:00'")
def delta_prune(spark, folder):
    return overlay.pruned(_sides(spark, folder)[1], F.to_timestamp_ntz(F.lit("2025-02-01 00:00:00")), "created_at")


@query(f"WITH {_BASE}, m AS (SELECT max(created_at) AS at_ FROM delta) SELECT d.* FROM delta d, m WHERE d.created_at >= m.at_ - INTERVAL 48 HOURS")
def recent_threads(spark, folder):
    _, delta, _ = _sides(spark, folder)
    top = delta.agg(F.max("created_at").alias("_at"))
    return overlay.recent(delta.join(F.broadcast(top)), F.col("_at"), F.col("_at"), at="created_at").drop("_at")
