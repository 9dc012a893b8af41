"""Full-text search: query parsing, the inverted index and ranking.

An index is two tables: postings (field, term, doc_key, tf, positions) and documents. Ranking reads only the postings of the
query's terms; documents are joined after the limit."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import cut, hot_of, skew_join

# The weight of a hit in each field, the bonuses and the saturation of term frequency.
WEIGHTS = {"user": 5.0, "title": 4.0, "body": 1.0}
PHRASE_BONUS, WHOLE_NAME_BONUS, K1 = 6.0, 8.0, 1.2
FIELDS = {"user": "username", "title": "title", "body": "body"}
SCOPES = ("user", "post", "replies")


@dataclass(frozen=True)
class Clause:
    """One condition of a query; all its tokens must match in one field."""

    field: str | None
    tokens: tuple[str, ...]
    phrase: bool = False
    prefix: bool = False
    value: str = ""


def fold(text: str) -> str:
    """The search form of a query, the same as that of columns."""
    src, dst = X.fold_map()
    table = {ord(c): (dst[i] if i < len(dst) else None) for i, c in enumerate(src)}
    return text.translate(table).lower()


def tokenise(text: str) -> tuple[str, ...]:
    out, word = [], ""
    for ch in fold(text):
        if unicodedata.category(ch)[0] in "LN":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return tuple(out + [word] if word else out)


def parse(query: str) -> list[Clause]:
    """``field:term``, ``"a phrase"``, ``pre*`` and plain terms, all of which must match; over-long queries have no clauses.

    ``email:`` is a field that no index holds, so nothing matches it."""
    if len(query.encode("utf-16-le")) // 2 > 512:
        return []
    out = []
    for field, phrase, term in re.findall(r'(?:\b(user|title|body|email):)?(?:"([^"]+)"|(\S+))', query, re.I):
        prefix = not phrase and term.endswith("*")
        own = tokenise(phrase or term)
        if own:
            out.append(Clause(field.lower() or None, own, bool(phrase), prefix, fold(phrase or term).strip()))
    return out


def categories_of(query: str) -> tuple[list[str], str]:
    """The ids or labels of ``category:id`` and ``category:"a label"`` terms, and the query without them."""
    own = re.compile(r'(?<!\S)category:(?:"([^"]*)"|(\S+))', re.I)
    return [a or b for a, b in own.findall(query)], " ".join(own.sub(" ", query).split())


def highlight_terms(query: str, most: int = 16) -> list[str]:
    """What a reader's view marks: the distinct tokens of two characters and more, in the order of the query."""
    return list(dict.fromkeys(t for c in parse(categories_of(query)[1]) for t in c.tokens if len(t) >= 2))[:most]


def check_prefix(clauses: list[Clause]) -> None:
    for c in clauses:
        if c.prefix and any(len(t) < 2 for t in c.tokens):
            raise ValueError("a prefix needs at least two characters")


def allowed(field: str, kind: Column, scopes: tuple[str, ...]) -> Column:
    """Whether a field of a document of that kind is in scope."""
    if field == "user":
        return F.lit("user" in scopes)
    return ((kind == "t") & F.lit("post" in scopes)) | ((kind == "r") & F.lit("replies" in scopes))


def matches(term: Column, clauses: list[Clause]) -> Column:
    wanted = sorted({t for c in clauses if not c.prefix for t in c.tokens})
    out = term.isin(*wanted) if wanted else F.lit(False)
    for p in sorted({t for c in clauses if c.prefix for t in c.tokens}):
        out = out | term.startswith(p)
    return out


def _tagged(placed: Column, field: str) -> Column:
    return F.transform(placed, lambda x: F.struct(F.lit(field).alias("field"), x["term"].alias("term"), x["pos"].alias("pos")))


def postings(docs: DataFrame, clauses: list[Clause] | None = None, html: bool = True) -> DataFrame:
    """field, term, doc_key, kind, tf, positions. With ``clauses`` only terms that they ask for are unrolled."""
    of_field = []
    for field, column in FIELDS.items():
        words = X.tokens(X.visible_text(column) if html and field != "user" else column)
        placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
        if clauses is not None:
            placed = F.filter(placed, lambda x: matches(x["term"], clauses))
        of_field.append(_tagged(placed, field))
    # for a whole index the documents are spread by key before they are unrolled: their tokens are then grouped where they are, and only the texts are shuffled
    laid = docs.repartition("doc_key") if clauses is None else docs
    flat = laid.select("doc_key", "kind", F.explode(F.flatten(F.array(*of_field))).alias("x")).select("doc_key", "kind", "x.field", "x.term", "x.pos")
    return flat.groupBy("field", "term", "doc_key", "kind").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lexicon(posts: DataFrame, keep_stop_words: bool = True) -> DataFrame:
    """field, term, df, stop; stop words can be left out."""
    posts = posts if keep_stop_words else posts.where(~F.col("term").isin(*X.STOP_WORDS))
    return posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).withColumn("stop", F.col("term").isin(*X.STOP_WORDS))


def bm25(weight: Column, n: Column, df: Column, tf: Column) -> Column:
    return weight * F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1)


def rank(posts: DataFrame, clauses: list[Clause], n_docs: int, scopes: tuple[str, ...] = SCOPES, lex: DataFrame | None = None) -> DataFrame:
    """doc_key, score of the documents that match every clause. Document counts of terms come from the rows of ``lex`` that the
    query asks for, or are counted.

    A clause scores in a field the sum over its tokens (a prefix the sum over its expansions), with a bonus for a phrase;
    its score is the best over fields, the document's the sum over clauses, rounded to four places."""
    check_prefix(clauses)
    own = posts.where(matches(F.col("term"), clauses))
    if "df" not in own.columns:
        own = cut(own) if lex is None else own
        few = (lexicon(own) if lex is None else lex.where(matches(F.col("term"), clauses))).select("field", "term", "df")
        # a query of plain terms has no more rows than words and fields; prefixes may stand for any number of terms
        own = skew_join(own, few, ["field", "term"], hot=hot_of(few, ["field", "term"], "df")) if any(c.prefix for c in clauses) else own.join(F.broadcast(few), ["field", "term"])
    own = own.where(F.when(F.col("field") == "user", allowed("user", F.col("kind"), scopes)).otherwise(allowed("title", F.col("kind"), scopes)))
    weight = F.create_map(*[x for f, w in WEIGHTS.items() for x in (F.lit(f), F.lit(w))])[F.col("field")]
    own = own.withColumn("s", bm25(weight, F.lit(n_docs), F.col("df"), F.col("tf")))
    slots = F.array(*[F.struct(F.lit(i).alias("clause"), F.lit(j).alias("tok"), F.lit(t).alias("want"), F.lit(c.prefix).alias("prefix"), F.lit(c.field or "").alias("only")) for i, c in enumerate(clauses) for j, t in enumerate(c.tokens)])
    hit = lambda q: ((q["only"] == "") | (q["only"] == F.col("field"))) & F.when(q["prefix"], F.col("term").startswith(q["want"])).otherwise(F.col("term") == q["want"])
    hits = own.withColumn("q", F.explode(F.filter(slots, hit))).select("doc_key", "field", "q.clause", "q.tok", "s", "positions")
    per_token = hits.groupBy("doc_key", "field", "clause", "tok").agg(F.sum("s").alias("s"), F.flatten(F.collect_list("positions")).alias("positions"))
    need = F.create_map(*[x for i, c in enumerate(clauses) for x in (F.lit(i), F.lit(len(c.tokens)))])[F.col("clause")]
    phrase = F.create_map(*[x for i, c in enumerate(clauses) for x in (F.lit(i), F.lit(c.phrase))])[F.col("clause")]
    per_field = per_token.groupBy("doc_key", "field", "clause").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_list(F.struct("tok", "positions"))).alias("at")).where(F.col("n") == need)
    adjacent = F.exists(F.col("at")[0], lambda p: F.forall(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.array_contains(F.element_at("at", i), (p + i).cast("int"))))
    scored = per_field.where(~phrase | adjacent).withColumn("s", F.col("s") + F.when(phrase, PHRASE_BONUS).otherwise(0.0))
    per_clause = scored.groupBy("doc_key", "clause").agg(F.max("s").alias("s"))
    return per_clause.groupBy("doc_key").agg(F.round(F.sum("s"), 4).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(clauses)).select("doc_key", "score")


def search(docs: DataFrame, query: str, scopes: tuple[str, ...] = SCOPES, kind: str | None = None, author: str | None = None, hidden: DataFrame | None = None, gone: DataFrame | None = None, posts: DataFrame | None = None, lex: DataFrame | None = None, n_docs: int | None = None) -> DataFrame:
    """doc_key, kind, thread_id, username, created_at, score of all matches, unordered; ``hidden`` has doc_keys to leave out, ``gone`` thread_ids:
    what they leave out is in no total.

    With ``posts``, ``lex`` and ``n_docs`` of an index nothing is tokenised or counted; without them the documents are."""
    clauses = parse(query)
    if not clauses:
        return docs.select("doc_key", "kind", "thread_id", "username", "created_at", F.lit(0.0).alias("score")).limit(0)
    ranked = rank(posts if posts is not None else postings(docs, clauses), clauses, docs.count() if n_docs is None else n_docs, scopes, lex)
    own = docs.select("doc_key", "kind", "thread_id", "username", "created_at")
    if kind:
        own = own.where(F.col("kind") == kind)
    if author:
        own = own.where(X.identity_key("username") == fold(author).strip())
    out = own.join(ranked, "doc_key")
    out = out.join(hidden.select("doc_key"), "doc_key", "left_anti") if hidden is not None else out
    return out.join(gone.select("thread_id"), "thread_id", "left_anti").select("doc_key", "kind", "thread_id", "username", "created_at", "score") if gone is not None else out


def items(hits: DataFrame, docs: DataFrame, limit: int = 25, offset: int = 0, archived_from: int | None = None) -> DataFrame:
    """A page of hits with thread_title, reply_count, archived and the total of all hits. The titles and counts of the page's threads alone
    are looked up. A thread is archived once it has ``archived_from`` replies; of a hit whose root is missing they are null."""
    top = page(hits, limit, offset)
    own = F.broadcast(top.select("thread_id").distinct())  # at most as many as a page has rows
    threads = docs.join(own, "thread_id", "left_semi").groupBy("thread_id").agg(F.min(F.when(F.col("kind") == "t", F.col("title"))).alias("thread_title"), F.count_if(F.col("kind") == "r").alias("reply_count"))
    out = top.join(F.broadcast(threads), "thread_id", "left").join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total"))))
    full = F.col("reply_count") >= archived_from if archived_from is not None else F.lit(False)
    return out.select("doc_key", "kind", "thread_id", "username", "created_at", "score", "thread_title", "reply_count", full.alias("archived"), "total").orderBy(F.desc("score"), F.desc("created_at"), F.asc("doc_key"))


def term_info(lex: DataFrame, field: str, term: str) -> DataFrame:
    """The lexicon's row of a term in a field, or none."""
    return lex.where((F.col("field") == field) & (F.col("term") == fold(term)))


def terms(lex: DataFrame, field: str, prefix: str, limit: int = 128) -> DataFrame:
    """The terms of a field with a prefix, in order; more than ``limit`` are an error, for none is left out in silence."""
    own = lex.where((F.col("field") == field) & F.col("term").startswith(fold(prefix)))
    if own.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} terms begin with {prefix!r}")
    return own.orderBy("term")


def page(hits: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page in the canonical order: score, then newest, then key. The limit is held within 1 and 100."""
    return hits.orderBy(F.desc("score"), F.desc("created_at"), F.asc("doc_key")).offset(max(0, offset)).limit(max(1, min(100, limit)))


def _satisfied(words: Column, c: Clause) -> Column:
    """Whether the words of one field meet a clause."""
    wanted = F.array(*map(F.lit, c.tokens))
    if c.phrase:
        places = F.transform(words, lambda x, i: i)
        return F.exists(places, lambda i: F.slice(words, (i + 1).cast("int"), F.lit(len(c.tokens))) == wanted)
    if c.prefix:
        return F.forall(wanted, lambda t: F.exists(words, lambda x: x.startswith(t)))
    return F.forall(wanted, lambda t: F.array_contains(words, t))


def additive(docs: DataFrame, query: str, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """doc_key, score by the additive rule: every field that matches a clause adds its weight, with bonuses for phrases and
    for a whole author name. A document that misses a clause is left out."""
    clauses = parse(query)
    check_prefix(clauses)
    words = {f: F.col(f"_{f}") for f in FIELDS}
    with_words = docs.select("doc_key", "kind", "username", *[X.tokens(X.visible_text(c) if f != "user" else c).alias(f"_{f}") for f, c in FIELDS.items()])
    total, every = F.lit(0.0), F.lit(True)
    for c in clauses:
        part = F.lit(0.0)
        for f, w in words.items():
            if c.field not in (None, f):
                continue
            ok = _satisfied(w, c)
            value = F.lit(WEIGHTS[f] + (PHRASE_BONUS if c.phrase else 0.0))
            if f == "user":
                value = value + F.when(X.identity_key("username") == c.value, WHOLE_NAME_BONUS).otherwise(0.0)
            part = part + F.when(ok & allowed(f, F.col("kind"), scopes), value).otherwise(0.0)
        total, every = total + part, every & (part > 0)
    return with_words.where(every).select("doc_key", total.alias("score")).where("score > 0") if clauses else with_words.select("doc_key", F.lit(0.0).alias("score")).limit(0)


def suggest_usernames(names: DataFrame, prefix: str = "", exclude: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """key, display: author names by prefix of their key; the smallest spelling stands for all."""
    key = X.identity_key("username")
    own = names.withColumn("key", key).where((F.col("key") != "") & F.col("key").startswith(fold(prefix).strip()) & ~F.col("key").isin(*[fold(x).strip() for x in exclude] or [""]))
    return own.groupBy("key").agg(F.min(F.trim("username")).alias("display")).orderBy("key", "display").limit(max(1, min(20, limit)))
