"""The queries of the subpackage; the same form as those of the core."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import table
from . import leakage, lookalike, mixing, oracles, pii, spans, subjects, toxic

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _forum(spark, folder):
    return table(spark, folder, "posts"), table(spark, folder, "threads")


@query()
def p1_found(spark, folder):
    return pii.found(*_forum(spark, folder))


@query()
def p1_texts(spark, folder):
    """The messages of both tables with placeholders in place of personal information."""
    parts = [pii.redact(df.select("id", "message").distinct(), "message").select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), "message") for name, df in zip(("posts", "threads"), _forum(spark, folder), strict=True)]
    return parts[0].unionByName(parts[1])


@query()
def p1_rates(spark, folder):
    return pii.rates(*_forum(spark, folder))


@query()
def p2_found(spark, folder):
    return toxic.found(*_forum(spark, folder), table(spark, folder, "content_labels"))


@query()
def p2_scores(spark, folder):
    return toxic.scores(*_forum(spark, folder), table(spark, folder, "content_labels"))


@query()
def p2_passages(spark, folder):
    return toxic.passages(*_forum(spark, folder), table(spark, folder, "content_labels"))


@query()
def p2_rates(spark, folder):
    return toxic.rates(*_forum(spark, folder), table(spark, folder, "content_labels"))


@query(oracles.LOOKALIKES)
def p3_found(spark, folder):
    return lookalike.found(table(spark, folder, "posts"))


@query()
def p3_texts(spark, folder):
    posts = table(spark, folder, "posts").select("id", "message", "author").distinct()
    return lookalike.consistent(posts, ["message", "author"]).select(F.col("id").alias("post_id"), "message", "author")


@query()
def p3_authors(spark, folder):
    return lookalike.variants_report(table(spark, folder, "posts"))


def _subject_tables(spark, folder):
    return tuple(table(spark, folder, t) for t in ("threads", "thread_categories", "category_taxonomy", "category_examples"))


@query()
def p5_found(spark, folder):
    return subjects.found(*_subject_tables(spark, folder))


@query()
def p5_subjects(spark, folder):
    return subjects.subjects(*_subject_tables(spark, folder))


@query()
def p5_composition(spark, folder):
    return subjects.composition(*_subject_tables(spark, folder))


@query()
def p7_found(spark, folder):
    return leakage.found(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query()
def p7_items(spark, folder):
    return leakage.per_item(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query()
def p8_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


@query()
def p8_shares(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


@query(oracles.SHARED_PAIRS)
def p9_found(spark, folder):
    return spans.found(table(spark, folder, "documents"))


@query(oracles.STRETCHES)
def p9_stretches(spark, folder):
    return spans.stretches(table(spark, folder, "documents"))


@query(oracles.COVERAGE)
def p9_coverage(spark, folder):
    return spans.coverage(table(spark, folder, "documents"))
