"""Text functions as native columns: normalisation, tokens, visible text, snippets, hashes."""

from __future__ import annotations

import functools
import sys
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# The words flagged as stop words in the lexicon.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with".split()


@functools.lru_cache(maxsize=2)
def fold_map(form: str = "NFKD") -> tuple[str, str]:
    """Two strings for ``translate``: every character whose decomposition is one base character, and that character.

    Combining marks U+0300-U+036F have no partner and are deleted. Hangul syllables and one-to-many forms are left alone."""
    src, dst, drop = [], [], [chr(c) for c in range(0x300, 0x370)]
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x300 <= code <= 0x36F:
            continue
        ch = chr(code)
        plain = unicodedata.normalize(form, ch)
        if form == "NFKD":
            plain = "".join(c for c in plain if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != ch:
            src.append(ch)
            dst.append(plain)
    return "".join(src) + ("".join(drop) if form == "NFKD" else ""), "".join(dst)


def normalise(c: Column | str) -> Column:
    """Search form: accents and width folded, lower case. Null stays null."""
    src, dst = fold_map()
    return F.lower(F.translate(F.col(c) if isinstance(c, str) else c, src, dst))


def identity_key(c: Column | str) -> Column:
    """The search form without blanks at the ends; the key under which authors count as one."""
    return F.trim(normalise(c))


def strict_identity(c: Column | str) -> Column:
    """The form used for block lists: width folded, accents kept, trimmed, lower case."""
    src, dst = fold_map("NFKC")
    return F.trim(F.lower(F.translate(F.col(c) if isinstance(c, str) else c, src, dst)))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalise(c), F.lit(TOKEN), F.lit(0))


def visible_text(c: Column | str) -> Column:
    """Text without tags and with the five common entities decoded."""
    out = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


@functools.lru_cache(maxsize=1)
def named_entities() -> dict[str, str]:
    """The named entities of HTML 4 and ``apos``; taken from the standard library."""
    return {n: chr(c) for n, c in sorted(name2codepoint.items())} | {"apos": "'"}


def _code_point(n: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(known, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def unescaped(c: Column | str) -> Column:
    """Text with its named, decimal and hexadecimal entities decoded once, from left to right; what is none stays. Null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    names = F.create_map(*[F.lit(x) for pair in named_entities().items() for x in pair])

    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 9)).cast("bigint")
        plain = F.when(number.isNotNull(), _code_point(number)).when(body != "", F.try_element_at(names, body))
        return F.when(plain.isNotNull(), F.concat(plain, F.substr(p, F.length(body) + 2))).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(col, "&", -1)
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))
    return F.when(col.contains("&"), decoded).otherwise(col)


def plain_text(c: Column | str) -> Column:
    """Text as a reader sees it: tags dropped, all entities decoded, blanks of every kind (the hard one too) as one, none at the ends."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "<[^>]*>", " ")), r"[\s\u00a0]+", " "))


def clean_text(c: Column | str, limit: int) -> Column:
    """Plain text of at most ``limit`` characters, for the prompt of a model."""
    return F.substring(plain_text(c), 1, limit)


def release_title(version: Column | str, day: Column | str) -> Column:
    """``version+yyyymmdd`` of a release's version and the date of its watermark; null where that is no valid title."""
    title = F.concat(F.col(version) if isinstance(version, str) else version, F.lit("+"), F.date_format(day, "yyyyMMdd"))
    return F.when(valid_release_title(title), title)


def collapsed(c: Column | str) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))


def snippet(text: Column, needle: str, before: int = 80, size: int = 240) -> Column:
    """A window of the text around the first occurrence of ``needle``, with ellipses where it is cut."""
    flat = collapsed(text)
    at = F.instr(normalise(flat), needle)
    start = F.greatest(F.lit(1), at - F.lit(before))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.substr(flat, start, F.lit(size)), F.when(F.length(flat) >= start + size, F.lit("…")).otherwise(F.lit("")))


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over code points."""
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by a zero character."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def parse_time(c: Column | str) -> Column:
    """ISO-8601 text of several shapes as a zone-less UTC timestamp; null where it is none."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(F.when(col.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|\+00:?00)?$"), col), r"(Z|\+00:?00)$", ""), "T", " "))


def links(c: Column | str) -> Column:
    """The http(s) links of a text, without punctuation at their ends."""
    found = F.regexp_extract_all(visible_text(c), F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?\])}]+$", ""))


def link_parts(c: Column | str) -> Column:
    """Links of a text as an array of (text, href): anchors with their own text, then bare links; other schemes than http(s) are none."""
    col = F.col(c) if isinstance(c, str) else c
    anchor = r"""(?is)<a\s[^>]*?href\s*=\s*["'](https?://[^"'\s>]+)["'][^>]*>(.*?)</a>"""
    hrefs, texts = (F.regexp_extract_all(col, F.lit(anchor), F.lit(i)) for i in (1, 2))
    named = F.zip_with(texts, hrefs, lambda t, h: F.struct(plain_text(t).alias("text"), unescaped(h).alias("href")))
    bare = F.transform(links(F.regexp_replace(col, anchor, " ")), lambda h: F.struct(h.alias("text"), h.alias("href")))
    return F.concat(named, bare)


def valid_release_title(c: Column | str) -> Column:
    """``a.b.c+yyyymmdd`` or ``a.b.c.d+yyyymmdd`` with a real date from 2000 to 2100."""
    col = F.col(c) if isinstance(c, str) else c
    day = F.regexp_extract(col, r"^\d+\.\d+\.\d+(?:\.\d+)?\+(\d{8})$", 1)
    parsed = F.try_to_timestamp(F.when(F.length(day) == 8, day), F.lit("yyyyMMdd"))
    return F.coalesce(F.year(parsed).between(2000, 2100), F.lit(False))


def register(spark: SparkSession) -> None:
    """Install the functions for use in SQL text."""
    src, dst = (s.replace("\\", "\\\\").replace("'", "\\'") for s in fold_map())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION search_form(x STRING) RETURNS STRING RETURN lower(translate(x, '{src}', '{dst}'))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION search_tokens(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(search_form(x), '[\\p{L}\\p{N}]+', 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bm25(w DOUBLE, n BIGINT, df BIGINT, tf BIGINT) RETURNS DOUBLE RETURN w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)")
