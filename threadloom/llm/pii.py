"""Personal information inside free text (problem 1).

Items are found by a character-level bidirectional LSTM with CRF transitions (``bilstm``), trained by ``pii_train``; the weights
lie beside this module. Texts are read whole, in overlapping windows whose emissions are joined before one CRF decoding of the
text. A formal check follows that drops items without the parts their type must have (an e-mail address has an at sign, a
phone number seven digits, a name two words and so on).

Null and empty texts hold no items and stay as they are. Repeated rows count once. A record that comes with different texts has
the items of each of them, numbered within its text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import PAD, TAGS, Encoder, Model, spans, windows

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW, MARGIN, BATCH, CHUNK_CHARS = 240, 20, 384, 250_000
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Digits in words.
NUMBER_WORDS = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|hundred)\b", re.I)


class Tagger:
    """The trained model with its reading of characters; one for each Python worker."""

    def __init__(self, path: str) -> None:
        self.model, self.encode = Model.load(path), Encoder()

    def paths(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        cuts = [(i, *w) for i, x in enumerate(ids) if len(x) for w in windows(len(x), WINDOW, MARGIN)]
        cuts.sort(key=lambda c: c[2] - c[1])
        ems = [np.empty((len(x), len(TAGS)), np.float32) for x in ids]
        for s in range(0, len(cuts), BATCH):
            part = cuts[s : s + BATCH]
            x = np.full((len(part), max(c[2] - c[1] for c in part)), PAD, np.int16)
            for r, (i, b, e, _, _) in enumerate(part):
                x[r, : e - b] = ids[i][b:e]
            out = self.model.emissions(x)
            for r, (i, b, _, own_b, own_e) in enumerate(part):
                ems[i][own_b:own_e] = out[own_b - b : own_e - b, r]
        return self.model.viterbi(ems)

    def items(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The items (begin, end, type) of each text, in its own code points."""
        out: list[list[tuple[int, int, str]]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHUNK_CHARS):
                size += len(texts[end])
                end += 1
            read = [self.encode(t) for t in texts[at:end]]
            for text, (_, place), path in zip(texts[at:end], read, self.paths([r[0] for r in read]), strict=True):
                found = [(int(place[a]), int(place[b - 1]) + 1, kind) for a, b, kind in spans(path)]
                out.append([x for x in found if formal(text[x[0] : x[1]], x[2])])
            at = end
        return out


def formal(item: str, kind: str) -> bool:
    """Whether an item has the parts that its type must have."""
    digits = sum(c.isdigit() for c in item)
    if kind == "email":
        return len(item) > 5 and item[0] not in "@＠" and bool(re.search(r"[@＠]|&#64;|\bat\b|\[at\]|\(at\)|ａｔ", item, re.I))
    if kind == "phone":
        return digits >= 7 or len(NUMBER_WORDS.findall(item)) >= 5
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits >= 1 and sum(c.isalpha() for c in item) >= 4
    return digits == 0 and len(re.findall(r"[^\W\d_]{2,}", item)) >= 2


@functools.lru_cache(maxsize=2)
def tagger(path: str) -> Tagger:
    return Tagger(path)


def _distinct_items(texts: pd.Series, path: str) -> dict[str, list[tuple[int, int, str]]]:
    """The items of each distinct text of a batch that has any."""
    own = sorted({t for t in texts if t}, key=len)
    return {t: x for t, x in zip(own, tagger(path).items(own), strict=True) if x}


def find(df: DataFrame, key: str, column: str, weights: str = str(WEIGHTS)) -> DataFrame:
    """record_id, pii_type, nth, begin, n_chars of every item in ``column``; nth numbers those of a type in a text from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = _distinct_items(b["text"], weights)
            rows = []
            for key_, text in zip(b["record_id"], b["text"], strict=True):
                seen: Counter[str] = Counter()
                for begin, end, kind in items.get(text, ()):
                    seen[kind] += 1
                    rows.append((key_, kind, seen[kind], begin, end - begin))
            yield pd.DataFrame(rows, columns=["record_id", "pii_type", "nth", "begin", "n_chars"])

    given = df.select(F.col(key).alias("record_id"), F.col(column).alias("text")).where(F.col(key).isNotNull() & (F.length(column) > 0))
    return given.mapInPandas(run, "record_id bigint, pii_type string, nth bigint, begin bigint, n_chars bigint").distinct()


def redact(df: DataFrame, column: str, weights: str = str(WEIGHTS)) -> DataFrame:
    """``df`` with every item in ``column`` replaced by a placeholder of its type and everything else unchanged."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        items = _distinct_items(texts, weights)

        def one(text: str | None) -> str | None:
            out, at = [], 0
            for begin, end, kind in items.get(text, ()):
                out += [text[at:begin], PLACEHOLDER[kind]]
                at = end
            return "".join(out) + text[at:] if out else text

        return texts.map(one)

    return df.withColumn(column, replaced(F.col(column)))


def found(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """table_name, record_id, pii_type, nth; ids as in TESTDATA."""
    parts = [find(df, "id", "message").select(F.lit(name).alias("table_name"), "record_id", "pii_type", "nth") for name, df in (("posts", posts), ("threads", threads))]
    return parts[0].unionByName(parts[1]).distinct()


def rates(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """table_name, pii_type, n_items, n_records."""
    return found(posts, threads).groupBy("table_name", "pii_type").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("record_id").alias("n_records"))
