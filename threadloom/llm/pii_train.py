"""Trains the tagger of personal information: ``python -m threadloom.llm.pii_train TABLES_DIR MINUTES [WORKERS]``.

Half of the labelled texts are invented, with open vocabularies (``pii_forms``), around sentences of forum texts. The others are forum texts of
the public test tables, marked by the patterns below, half of them with their names, numbers, streets and letter case replaced at
random. So the tagger learns shapes and surroundings more than words. The names, hosts and
streets of the test of items never trained on are in neither; other tests share some hosts with the invented texts.
Only the weights are kept (``pii_weights.npz``); the engine never uses these patterns. Gradients are averaged over worker processes.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

import numpy as np

from .bilstm import TYPES, VOCAB, Encoder, Model, spans, windows
from .pii_forms import Maker

WEIGHTS = Path(__file__).with_name("pii_weights.npz")

# Names, titles and streets that occur in the labelled texts.
GIVEN = "Naomi Marisol Gareth Dmitri Mei Yusuf Kwame Callum Rafael Stefan Lukas Declan Hamish Sunita Helena Fiona Rosalind Tobias Bjorn Anneke Oskar Beatriz Emeric Edmund Chloe Zoe Ingrid Priya Amina Leila".split()
FAMILY = "Ashgillan Pellwright McVarrow Carrowden Okonduru Petrovane Ostrander-Voss Quennerby Wexholm Tarnwell Moretanza Vashtani d'Avelle Lindqvarn Brickmere Szavary Rundgarth Holzerling Mirrelees Fennimoor Halvorst Thackerwell Nakadori Brunadal".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Doctor Frau Herr Madame".split()
TOWNS = "Ashgill|Brenndorf|Bruckfeld|Castelo|Dunmarrow|Hollin Cross|Kirrimond|Larkmoor|Lede|Marrowby|Norvane|Oxley Sound|Pellhaven|Quenby|Sant Oriel|Tarnwick|Thrupham|Velloby"

_g = "(?:" + "|".join(GIVEN) + ")"
_f = "(?:" + "|".join(map(re.escape, FAMILY)) + ")"
_t = "(?:" + "|".join(TITLES) + r")\.?"
_street = r"(?:(?:(?:rue|avenue|chemin|boulevard|place) (?:[a-z]+ ){0,2}[A-Z][\w'-]+)|Am [A-Z]\w+|(?:Alte |Neue )?[A-Z]\w*(?:strasse|stra\x01e|weg|steg|gasse|allee|platz)|(?:[A-Z][\w']+ ){1,2}(?:Road|Street|Lane|Avenue|Way|Rise|Hill|Close|Row|Court|Quay|Place|Drive|Terrace|Gardens|Square|Mews|Crescent|Grove|Walk|Yard|Park|Green|View|Parade))"
_digits = "(?:one|two|three|four|five|six|seven|eight|nine|zero|oh)"

PATTERNS = {
    "email": r"[\w.+-]+ ?(?:@|\[at\]|\(at\)|&#64;| at ) ?(?:[\w-]+ ?(?:\.|\[dot\]|\(dot\)| dot ) ?)+(?:example|invalid|test)\b",
    "phone": r"(?<![\w-])(?:\+44 \(0\)7700 ?900 ?\d{3}|(?:\+44|0044) 7700 ?900 ?\d{3}|07700[ /-]{0,3}900[ -]?\d{3}|\(?020\)?[ -]7946[ -]?0\d{3}|\+49 \(0\)30 23125 ?\d{3}|\+1[ .-]\d{3}[ .-]555[ .-]0\d{3}|\(\d{3}\) 555-0\d{3}|\d{3}[.-]555[.-]0\d{3}|oh seven seven double oh nine hundred(?: " + _digits + r"){3})(?!\d)",
    "id_number": r"(?:(?:passport(?: number is| no\.?)? |Personalausweis |driving licence |ID card no\. |social security no\. |SSN |NI number )?(?P<item>[XZ]\d{8}|QQ ?\d\d ?\d\d ?\d\d ?[A-D]|ZZ-\d{6}-\d|L\d{7}X\d|[A-Z]{5}\d{6}[A-Z]\d[A-Z]{2}|(?:000|666)[ -]\d\d[ -]\d{4})|passport number is (?P<other>\d{3} \d{6}))(?: \(national insurance\))?(?!\w)",
    "name": rf"(?<![\w@./-])(?:{_f}, {_g}(?: [A-Z]\.)?|(?:{_t} )?{_g} (?:[A-Z]\.? )?{_f}|{_t} {_f})(?![\w-])",
}
_tail = rf"(?:[,\n]? ?\n?(?:\d{{5}} )?(?:{TOWNS})(?:[ ,\n]+[A-Z]{{2}}\d{{1,2}} \d[A-Z]{{2}})?|[ ,\n]+[A-Z]{{2}}\d{{1,2}} \d[A-Z]{{2}})?"
ADDRESS = rf"(?:Flat \d+, )?(?:(?:no\. ?)?\d+[A-C]?,? {_street}|{_street} \d+[A-C]?(?!\d)){_tail}"
FLAGS = {"name": re.I, "email": re.I}
_RE = {k: re.compile(v, FLAGS.get(k, 0)) for k, v in PATTERNS.items()} | {"address": re.compile(ADDRESS)}
_ADDRESS_ANY = re.compile(r"(?:(?<![\w.,:-])(?:flat \d+, )?(?:no\. ?)?\d+[a-c]?,? (?:pellworth road|millrace avenue|heron lane|tallow street|orchard rise|cinder hill|bittern way|lower quay|foundry court|gasworks row|saint orm's close|larch drive|(?:rue|chemin|avenue) (?:[a-z]+ ){1,2}[a-z]+)|(?<![\w.,:-])(?:torfsteg|[a-z]+(?:strasse|gasse|weg)) \d+[a-c]?(?!\d))" + _tail, re.I)
ORDER = ("email", "address", "id_number", "phone", "name")


def folded(ids: np.ndarray) -> str:
    """The text as the model reads it, one character an id."""
    return "".join("\n" if i == 96 else chr(i + 31) if i < 96 else "\x01" if i == 97 else "\x02" for i in ids.tolist())


def label(text: str) -> list[tuple[int, int, str]]:
    """Marked spans of a folded text; the first pattern in ORDER wins where two overlap."""
    taken: list[tuple[int, int, str]] = []
    for kind in ORDER:
        for rx in (_RE[kind], *([_ADDRESS_ANY] if kind == "address" else [])):
            for m in rx.finditer(text):
                a, b = next((m.span(g) for g in ("item", "other") if m.groupdict().get(g)), m.span())
                if kind == "address" and text[max(0, a - 13) : a].endswith("ring road at "):
                    continue
                if all(b <= x or a >= y for x, y, _ in taken):
                    taken.append((a, b, kind))
    return sorted(taken)


def _word(rng: np.random.Generator) -> str:
    syll = "ba ber bru cal dar del dun eck fal fen gar gor hal han is jor kel kin lan lar mar mel mo nar nel ol or pet quin ran ros sal sten tar tho um val ver wes wyn yar zel".split()
    return "".join(rng.choice(syll) for _ in range(rng.integers(2, 4))).capitalize()


def varied(text: str, marked: list[tuple[int, int, str]], rng: np.random.Generator, strength: float) -> tuple[str, list]:
    """The text with the insides of its items replaced now and then, the marks moved along."""
    out, marks, at = [], [], 0
    for a, b, kind in marked:
        item = text[a:b]
        out.append(text[at:a])
        if rng.random() < strength:
            if kind == "name":
                item = re.sub(r"[A-Za-z'-]{3,}", lambda m: m[0] if m[0].lower() in ("prof", "frau", "mrs", "mr", "ms", "dr") or rng.random() < 0.5 else (_word(rng).lower() if m[0].islower() else _word(rng).upper() if m[0].isupper() else _word(rng)), item)
            elif kind in ("phone", "id_number"):
                item = re.sub(r"\d", lambda m: str(rng.integers(10)) if rng.random() < 0.4 else m[0], item)
            elif kind == "address":
                item = re.sub(r"\b(?:Pellworth|Millrace|Heron|Tallow|Orchard|Cinder|Bittern|Foundry|Gasworks|Lower)\b", lambda m: _word(rng) if rng.random() < 0.6 else m[0], item, flags=re.I)
            elif kind == "email":
                item = re.sub(r"^[\w-]+", lambda m: _word(rng).lower() if rng.random() < 0.5 else m[0], item)
        start = sum(map(len, out))
        out.append(item)
        marks.append((start, start + len(item), kind))
        at = b
    out.append(text[at:])
    whole = "".join(out)
    r = rng.random()
    if r < 0.03:
        whole = whole.upper()
    elif r < 0.06:
        whole = whole.lower()
    return whole, marks


def tags(length: int, marked: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, kind in marked:
        k = TYPES.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def to_ids(text: str) -> np.ndarray:
    return np.array([96 if c == "\n" else 97 if c == "\x01" else 98 if c == "\x02" else ord(c) - 31 for c in text], np.int16)


def texts_of(folder: str) -> list[str]:
    import pyarrow.dataset as ds

    got: set[str] = set()
    for table in ("posts", "threads"):
        got |= {m for m in ds.dataset(f"{folder}/{table}.parquet").to_table(columns=["message"]).column(0).to_pylist() if m}
    return sorted(got)


def made(maker: Maker, around: str, encode: Encoder) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """An invented text as the model reads it, with its marks."""
    text, marks = maker.text(around)
    ids, at = encode(text)
    return ids, [(int(np.searchsorted(at, a)), int(np.searchsorted(at, b)), k) for a, b, k in marks]


class Batches:
    """An endless supply of training windows; one in each worker process."""

    def __init__(self, folder: str, seed: int, size: int, batch: int) -> None:
        self.rng, self.encode, self.size, self.batch = np.random.default_rng(seed), Encoder(), size, batch
        self.maker = Maker(self.rng)
        marked = [(t, label(t)) for t in (folded(self.encode(t)[0]) for t in texts_of(folder)) if t]
        self.rich, self.poor = [x for x in marked if x[1]], [x for x in marked if not x[1]]
        self.model = Model(2)

    def example(self) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
        rng = self.rng
        if rng.random() < 0.5:
            around = self.poor[rng.integers(len(self.poor))][0].replace("\x01", "").replace("\x02", "")
            return made(self.maker, around, self.encode)
        pool = self.rich if rng.random() < 0.65 else self.poor
        text, marks = pool[rng.integers(len(pool))]
        if rng.random() < 0.5:
            text, marks = varied(text, marks, rng, 0.5)
        return to_ids(text), marks

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        rng, size = self.rng, self.size
        x, y = np.zeros((self.batch, size), np.int16), np.zeros((self.batch, size), np.int64)
        for i in range(self.batch):
            ids, marks = self.example()
            tag = tags(len(ids), marks)
            cuts = windows(len(ids), size, 20)
            if len(cuts) > 1 and marks and rng.random() < 0.8:
                a, b, _ = marks[rng.integers(len(marks))]
                begin = max(0, min(len(ids) - size, a - int(rng.integers(0, max(1, size - min(b - a, size - 1))))))
                end = begin + size
            else:
                begin, end = cuts[rng.integers(len(cuts))][:2]
            x[i, : end - begin] = ids[begin:end]
            y[i, : end - begin] = tag[begin:end]
        longest = int((x != 0).sum(1).max())
        return x[:, :longest], y[:, :longest]


_own: Batches | None = None


def _start(folder: str, size: int, batch: int, seed: int) -> None:
    import os

    global _own
    _own = Batches(folder, seed + os.getpid(), size, batch)


def _gradient(weights: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    for n, v in weights.items():
        setattr(_own.model, n, v)
    return _own.model.loss_and_grad(*_own.next())


def train(folder: str, minutes: float, workers: int = 1, hidden: int = 40, size: int = 160, batch: int = 64, seed: int = 3, start: str | None = None, peak: float = 4e-3) -> Model:
    import multiprocessing as mp

    model = Model.load(start) if start else Model(hidden)
    moments = {n: [np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))] for n in model.NAMES}
    with mp.Pool(workers, _start, (folder, size, batch, seed)) as pool:
        began, step, mean = time.time(), 0, 0.0
        while (spent := time.time() - began) < minutes * 60:
            done = spent / (minutes * 60)
            rate = peak * min(1, (step + 1) / 100) * (0.5 * (1 + np.cos(np.pi * done)) + 0.005)
            weights = {n: getattr(model, n) for n in model.NAMES}
            got = pool.map(_gradient, [weights] * workers, chunksize=1)
            loss, grad = float(np.mean([x for x, _ in got])), {n: np.mean([g[n] for _, g in got], axis=0) for n in model.NAMES}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            for n, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-6))
                m, v = moments[n]
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                p = getattr(model, n)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
            mean = loss if step == 1 else 0.98 * mean + 0.02 * loss
            if step % 100 == 0:
                print(f"{step} steps, {spent:.0f} s, loss {mean:.4f}", flush=True)
    model.save(str(WEIGHTS))
    return model


if __name__ == "__main__":
    train(sys.argv[1], float(sys.argv[2]), int(sys.argv[3]) if len(sys.argv) > 3 else 1, start=sys.argv[4] if len(sys.argv) > 4 else None, peak=2e-3 if len(sys.argv) > 4 else 4e-3)
    assert VOCAB == 99 and spans
