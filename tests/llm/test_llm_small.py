"""Operators of the subpackage on small tables: brute force, round trips, held-out accuracy, edge cases."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from threadloom.llm import bilstm, glyphs, leakage, lookalike, mixing, pii, segments, spans, subjects, toxic

WORDS = "amber brook cedar delta ember fjord grove haven inlet jetty knoll larch mirth north ochre pearl quill ridge slate thorn".split()


def story(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


# ---- look-alikes -----------------------------------------------------------------------------------------------------
def test_rewriter_forms():
    r = lookalike.plain_rewriter()
    for odd, plain in (("ｔｈａｎｋｓ", "thanks"), ("thаnks", "thanks"), ("tha​nks", "thanks"), ("ﬁne", "fine"), ("café", "café"), ("cafе́", "café"), ("a b　c", "a b c"), ("⁠﻿", ""), ("x²", "x²"), ("O0", "O0"), ("Résumé", "Résumé")):
        assert r(odd) == plain, odd
    assert r(None) is None and r("") == ""
    assert len({lookalike.Rewriter(r.table)(x) for x in ("ệ", "ệ", unicodedata.normalize("NFD", "ệ"))}) == 1
    form = {"A", "Á", "a", "0", "O", ".", ","}
    assert len({r(x) for x in form}) == len(form)


def test_classes_are_closed_over_composition():
    for a, b in (("Zo\u0451", "Zo\u00eb"), ("\u0457", "\u00ef"), ("\u03cc", "\u00f3"), ("\u043e\u0301", "\u00f3"), ("\u1ec7", "\u0435\u0323\u0302")):
        for usual in (a, b):
            rw = lookalike.Rewriter(lookalike.rewrites({c: 9 for c in usual} | {"e": 5, "\u0435": 7}))
            assert rw(a) == rw(b), (a, b, usual)
    rw = lookalike.plain_rewriter()
    assert len({rw(x) for x in ("e", "\u00eb", "\u00e9", "\u00f6", "\u00ef")}) == 5


def test_lookalike_pairs_match_brute_force(spark):
    rng = random.Random(1)
    base = ["thanks", "ok then", "a longer café text", ""]
    odd = {"a": "а", "o": "ο", "e": "е", " ": " ", "": ""}
    rows = []
    for i in range(1, 90):
        t = rng.choice(base)
        rows.append((i, "".join(odd.get(c, c) if rng.random() < 0.1 else c for c in t) + ("​" if rng.random() < 0.1 else ""), rng.choice(["Ann", "Аnn", "Bob", None])))
    rows += [rows[0], rows[5], (100, None, "Ann"), (None, "thanks", "Zoe")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, message string, author string, form string")
    got = {tuple(r) for r in lookalike.found(df).collect()}
    rw = lookalike.plain_rewriter()
    texts = {i: m for i, m, _ in rows if i and m is not None}
    want = {("message", a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] != texts[b] and rw(texts[a]) == rw(texts[b])}
    first = {}
    for i, _, a in rows:
        if i and a:
            first[a] = min(first.get(a, i), i)
    want |= {("author", *sorted((first[a], first[b]))) for a, b in itertools.combinations(first, 2) if rw(a) == rw(b)}
    assert got == want and len(want) > 50
    assert lookalike.found(df.limit(0)).count() == 0
    same = {r.message for r in lookalike.consistent(df.where("message IS NOT NULL"), ["message"]).collect()}
    assert len(same) == len(base)


# ---- shared spans ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("q", [2, 3, 5, 7, 13])
def test_difference_cover(q):
    v, d = spans.difference_cover(q)
    assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


def brute_spans(texts, n):
    out = set()
    for (i, a), (j, b) in itertools.combinations(sorted(texts.items()), 2):
        own = {a[k : k + n] for k in range(len(a) - n + 1)}
        if any(b[k : k + n] in own for k in range(len(b) - n + 1)):
            out.add((i, j))
    return out


def test_spans_match_brute_force(spark):
    rng = random.Random(2)
    parts = [story(rng, 14) for _ in range(8)]
    texts = {}
    for i in range(40):
        p = rng.choice(parts)
        cut = rng.randint(0, len(p) - 40)
        texts[i] = story(rng, rng.randint(0, 20)) + p[cut : cut + rng.randint(38, 80)] + story(rng, rng.randint(0, 20))
    texts |= {50: texts[3], 51: texts[3], 52: "é" * 90, 53: "é" * 60 + "x", 54: "", 55: "short"}
    df = spark.createDataFrame([(i, t, "e") for i, t in texts.items()] + [(60, None, "e"), (50, texts[3], "e"), (None, texts[3], "e")], "doc_id bigint, text string, hash string")
    n = 40
    want = brute_spans(texts, n)
    got = [tuple(r) for r in spans.found(df, n).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    cover = {r.doc_id: (r.shared_chars, r.n_chars) for r in spans.coverage(df, n).collect()}
    for i, t in texts.items():
        marks = np.zeros(len(t), bool)
        others = {u[k : k + n] for j, u in texts.items() if j != i for k in range(len(u) - n + 1)}
        for k in range(len(t) - n + 1):
            if t[k : k + n] in others:
                marks[k : k + n] = True
        if t != texts[3]:
            assert cover[i] == (marks.sum(), len(t)), i
    assert cover[60] == (0, 0) and spans.found(df.limit(0), n).count() == 0


# ---- leakage ---------------------------------------------------------------------------------------------------------
def test_leakage(spark):
    rng = random.Random(3)
    items = {i: story(rng, 24) for i in range(1, 9)}
    docs, want = [], set()
    for d in range(60):
        i = rng.randint(1, 8)
        w = items[i].split()
        kind = d % 6
        if kind == 0:
            body = " ".join(w).upper()
        elif kind == 1:
            body = "<b>" + ", ".join(w[:12]) + "</b> (sorry, the phone)\n" + ". ".join(w[12:])
        elif kind == 2:
            w[5], w[17] = "changed", "other"
            body = " ".join(w)
        elif kind == 3:
            body = " ".join(w[4:20]).replace("a", "а")
        elif kind == 4:
            body = " ".join(w[:8])
        else:
            body = ""
        docs.append((d, story(rng, 30) + "\n" + body + "\n" + story(rng, 30)))
        if kind < 4:
            want.add((d, i))
    df = spark.createDataFrame([*docs, (99, None), docs[0]], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, "s", p) for i, p in items.items()] + [(20, "s", None), (21, "s", "two words")], "item_id bigint, suite string, passage string")
    assert {tuple(r) for r in leakage.found(df, it).collect()} == want
    assert {tuple(r)[:2] for r in leakage.leaks(df, it, most_words=0).where("in_order >= 0.5").collect()} == want
    w = items[1].split()
    swapped = spark.createDataFrame([(1, " ".join(w[12:] + w[:12]))], "doc_id bigint, text string")
    r = leakage.leaks(swapped, it).first()
    assert r.coverage == 1.0 and r.in_order == 0.5
    assert {r.item_id: r.n_docs for r in leakage.per_item(df.limit(0), it).collect()} == dict.fromkeys([*items, 20, 21], 0)


def test_leakage_of_copies_near_each_other(spark):
    w = [f"w{i}" for i in range(1, 41)]
    fill = [f"f{i}" for i in range(300)]
    quoted = [*w[:10], "well", *w[10:20], *fill[:15], *w[4:16]]
    turned = [*w[:20], *fill[:200], *w[22:40], *w[:18]]
    df = spark.createDataFrame([(1, " ".join(quoted)), (2, " ".join(turned)), (3, " ".join([*w[:9], "well", *w[10:20], *fill[:15], *w[4:16]]))], "doc_id bigint, text string")
    it = spark.createDataFrame([(5, "s", " ".join(w))], "item_id bigint, suite string, passage string")
    assert {tuple(r) for r in leakage.found(df, it).collect()} == {(1, 5), (2, 5)}
    got = {r.doc_id: (r.in_order, r.coverage) for r in leakage.leaks(df, it).collect()}
    assert got[1] == (0.5, 0.5) and got[2] == (0.5, 0.9)


# ---- mixing ----------------------------------------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, story(rng, rng.randint(5, 60)), rng.choice(["big", "Big ", "big", "mid", "small"] if i % 9 else ["small"])) for i in range(900)]
    docs = spark.createDataFrame([*rows, rows[0], (9999, None, "big"), (9998, "", "mid"), (None, "x", "mid")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.3, 5), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    keep, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 40
    try:
        chosen, report = mixing.mix(docs, targets)
        c, r = chosen.toPandas(), report.toPandas().set_index("source")
    finally:
        mixing.BUCKET_ROWS = keep
    assert c.doc_id.is_unique and (c.repeats >= 1).all()
    used = (c.n_tokens * c.repeats).groupby(c.source).sum()
    longest = c.n_tokens.max()
    for s, cap in (("big", 1), ("mid", 2), ("small", 5)):
        assert used[s] == r.used_tokens[s] and 0 <= r.budget_tokens[s] - used[s] < longest
        assert c[c.source == s].repeats.max() <= cap and abs(r.reached_share[s] - 1 / 3) < 0.02
        own = c[c.source == s]
        assert own.repeats.max() - own.repeats.min() <= 1
    assert r.used_tokens["none"] == 0
    again = mixing.mix(docs, targets)[0].toPandas()
    assert set(map(tuple, again[["doc_id", "repeats"]].values)) == set(map(tuple, c[["doc_id", "repeats"]].values))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
    spelt = spark.createDataFrame([("big", 0.1, 1), (" BIG", 0.2, 1), ("mid", 0.3, 2), ("mid", 0.3, 2), ("small", 0.3, 5), ("none", 0.1, 9), (None, 0.5, 1)], targets.schema)
    same = mixing.mix(docs, spelt)[0].toPandas()
    assert set(map(tuple, same[["doc_id", "repeats"]].values)) == set(map(tuple, c[["doc_id", "repeats"]].values))
    assert mixing.budgets({"a": 10, "b": 100}, [("a", 0.5, 2), ("b", 0.5, 1)], 400) == {"a": 20, "b": 100}


# ---- personal information --------------------------------------------------------------------------------------------
def test_gradient_and_crf():
    m = bilstm.Model(6, 5)
    rng = np.random.default_rng(0)
    x = rng.integers(1, 97, (3, 7)).astype(np.int16)
    x[0, 5:] = 0
    y = rng.integers(0, len(bilstm.TAGS), (3, 7))
    _, g = m.loss_and_grad(x, y)
    for name in m.NAMES:
        p = getattr(m, name)
        i = (int(x[1, 2]), 3) if name == "E" else tuple(rng.integers(0, s) for s in p.shape)
        old, e = p[i], 1e-2
        p[i] = old + e
        a = m.loss_and_grad(x, y)[0]
        p[i] = old - e
        b = m.loss_and_grad(x, y)[0]
        p[i] = old
        assert abs((a - b) / (2 * e) - g[name][i]) < 2e-3, name
    em = rng.normal(size=(5, len(bilstm.TAGS))).astype(np.float32)
    m.A = rng.normal(size=m.A.shape).astype(np.float32)
    path = m.viterbi([em, em[:1], em[:0]])
    score = lambda t: m.start[t[0]] + m.end[t[-1]] + sum(em[i, k] for i, k in enumerate(t)) + sum(m.A[a, b] for a, b in zip(t, t[1:]))
    best = max(itertools.product(range(len(bilstm.TAGS)), repeat=5), key=score)
    assert tuple(path[0]) == best and len(path[1]) == 1 and len(path[2]) == 0


def test_windows_tile_texts():
    for n in (1, 160, 161, 500, 1237):
        cuts = bilstm.windows(n, 160, 20)
        assert [c[2] for c in cuts[1:]] == [c[3] for c in cuts[:-1]] and cuts[0][2] == 0 and cuts[-1][3] == n
        assert all(b <= ob < oe <= e and e - b <= 160 for b, e, ob, oe in cuts)


def test_pii(spark):
    texts = [
        "Contact Naomi Tarnwell, 07700 900123, or write to naomi.tarnwell[at]mail[dot]example.", "I had to quote passport X12345678 twice.", "Moved to 12 Pellworth Road, Quenby in the meantime.",
        "Serial 66-0055-18, build 20250914, if that helps.", "Rain in Hollin Cross, sun in Sant Oriel, the usual.", "", None, "ring 020 7946 0123 and ask for the yard. " + "Nothing much to report, it held up fine. " * 40 + "Call 07700 900456 after six.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")], "id bigint, message string, pii_type string")
    got = {(r.record_id, r.pii_type, r.nth) for r in pii.find(df, "id", "message").collect()}
    assert got == {(0, "name", 1), (0, "phone", 1), (0, "email", 1), (1, "id_number", 1), (2, "address", 1), (7, "phone", 1), (7, "phone", 2)}
    out = {r.id: r.message for r in pii.redact(df.where("id IS NOT NULL"), "message").collect()}
    assert out[0] == "Contact [NAME], [PHONE], or write to [EMAIL]." and out[3] == texts[3] and out[5] == "" and out[6] is None
    assert out[7] == texts[7].replace("020 7946 0123", "[PHONE]").replace("07700 900456", "[PHONE]")
    assert pii.found(df.limit(0), df.limit(0)).count() == 0


def test_items_with_names_hosts_and_streets_never_trained_on():
    cases = {
        "Please email jane.doe@initech.com about it.": [("jane.doe@initech.com", "email")],
        "Contact bob_smith99@fastmail.com or sales@umbrella.org": [("bob_smith99@fastmail.com", "email"), ("sales@umbrella.org", "email")],
        "info@globex.org is the address": [("info@globex.org", "email")],
        "I met Wei Zhang and Emma Watson in London.": [("Wei Zhang", "name"), ("Emma Watson", "name")],
        "The director was Peter Jackson.": [("Peter Jackson", "name")],
        "Ahmed Hassan sent the file.": [("Ahmed Hassan", "name")],
        "I live at 14 Abbey Road, London.": [("14 Abbey Road, London", "address")],
    }
    found = pii.tagger(str(pii.WEIGHTS)).items(list(cases))
    assert {t: [(t[a:b], k) for a, b, k in x] for t, x in zip(cases, found)} == cases


def test_items_in_ordinary_sentences():
    """Some of the hosts and the surname Baker occur in training."""
    cases = {
        "Please email jane.doe@corpmail.com about it.": [("jane.doe@corpmail.com", "email")],
        "Contact bob_smith99@gmail.com or sales@acme.org": [("bob_smith99@gmail.com", "email"), ("sales@acme.org", "email")],
        "info@acme.org is the address": [("info@acme.org", "email")],
        "My SSN is 123-45-6789.": [("123-45-6789", "id_number")],
        "My passport number is 533380006.": [("533380006", "id_number")],
        "Call me at (415) 555-2671 or +44 20 7946 0958.": [("(415) 555-2671", "phone"), ("+44 20 7946 0958", "phone")],
        "I live at 221B Baker Street, London.": [("221B Baker Street, London", "address")],
        "Order 123-4567890-1234567 shipped; version 3.14.159 is out.": [],
        "Meet me at the Red Lion in York at 18:30.": [],
    }
    found = pii.tagger(str(pii.WEIGHTS)).items(list(cases))
    assert {t: [(t[a:b], k) for a, b, k in x] for t, x in zip(cases, found)} == cases


def test_texts_without_items_need_no_decoding():
    rng = np.random.default_rng(2)
    model = pii.tagger(str(pii.WEIGHTS)).model
    ems = [rng.normal(0, 2, (int(rng.integers(1, 40)), len(bilstm.TAGS))).astype(np.float32) + np.float32([rng.integers(0, 9)] + [0] * 10) for _ in range(300)]
    plain = [i for i, e in enumerate(ems) if model._empty(e)]
    out: list = [None] * len(ems)
    model._viterbi(ems, plain, out)
    assert len(plain) > 20 and not any(out[i].any() for i in plain)


# ---- toxic passages --------------------------------------------------------------------------------------------------
def test_maximal_segments_match_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(0, 12)).astype(float).tolist()
        got = segments.maximal_segments(s)
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0.0)
        assert max((x[2] for x in got), default=0.0) == max(best, 0.0)
        assert all(abs(sum(s[a:b]) - v) < 1e-9 and v > 0 for a, b, v in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_tokens_undo_disguises():
    r = lookalike.plain_rewriter()
    assert segments.tokens("What a $n1v3ll1ng d u n c e, baaaastard! <b>x</b> @someone 12", r) == ["what", "a", "snivelling", "dunce", "bastard", "x", "@handle", "0"]
    assert segments.tokens(None, r) == []


def test_toxic_scores(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 14))) for _ in range(400)]
    bad = {"abusive": "you are a rotten fool and everybody hates you", "hateful": "those valley folk should all be thrown out", "sexual": "come and touch me all over tonight"}
    rows, labels, truth = [], [], {}
    for i, g in enumerate(good, 1):
        kind = list(bad)[i % 3] if i % 8 == 0 else None
        rows.append((i, (g + ". " + bad[kind] + ". " + g) if kind else g, "/b/x/thread/1"))
        if kind:
            truth[i] = kind
        if i % 2 == 0:
            labels.append(("r", i, kind or "none"))
    rows += [(900, None, None), (901, "", "/b/y/1"), rows[7]]
    posts = spark.createDataFrame(rows, "id bigint, message string, source_url string")
    threads = spark.createDataFrame([(1, "a title", "/b/x/1"), (None, "t", "")], "id bigint, title string, source_url string")
    lab = spark.createDataFrame([*labels, ("r", 5000, "abusive"), ("r", 2, "unknown")], "kind string, item_id bigint, label string")
    got = {r.record_id: r.harm for r in toxic.found(posts, threads, lab).collect() if r.table_name == "posts"}
    assert all(got.get(i) == k for i, k in truth.items()) and len(got) <= 1.2 * len(truth)
    rates = {(r.table_name, r.board): (r.n_records, r.n_abusive + r.n_hateful + r.n_sexual) for r in toxic.rates(posts, threads, lab).collect()}
    assert rates["posts", "x"] == (400, sum(1 for i in got if i <= 400)) and rates["posts", "y"] == (1, 0)
    assert toxic.found(posts, threads, lab.limit(0)).count() == 0 and toxic.found(posts.limit(0), threads.limit(0), lab).count() == 0
    parts = toxic.passages(posts, threads, lab).where("table_name = 'posts'").collect()
    assert {(r.record_id, r.harm) for r in parts if r.surprise > 15} >= {(i, k) for i, k in truth.items()}
    assert all("fool" in r.passage for r in parts if r.harm == "abusive" and r.surprise > 15)


def test_toxic_fit_outlives_wrong_labels():
    rng = random.Random(4)
    bad = {"abusive": "you are a rotten fool and everybody hates you", "hateful": "those valley folk should all be thrown out", "sexual": "come and touch me all over tonight"}
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12)))
    sample, corpus = [], {}
    for i in range(4000):
        kind = list(bad)[i % 3] if i % 5 == 0 else None
        text = f"{say()} {bad[kind]} {say()}" if kind else say()
        label = rng.choice([*bad, "none"]) if i % 17 == 0 else kind or "none"
        sample.append(segments.Sample(label, text.split(), i % toxic.FOLDS))
        for w in text.split():
            corpus[w] = corpus.get(w, 0) + 1
    judge = toxic.fit_sample(sample, corpus, sum(corpus.values()))
    for kind, passage in bad.items():
        s, (begin, end) = judge(words := f"{say()} {passage} {say()}".split())
        assert toxic.KINDS[s.index(max(s))] == kind and max(s) >= toxic.THRESHOLD and len(set(passage.split()) & set(words[begin:end])) >= 4
    assert sum(max(judge(say().split())[0]) >= toxic.THRESHOLD for _ in range(300)) <= 6


def test_joint_surprise_counts_several_passages():
    law = (1.0, 0.0)
    assert segments.joint_surprise([], 10, law) == 0.0
    one = segments.joint_surprise([9.0], 10, law)
    assert abs(one - segments.surprise(9.0, 10, law)) < 1e-9 and segments.joint_surprise([9.0, 9.0], 10, law) > one + 3
    assert segments.joint_surprise([9.0, 1.0], 10, law) == one


# ---- subjects --------------------------------------------------------------------------------------------------------
def test_subjects(spark, monkeypatch):
    rng = random.Random(9)
    vocab = {f"{'ab'[n % 2]}/{g}": [f"{g}{i}" for i in "uvwxyz"] for n, g in enumerate("alpha beta gamma delta omega sigma kappa theta".split())}
    say = lambda c: f"I like the {rng.choice(vocab[c])} more than the {rng.choice(vocab[c])}."
    chat = ["Morning all.", "Nothing to report.", "Who is up?"]
    leaves = list(vocab)
    rows, labels, truth = [], [], {}
    for i in range(1, 481):
        c, d = leaves[i % 8], leaves[(i // 8) % 7 if (i // 8) % 7 != i % 8 else 7]
        body = {0: [say(c) for _ in range(4)], 1: [say(c), say(c), say(d), say(d)], 2: [say(c), say(c), say(c), f"PS: somebody mentioned a {vocab[d][0]}."], 3: chat}[i // 8 % 4]
        truth[i] = {0: {c}, 1: {c, d}, 2: {c}, 3: set()}[i // 8 % 4]
        rows.append((i, "Look at this", " ".join([*body, rng.choice(chat)])))
        if i // 8 % 4 != 3:
            labels.append((i, c.upper() if i % 50 == 0 else c if rng.random() < 0.8 else rng.choice(leaves), "automatic"))
    rows += [(500, None, None), (501, "", ""), rows[0]]
    th = spark.createDataFrame(rows, "id bigint, title string, message string")
    lab = spark.createDataFrame(labels, "thread_id bigint, category_id string, source string")
    tax = spark.createDataFrame([("a", None), ("b", None), ("unsorted", None), *[(c, c[0]) for c in leaves]], "category_id string, parent_id string")
    ex = spark.createDataFrame([(c, "x", say(c)) for c in leaves for _ in range(40)], "category_id string, title string, message string")
    got = {}
    for r in subjects.found(th, lab, tax, ex).collect():
        got.setdefault(r.thread_id, set()).add(r.category_id)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.95 * len(truth) and 500 not in got and 501 not in got
    # the leaves decide: with nothing known of them, no text has the subjects it has
    with monkeypatch.context() as m:
        m.setattr(subjects, "mixtures", lambda centres, terms: np.full((len(centres), len(leaves)), 1 / len(leaves)))
        blind = {(r.thread_id, r.category_id) for r in subjects.found(th, lab, tax, ex).collect()}
    assert len(blind & {(i, c) for i, cs in got.items() for c in cs}) < 0.2 * sum(map(len, got.values()))
    assert subjects.found(th.limit(0), lab, tax, ex).count() == 0 and subjects.found(th, lab.limit(0), tax.limit(0), ex).count() == 0


def test_rare_terms_count_whatever_the_number_of_frequent_ones(spark):
    letters = [a + b + c + d for a, b, c, d in itertools.product("abcdefghij", repeat=4)][:9000]
    common = " ".join(letters)
    rows = [(i, common, "", "ab"[i % 2]) for i in range(14)] + [(i, "rareword", "", "c") for i in range(20, 26)]
    texts = spark.createDataFrame([r[:3] for r in rows], "thread_id bigint, title string, message string")
    lab = spark.createDataFrame([(r[0], r[3], "manual") for r in rows], "thread_id bigint, category_id string, source string")
    ex = spark.createDataFrame([], "category_id string, title string, message string")
    assert list(subjects.term_table(texts, lab, ex, ["a", "b", "c"])["term"]) == ["rareword"]


def test_tables_are_small_and_plain():
    assert all(len(a) == len(b) for a, b in glyphs.LETTERS) and sum(len(a) for a, _ in glyphs.LETTERS) < 200
