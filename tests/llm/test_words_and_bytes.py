"""Spelling variants, fill-in-the-middle and the byte network against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.llm import convnet, fim, variants

SCHEMA = "doc_id long, text string, `_n` long, `_form` string, `_score` string, `_c` int, word string, n int"
ODD = [(1, None), (2, ""), (3, "   \n\n "), (None, "one two twoo three threee"), (5, "one two"), (5, "one two"), (7, "long " * 30_000), (8, "x" * 100_000), (9, "naïve cœur a\x00b 😀z"), (10, "a<P>b"), (11, "<S")]


def make(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, 1, "kept", "s", 2, "w", 3) for i, t in rows], SCHEMA)


# --- spelling variants


def plain_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def plain_near(words):
    """Words one edit apart, by each word's neighbourhood over the alphabet of all."""
    letters, out = {c for w in words for c in w}, {w: set() for w in words}
    for w in words:
        for k in range(len(w) + 1):
            others = {w[:k] + c + w[k:] for c in letters} | {w[:k] + c + w[k + 1 :] for c in letters if k < len(w)}
            for x in others & words.keys() - {w}:
                out[w].add(x)
                out[x].add(w)
    return out


def plain_groups(rows):
    words = plain_words(rows)
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else words[form[w]]) for w, n in words.items()}


def spelled(rng, n, letters="abcé", lengths=(4, 9)):
    stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(*lengths))) for _ in range(n)]
    return [(i, " ".join(rng.choice(stock[: rng.randrange(1, n)]).title() for _ in range(60))) for i in range(150)]


@pytest.mark.parametrize("block", [variants.BLOCK, 6])
def test_variants_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", block)  # small blocks are split to the end
    rows = spelled(random.Random(3), 500) + ODD + [(20 + i, "twoo three threee Ärger ärger Arger " * 3) for i in range(3)]
    got = variants.grouped(make(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 300
    assert any(r[4] > 5 for r in want) and any(r[2] != r[1] is not None for r in want)


def test_a_block_of_words_that_share_all_but_one_letter(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(f"stem{c}" for c in letters) + " stemma stemms") for i in range(5)]
    assert {tuple(r) for r in variants.grouped(make(spark, rows)).collect()} == plain_groups(rows)


def test_one_edit_is_no_more_and_no_less():
    rng = random.Random(8)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        b = "".join(rng.choice("ab") for _ in range(len(a) + rng.randrange(2)))
        edits = {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in "ab"} | {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in "ab"}
        assert variants.one_edit(a, b) == (b in edits - {a})


def test_no_words(spark):
    assert variants.grouped(make(spark, ODD).limit(0)).count() == 0
    assert variants.grouped(make(spark, [(1, "a b"), (2, None)])).count() == 0


# --- fill in the middle


def plain_fim(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force_and_is_put_back(spark):
    rng = random.Random(4)
    pieces = ["ab", "Z", " ", "\n", "é", "ß9", "<P", ">", "<", "S>", "PSM", "<M>", "😀", "word", ".", "  "]
    rows = ODD + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [(None, None), (600, "end<S"), (601, "<P" * 50)]
    out = fim.transformed(make(spark, rows))
    assert out.columns == ["doc_id", "text", "_score", "_c", "word", "n", "_n", "_form", "_prefix", "_middle", "_suffix", "_output"]
    got = Counter(tuple(r) for r in out.select("doc_id", "text", "_n", "_form", "_prefix", "_middle", "_suffix", "_output", fim.restored(F.col("_output"), F.col("_form"))).collect())
    assert got == Counter((i, t, *plain_fim(i, t), t or "") for i, t in rows)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(make(spark, ODD).limit(0)).count() == 0


def test_events_are_sparse():
    changes, letters, sentinel = fim.Scanner().events("word" * 1000 + "123 456 é é" * 10 + "end")
    assert len(changes) == 2 and letters and not sentinel


# --- the byte network


def plain_score(net, text):
    """The network by its definition, place by place."""
    t = text.encode("utf-8")
    tables = net.tables.astype(np.float64)
    padded = t + b"\0" * convnet.WIDTH
    places = max(min(1, len(t)), len(t) - convnet.WIDTH + 1)
    values = np.array([sum(tables[k, padded[i + k]] for k in range(convnet.WIDTH)) for i in range(places)]).reshape(places, convnet.FILTERS)
    cut = [values[i : i + 2 * convnet.SEGMENT] for i in range(0, max(1, len(t) - convnet.SEGMENT), convnet.SEGMENT)]
    seen = [np.maximum(0, c.max(axis=0) + net.bias) if len(c) else np.zeros(convnet.FILTERS) for c in cut]
    inside = np.maximum(0, np.array(seen) @ net.inner + net.inner_bias)
    return 1 / (1 + np.exp(-(np.concatenate([inside.max(axis=0), inside.mean(axis=0)]) @ net.outer + net.outer_bias[0])))


def test_scores_equal_the_definition():
    rng, net = random.Random(6), convnet.Net.fresh(9)
    texts = ["", "a", "é" * 64, "x" * 127, "x" * 128, "x" * 129, *("".join(rng.choice("abc é\n") for _ in range(rng.randrange(1, 1500))) for _ in range(12))]
    got = net.probabilities([t.encode() for t in texts])
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    texts, y = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (5, 300, 700, 130)], np.array([1, 0, 1, 0], dtype=np.float32)

    def loss(flat):
        p = convnet.Net.from_flat(flat).probabilities(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    flat = convnet.Net.fresh(3).flat()
    g = convnet.Net.from_flat(flat).gradient(texts, y)
    for i in np.argsort(-np.abs(g))[:40:4]:
        step = np.zeros_like(flat)
        step[i] = 2e-3
        assert abs((loss(flat + step) - loss(flat - step)) / 4e-3 - g[i]) < 0.03 * abs(g[i]) + 1e-3


def test_network_learns_and_scores_whole_texts(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(900):
        text, bad = prose(rng.randrange(30, 150)), i % 4 == 0
        if bad and i % 8:
            text += " $$$ ###" * 8  # far from the start
        elif bad:
            text = f"{text[:60]} " + "again " * 60
        rows.append((i, text))
        labels.append((i, int(not bad)))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = make(spark, rows + ODD)
    net = convnet.fit(docs, table.where(convnet.fold_of(F.col("doc_id")) != convnet.HELD_OUT))
    out = convnet.scored(docs, net)
    assert out.columns == ["doc_id", "text", "_n", "_form", "_c", "word", "n", "_score"]
    got = out.select("doc_id", "_score").collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r._score <= 1 for r in got)
    held = [(r._score, labels[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id > 11 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    again = convnet.fit(docs, table.where(convnet.fold_of(F.col("doc_id")) != convnet.HELD_OUT))
    assert np.allclose(again.flat(), net.flat(), atol=1e-6)


def test_nothing_to_learn(spark):
    docs = make(spark, ODD)
    none = spark.createDataFrame([(1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    scores = convnet.scored(docs, convnet.fit(docs, none))
    assert scores.count() == len(ODD) and scores.where("_score is null").count() == 0
    assert convnet.scored(docs.limit(0), convnet.fit(docs.limit(0), none)).count() == 0
