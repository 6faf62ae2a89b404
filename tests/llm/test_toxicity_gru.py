"""The network against its definition step by step, numeric gradients, held-out labels, and odd rows."""

import math
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import toxicity_gru as T

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
HOW = T.Net(window=6, stride=3, hidden=3, width=2, attention=2, epochs=4, sample_rows=200)


def model(texts, how=HOW):
    words = T.read_words([T.as_words(t) for t in texts], how)
    hashes = np.unique(np.concatenate([words.hash, words.runs]))[::2]
    return T.new_model(hashes, np.linspace(-2, 3, len(hashes)), 0.2, how)


def restated(net, text):
    """Worst window of one text, one word, one step and one unit at a time."""
    w, how = net.weights, net.how
    words = [x.encode() for x in WORD.findall((text or "").translate(LOWER))]
    if not words:
        return 0.0

    def embedded(word):
        one = T.read_words([word], how)
        runs = [w["char"][r] for r in net.rows(one.runs) if r]
        return np.concatenate([w["word"][net.rows(one.hash)[0]], np.max([np.zeros(how.width), *runs], axis=0)])

    def read(rows, side):
        h, out = np.zeros(how.hidden), []
        for x in rows:
            a, b = x @ w["x"][side] + w["b"][side], h @ w["h"][side]
            k = how.hidden
            z, r = 1 / (1 + np.exp(-(a[:k] + b[:k]))), 1 / (1 + np.exp(-(a[k:2 * k] + b[k:2 * k])))
            h = (1 - z) * np.tanh(a[2 * k:] + r * b[2 * k:]) + z * h
            out.append(h)
        return out

    best = -math.inf
    starts = [0]
    while starts[-1] + how.window < len(words):
        starts.append(starts[-1] + how.stride)
    for s in starts:
        rows = [embedded(x) for x in words[s:s + how.window]]
        both = [np.concatenate(p) for p in zip(read(rows, 0), read(rows[::-1], 1)[::-1])]
        e = np.exp([np.tanh(x @ w["a"] + w["ab"]) @ w["v"] for x in both])
        best = max(best, float(sum(a * x for a, x in zip(e / e.sum(), both)) @ w["o"] + w["c"]))
    return 1 / (1 + math.exp(-best))


def test_scores_equal_the_definition():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "Abcdefgh", "éèê", "漢字漢字", "x9", "don't"]) for _ in range(n)) for n in (1, 2, 5, 6, 7, 9, 10, 40)]
    texts += [None, "", " .,! ", "zzz " * 30]
    net = model([t for t in texts if t])
    assert T.text_scores(net, texts) == pytest.approx([restated(net, t) for t in texts], abs=1e-5)


def test_slices_leave_no_words_out():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3000)) + " marker " + " ".join(f"w{rng.randrange(50)}" for _ in range(7))
    small = replace(HOW, slice=97)
    pieces = [p.split() for _, p in T.text_pieces([text], small)]
    whole = text.encode().split()
    at = len(pieces[0])
    assert whole[:at] == pieces[0]
    for p in pieces[1:]:
        carried = HOW.window - HOW.stride
        assert p[:carried] == whole[at - carried:at]
        assert p[carried:] == whole[at:at + len(p) - carried]
        at += len(p) - carried
    assert at == len(whole)
    assert sum(len(p) for _, p in T.text_pieces(["x" * 1000], small)) >= 1000


def test_gradients_equal_differences():
    texts = [b"ab cdefgh ij klmnop", b"cdefgh", b"ij ab ab cdefgh klmnopq ab"]
    net = model([t.decode() for t in texts])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    words = T.read_words(texts, HOW)
    bounds = np.searchsorted(words.piece, np.arange(4))
    label, weight = np.array([1.0, 0, 1]), np.array([0.3, 0.5, 1])
    _, got = T.gradients(net, words, bounds[:-1], bounds[1:], label, weight)
    rng = np.random.default_rng(1)
    for name, value in net.weights.items():
        flat = value.reshape(-1)
        for i in rng.choice(len(flat), min(len(flat), 12), replace=False):
            if name in ("word", "char") and i < HOW.width:
                continue
            old, losses = flat[i], []
            for step in (1e-2, -1e-2):
                flat[i] = old + step
                losses.append(T.gradients(net, words, bounds[:-1], bounds[1:], label, weight)[0])
            flat[i] = old
            assert got[name].reshape(-1)[i] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=5e-3), name


def corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = [f"{rng.choice(['ba', 'do', 'ki', 'lu'])}{rng.choice(['na', 'ro', 'ti'])}{rng.randrange(60)}" for _ in range(rng.choice([20, 90, 300]))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Scoundrel", "vermin!", f"grukx{rng.randrange(10**6)}"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    odd = [(None, "no id scoundrel"), (900, None), (901, ""), (902, " ., "), (1, rows[1][1]), (903, "quiet " * 60_000 + "vermin")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, toxic int")
    docs = docs.withColumns({c: F.lit(c) for c in ("label", "id", "hash", "score", "known", "lang")})
    return docs, spark.createDataFrame(labels + [(3, 0, None), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_held_out_documents(frames):
    docs, labels, truth = frames
    rows = T.scored(docs, labels, how=T.Net(sample_rows=400, epochs=8)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].score for i in (900, 901, 902)] == [0.0] * 3 and by_id[903].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert not by_id[None].held_out


def test_missing_labels(frames):
    docs, labels, _ = frames
    assert {r.score for r in T.scored(docs, labels.limit(0)).collect()} == {0.0}
    one = {r.doc_id: r.score for r in T.scored(docs, labels.where("toxic = 1")).collect()}
    assert one[1] == 1.0 and one[900] == one[901] == one[902] == 0.0
    assert T.scored(docs.limit(0), labels).collect() == []
