"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as overlapping windows of words. A word's input is its own embedding beside
the maximum of the embeddings of its characters' runs, its beginnings and inner runs (which
may hold the blank at its end), for words never seen before. Two gated recurrent layers
read a window in both directions, attention weighs their states, and a logistic output
scores the window. A document scores as its worst window.

Learning, from labelled rows outside the held-out fold:

1. A bounded sample: up to ``sample_rows`` documents, half of each label as far as they
   go, drawn by hash against a threshold computed from the label counts.
2. Words and character runs of the sample are counted by label on the executors; the
   ``features`` that tell the labels apart most surely get embeddings, of which the first
   number starts as their log odds, less two standard errors.
3. Labels belong to documents, not to windows: the executors pick the worst windows of
   each sampled document under the model so far (one of a toxic document, two of a clean
   one), the driver trains on those by backpropagation (Adam), and both are repeated.

Scoring takes whole texts of any length, in slices that carry the overlap over. Words are
lower-cased runs of letters, digits and non-ASCII characters; a run without blanks longer
than a slice is read as several words.

Defined results: a text that is null or has no words scores 0; without labels every text
scores 0, with one kind only that kind; rows without an id teach nothing and are not held
out; several labels of one id count as their maximum; repeated rows are scored each and
count once in the sample; an empty table gives an empty result. Only the named columns are
read; labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .importance_draw import as_words
from .jaccard_join import _BYTE, _powers, mixed

SLOTS = 18


@dataclass(frozen=True)
class Net:
    """Window and stride in words, beginnings and inner runs in bytes, embeddings at most and their width, units of
    each direction and of the attention, documents sampled, rounds of picking windows, epochs of a
    round, windows of a training step, its step size, the share of words
    hidden in it, the seed, and bytes read at once."""

    window: int = 64
    stride: int = 32
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7)
    runs: tuple[int, ...] = (5,)
    features: int = 20_000
    width: int = 6
    hidden: int = 8
    attention: int = 8
    sample_rows: int = 6000
    rounds: int = 2
    epochs: int = 6
    step: int = 128
    rate: float = 0.01
    unseen: float = 0.5
    seed: int = 13
    slice: int = 1 << 20


# ---- words and their features ---------------------------------------------------------

@dataclass
class Words:
    """Words of a buffer: the piece of each, its number among the distinct ones, and for the
    distinct ones the hash of the word and the hashes of its character runs, end to end."""

    piece: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    runs: np.ndarray
    run_bounds: np.ndarray


def read_words(data: list[bytes], how: Net) -> Words:
    """The words of several pieces of text, hashed by polynomial prefix sums."""
    joined = b" ".join([b"", *data, b""])
    raw = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(raw == 32))
    begin, end = edge[0::2] + 1, edge[1::2] + 1
    starts = np.cumsum([1] + [len(d) + 1 for d in data])
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    word = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    kinds, first, kind = np.unique(word, return_index=True, return_inverse=True)
    begin_of, length = begin[first], (end - begin)[first] + 1
    hashes, owner = [], []

    def add(of: np.ndarray, at: np.ndarray, n: int, tag: int) -> None:
        hashes.append(mixed((sums[at + n] - sums[at]) * down[at] + np.uint64(tag + n)))
        owner.append(of)

    for n in how.beginnings:
        of = np.flatnonzero(length > n)
        add(of, begin_of[of], n, 2000)
    for n in how.runs:
        count = np.maximum(length - n + 1, 0)
        of = np.repeat(np.arange(len(kinds)), count)
        add(of, begin_of[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), n, 1000)
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return Words(np.searchsorted(starts, begin, side="right") - 1, kind, kinds, np.concatenate(hashes)[order],
                 np.searchsorted(of[order], np.arange(len(kinds) + 1)))


def text_pieces(texts, how: Net) -> Iterator[tuple[int, bytes]]:
    """(text's number, bytes of words) in slices; a further slice begins with the overlap of two windows."""
    carry = how.window - how.stride
    for i, text in enumerate(texts):
        data, at, carried = as_words(text), 0, b""
        while at < len(data) or at == 0:
            to = at + how.slice
            blank = data.rfind(b" ", at + 1, to) if to < len(data) else -1
            to = blank if blank > 0 else to
            part = carried + data[at:to] if blank < 0 and at else carried + b" " + data[at:to]
            yield i, part
            carried = b" ".join(part.rsplit(None, carry)[-carry:])[-how.slice // 2:] if carry else b""
            at = to


def text_buffers(texts, how: Net) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(text's numbers, pieces) of about ``how.slice`` bytes."""
    held, room = [], how.slice
    for piece in text_pieces(texts, how):
        held.append(piece)
        room -= len(piece[1])
        if room <= 0:
            yield np.array([i for i, _ in held]), [p for _, p in held]
            held, room = [], how.slice
    if held:
        yield np.array([i for i, _ in held]), [p for _, p in held]


def windows_of(words: Words, pieces: int, how: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first word, end of the piece's words) of every window; a piece's last one may be shorter."""
    bounds = np.searchsorted(words.piece, np.arange(pieces + 1))
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(-(-(n - how.window) // how.stride), 0) + 1, 0)
    piece = np.repeat(np.arange(pieces), count)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    return piece, bounds[piece] + nth * how.stride, bounds[piece + 1]


# ---- the network ------------------------------------------------------------------------

@dataclass
class Model:
    """Embeddings by feature hash (row 0: unknown) and the weights of the network."""

    how: Net
    slot_hash: np.ndarray
    slot_row: np.ndarray
    weights: dict

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        return np.where(self.slot_hash[slot] == hashes, self.slot_row[slot], 0)


def new_model(hashes: np.ndarray, odds: np.ndarray, prior: float, how: Net) -> Model:
    """A model with an embedding for each hash, most telling first; of two in one slot the first stays."""
    rng = np.random.default_rng(how.seed)
    slot_hash, slot_row = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
    slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
    slot_hash[slot[::-1]], slot_row[slot[::-1]] = hashes[::-1], np.arange(len(hashes), 0, -1)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    d, h, a = how.width, how.hidden, how.attention
    embed = normal(len(hashes) + 1, d, scale=0.05)
    embed[0] = 0
    embed[1:, 0] = np.clip(odds, -4, 4)
    weights = {"word": embed, "char": embed.copy(), "x": normal(2, 2 * d, 3 * h, scale=0.4), "b": np.zeros((2, 3 * h), np.float32),
               "h": normal(2, h, 3 * h, scale=0.3), "a": normal(2 * h, a, scale=0.3), "ab": np.zeros(a, np.float32),
               "v": normal(a, scale=0.3), "o": normal(2 * h, scale=0.3), "c": np.array(np.log(prior / (1 - prior)), np.float32)}
    return Model(how, slot_hash, slot_row, weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_inputs(model: Model, words: Words, unseen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, word rows, known character runs, the word of each) of the distinct words.

    Words marked ``unseen`` are read by their characters alone.
    """
    w, d = model.weights, model.how.width
    of_word, of_run = model.rows(words.hash), model.rows(words.runs)
    if unseen is not None:
        of_word[unseen] = 0
    known = np.flatnonzero(of_run)
    owner = np.searchsorted(words.run_bounds, known, side="right") - 1
    inputs = np.zeros((len(words.hash), 2 * d), np.float32)   # a word without a known run keeps the unknown's zeros
    inputs[:, :d] = w["word"][of_word]
    if len(known):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        inputs[owner[at], d:] = np.maximum(np.maximum.reduceat(w["char"][of_run[known]], at), 0)
    return inputs, of_word, of_run[known], owner


def states(gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, w: dict, keep: bool = False):
    """States (T, 2, B, h) of both directions; with ``keep`` also what backpropagation needs.

    ``gates`` (2, words + 1, 3h) are the projected inputs; a masked step leaves the state as it is.
    """
    b, t = ids.shape
    h = w["h"].shape[1]
    out, kept = np.empty((t, 2, b, h), np.float32), []
    state = np.zeros((2, b, h), np.float32)
    inputs = np.empty((t, 2, b, 3 * h), np.float32)
    inputs[:, 0], inputs[:, 1] = gates[0][ids.T], gates[1][ids.T[::-1]]
    real = None if mask.all() else np.stack([mask.T, mask.T[::-1]], axis=1)[..., None]
    for k in range(t):
        back = state @ w["h"]
        zr = inputs[k, ..., :2 * h] + back[..., :2 * h]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[..., :h], zr[..., h:]
        n = r * back[..., 2 * h:]
        n += inputs[k, ..., 2 * h:]
        np.tanh(n, out=n)
        new = n + z * (state - n)
        if real is not None:
            new = np.where(real[k], new, state)
        if keep:
            kept.append((state, z, r, n, back[..., 2 * h:], np.ones((2, b, 1), bool) if real is None else real[k]))
        state = new
        out[k, 0], out[t - 1 - k, 1] = state[0], state[1]
    return out, kept


def attended(out: np.ndarray, mask: np.ndarray, w: dict):
    """(logit, states (T, B, 2h), tanh layer, attention, pooled) of each window."""
    both = np.concatenate([out[:, 0], out[:, 1]], axis=2)
    hidden = np.tanh(both @ w["a"] + w["ab"])
    e = np.where(mask.T, hidden @ w["v"], -1e9)
    e = np.exp(e - e.max(axis=0)) * mask.T
    share = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = (share[..., None] * both).sum(axis=0)
    return pooled @ w["o"] + w["c"], both, hidden, share, pooled


def window_ids(kind: np.ndarray, start: np.ndarray, end: np.ndarray, none: int, how: Net) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(how.window)
    mask = at < end[:, None]
    return np.where(mask, kind[np.minimum(at, len(kind) - 1)], none), mask


def projected(model: Model, inputs: np.ndarray) -> np.ndarray:
    """Inputs of the gates of both directions, with a row of zeros at the end for masked steps."""
    w = model.weights
    return np.stack([np.vstack([inputs @ w["x"][k] + w["b"][k], np.zeros((1, w["b"].shape[1]), np.float32)]) for k in (0, 1)])


def window_logits(model: Model, words: Words, start: np.ndarray, end: np.ndarray, chunk: int = 512) -> np.ndarray:
    gates = projected(model, word_inputs(model, words)[0])
    out = np.empty(len(start), np.float32)
    order = np.argsort(end - start < model.how.window, kind="stable")      # full windows first, which need no mask
    for k in range(0, len(start), chunk):
        at = order[k:k + chunk]
        ids, mask = window_ids(words.kind, start[at], end[at], len(words.hash), model.how)
        out[at] = attended(states(gates, ids, mask, model.weights)[0], mask, model.weights)[0]
    return out


def gradients(model: Model, words: Words, start: np.ndarray, end: np.ndarray, label: np.ndarray, weight: np.ndarray,
              unseen: np.ndarray | None = None):
    """(loss, gradients by weight name) of weighted logistic loss on some windows."""
    w, how = model.weights, model.how
    d, h = how.width, how.hidden
    inputs, of_word, of_run, owner = word_inputs(model, words, unseen)
    gates = projected(model, inputs)
    ids, mask = window_ids(words.kind, start, end, len(words.hash), how)
    out, kept = states(gates, ids, mask, w, keep=True)
    logit, both, hidden, share, pooled = attended(out, mask, w)
    p = sigmoid(logit)
    loss = -(weight * np.log(np.where(label > 0, p, 1 - p) + 1e-9)).sum()
    g = {k: np.zeros_like(v) for k, v in w.items()}
    top = (weight * (p - label)).astype(np.float32)
    g["c"], g["o"] = np.array(top.sum(), np.float32), pooled.T @ top
    d_pooled = top[:, None] * w["o"]
    d_share = (both * d_pooled).sum(axis=2)
    d_e = share * (d_share - (share * d_share).sum(axis=0))
    g["v"] = np.einsum("tb,tba->a", d_e, hidden)
    d_hidden = d_e[..., None] * w["v"] * (1 - hidden ** 2)
    g["a"], g["ab"] = np.einsum("tbs,tba->sa", both, d_hidden), d_hidden.sum(axis=(0, 1))
    d_both = share[..., None] * d_pooled + d_hidden @ w["a"].T
    t = len(kept)
    d_gates = np.zeros_like(gates)
    d_state = np.zeros_like(out[0])
    for k in range(t - 1, -1, -1):
        state, z, r, n, back_n, real = kept[k]
        d_new = d_state + np.stack([d_both[k, :, :h], d_both[t - 1 - k, :, h:]])
        d_step = np.where(real, d_new, 0)
        d_n = d_step * (1 - z) * (1 - n ** 2)
        d_z = d_step * (state - n) * z * (1 - z)
        d_r = d_n * back_n * r * (1 - r)
        d_here = np.concatenate([d_z, d_r, d_n], axis=2)
        d_back = np.concatenate([d_z, d_r, d_n * r], axis=2)
        for side, column in ((0, k), (1, t - 1 - k)):
            np.add.at(d_gates[side], ids[:, column], d_here[side])
            g["h"][side] += state[side].T @ d_back[side]
        d_state = np.where(real, d_step * z, d_new) + d_back @ w["h"].transpose(0, 2, 1)
    d_inputs = np.zeros_like(inputs)
    for side in (0, 1):
        per_word = d_gates[side][:-1]
        g["x"][side], g["b"][side] = inputs.T @ per_word, per_word.sum(axis=0)
        d_inputs += per_word @ w["x"][side].T
    np.add.at(g["word"], of_word, d_inputs[:, :d])
    # a maximum passes its gradient to the run that it came from
    won = (w["char"][of_run] == inputs[owner, d:]) * d_inputs[owner, d:]
    np.add.at(g["char"], of_run, won)
    g["word"][0], g["char"][0] = 0, 0                        # the unknown stays at zero
    return loss, g


def train(model: Model, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> None:
    """Adam over the windows, given as their words; embeddings move a tenth as fast as the rest, and a share
    ``how.unseen`` of the words is read by characters alone, as new words are when scoring."""
    how, rng = model.how, np.random.default_rng(model.how.seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    steps = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), how.step):
            batch = order[at:at + how.step]
            words = read_words([texts[i] for i in batch], how)
            bounds = np.searchsorted(words.piece, np.arange(len(batch) + 1))
            share = (weight[batch] / len(batch)).astype(np.float32)
            unseen = rng.random(len(words.hash)) < how.unseen
            _, grads = gradients(model, words, bounds[:-1], bounds[1:], label[batch], share, unseen)
            steps += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = how.rate * (0.1 if k in ("word", "char") else 1)
                model.weights[k] = (model.weights[k] - rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)


# ---- sample, windows and scores -----------------------------------------------------------

def sampled(docs: DataFrame, labels: DataFrame, folds: int, how: Net) -> tuple[DataFrame, dict]:
    """(id, text, toxic) of the sample, settled, and the number of labelled documents by label."""
    id_ = F.col("doc_id").cast("long")
    fold = F.crc32(id_.cast("string").cast("binary")) % folds
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy(id_.alias("id"))
             .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    named = docs.where(F.col("doc_id").isNotNull()).select(id_.alias("id"), "text", F.xxhash64("text").alias("hash"))
    known = settled(named.select("id", "hash").distinct().join(marks, "id"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = {k: how.sample_rows // len(counts) if counts else 0 for k in counts}
    if len(counts) == 2:                                      # what one label leaves goes to the other
        few = min(counts, key=counts.get)
        each[few] = min(counts[few], how.sample_rows // 2)
        each[1 - few] = how.sample_rows - each[few]
    draw = F.pmod(F.xxhash64("id", "hash", F.lit(how.seed)), F.lit(1 << 40))
    bar = F.lit(0)
    for k, n in counts.items():
        bar = F.when(F.col("toxic") == k, F.lit(min(1 << 40, (1 << 40) * each[k] // n))).otherwise(bar)
    chosen = known.where(draw < bar)
    # some sample_rows pairs, a bound that the thresholds set
    rows = (named.join(F.broadcast(chosen), ["id", "hash"]).groupBy("id", "hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")))
    return settled(rows.select("id", "text", "toxic").repartition(8)), counts


def telling_features(sample: DataFrame, how: Net) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lower bounds of the log odds) of the words and character runs that tell the labels apart most surely."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                each = [np.concatenate([words.hash, words.runs]) for _, pieces in text_buffers([text], how) for words in [read_words(pieces, how)]]
                found[int(toxic)].append(np.unique(np.concatenate(each)))
        for toxic, sets in found.items():
            if sets:
                hashes, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"hash": hashes.astype(np.int64), "toxic": toxic, "n": n})

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    y, n = F.col("y") + 0.5, F.col("n") + 0.5
    odds = F.log(y / (yes + 1 - y)) - F.log(n / (no + 1 - n))
    sure = F.abs("odds") - 2 * F.sqrt(1 / y + 1 / n)
    rows = (sample.mapInPandas(counted, "hash long, toxic int, n long").groupBy("hash")
            .agg(F.sum(F.col("n") * F.col("toxic")).alias("y"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("n"))
            .where("y + n > 4").withColumn("odds", odds).withColumn("sure", sure).where("sure > 0")
            .orderBy(F.desc("sure"), "hash").limit(how.features).select("hash", F.signum("odds") * F.col("sure")).collect())
    return np.array([r[0] for r in rows], dtype=np.int64).astype(np.uint64), np.array([r[1] for r in rows], dtype=np.float64)


def worst_windows(sample: DataFrame, model: Model, plain: bool) -> tuple[list[bytes], np.ndarray]:
    """(words, label) of the worst windows of each sampled document: one of a toxic one, two of a clean one.

    ``plain`` ranks windows by their largest log odds, before there is a trained network.
    """
    how = model.how
    held = sample.sparkSession.sparkContext.broadcast(model)

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = held.value
        for batch in batches:
            out: list = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                best: list = []
                for _, pieces in text_buffers([text], how):
                    words = read_words(pieces, how)
                    _, start, end = windows_of(words, len(pieces), how)
                    if not len(start):
                        continue
                    if plain:
                        value = word_inputs(net, words)[0][:, [0, how.width]].max(axis=1)
                        ids, mask = window_ids(words.kind, start, end, 0, how)
                        score = np.where(mask, value[ids], -9).max(axis=1)
                    else:
                        score = window_logits(net, words, start, end)
                    plain_words = b" ".join(pieces).split()
                    top = np.argsort(-score, kind="stable")[:2 - int(toxic)]
                    best += [(float(score[k]), b" ".join(plain_words[start[k]:min(end[k], start[k] + how.window)])) for k in top]
                best.sort(key=lambda x: (-x[0], x[1]))
                out += [(words, int(toxic)) for _, words in best[:2 - int(toxic)]]
            yield pd.DataFrame(out, columns=["words", "toxic"])

    rows = sorted((r["toxic"], bytes(r["words"])) for r in sample.mapInPandas(picked, "words binary, toxic int").collect())
    return [w for _, w in rows], np.array([t for t, _ in rows], dtype=np.float32)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, how: Net = Net()) -> Model | float:
    """The trained model; the constant score where the labels are of one kind or none."""
    sample, counts = sampled(docs, labels, folds, how)
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    share = counts[1] / (counts[0] + counts[1])
    hashes, odds = telling_features(sample, how)
    model = new_model(hashes, odds, share, how)
    for turn in range(how.rounds):
        texts, label = worst_windows(sample, model, plain=turn == 0)
        if not len(label) or label.min() == label.max():
            return float(label.max()) if len(label) else 0.0
        # the sample's labels weigh as much as they do among all labelled documents
        weight = np.where(label > 0, share / label.mean(), (1 - share) / (1 - label.mean()))
        train(model, texts, label, weight)
    return model


def text_scores(model: Model, texts) -> np.ndarray:
    """The worst window's probability for each text; 0 without words."""
    how = model.how
    logit = np.full(len(texts), -np.inf)
    for of, pieces in text_buffers(texts, how):
        words = read_words(pieces, how)
        piece, start, end = windows_of(words, len(pieces), how)
        if len(start):
            np.maximum.at(logit, of[piece], window_logits(model, words, start, end))
    return np.where(np.isneginf(logit), 0.0, sigmoid(logit))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, how: Net = Net()) -> DataFrame:
    """One row per document (doc_id, text): held_out, score and predicted."""
    model = fit(docs, labels, folds, how)
    id_ = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.coalesce(id_, F.lit(0)).alias("doc_id"), id_.isNotNull().alias("known"), held.alias("held_out"), "text")
    if isinstance(model, float):
        out = rows.withColumn("score", F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), model).otherwise(0.0))
    else:
        net = docs.sparkSession.sparkContext.broadcast(model)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answer = text_scores(net.value, batch["text"].tolist())
                yield batch[["doc_id", "known", "held_out"]].assign(score=answer)

        out = rows.mapInPandas(score, "doc_id long, known boolean, held_out boolean, score double")
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "held_out", F.col("score").cast("double").alias("score"),
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
