"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit of it is a binary classifier over hashed
character trigrams, which says on which side of the bit a text lies. A text takes the
language whose codeword has the smallest loss over all bits, each bit weighted by how
often it was right for that language on the training texts. A small gap to the second
language flags the answer as ambiguous.

Training reads a bounded sample of the labelled texts (``sample_rows`` in all, spread
evenly over the languages, the same at each run); prediction reads every whole text, in
slices, so a very long one takes no more memory than a short one.

Defined results: a null text, or one without a letter, is ``und`` with score 0; texts
without a label teach nothing; without any label every text is ``und``; with a single
label that language is the answer with score 1. Repeated rows are predicted each, an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

UND = "und"


@dataclass(frozen=True)
class Code:
    """Settings: hashed trigram buckets, training sample in all and per language, slice of a text,
    gap that counts as ambiguous."""

    buckets: int = 1 << 14
    sample_rows: int = 6000
    #: up to 1000, Spark limits the ranking window inside each task, before the shuffle
    sample_each: int = 1000
    slice_chars: int = 1 << 20
    ambiguous_gap: float = 0.2


@dataclass(frozen=True)
class Model:
    langs: list[str]
    words: np.ndarray      # languages x bits, +1 or -1
    weights: np.ndarray    # buckets x bits: log odds of a trigram for the bit
    trust: np.ndarray      # languages x bits: how far each bit is believed, rows sum to 1
    scale: np.ndarray      # bits: spread of the margins on the training texts
    code: Code


def codewords(k: int) -> np.ndarray:
    """Codewords of k languages as +1/-1 rows.

    Up to seven languages take every way to part them in two; more take random balanced
    bits, ten per doubling of the number of languages, from a fixed seed.
    """
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:
        columns = [[1] + [1 if (n >> i) & 1 else -1 for i in range(k - 1)] for n in range(2 ** (k - 1) - 1)]
        return np.array(columns, dtype=float).T
    rng = np.random.default_rng(7)
    half = np.array([1.0] * (k // 2) + [-1.0] * (k - k // 2))
    return np.stack([rng.permutation(half) for _ in range(10 * math.ceil(math.log2(k)))], axis=1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str, code: Code) -> Iterator[np.ndarray]:
    """Hashed buckets of all trigrams with a letter in the middle, one array per slice of the text.

    Anything but letters counts as one kind of gap; slices overlap by two characters, so
    each trigram comes once.
    """
    step = code.slice_chars
    for at in range(0, len(text), step):
        part = (text[at - 1:at + step + 1] if at else " " + text[:step + 1]) + ("" if at + step < len(text) else " ")
        points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(_letters()[points], points, 0).astype(np.uint64)
        middle = np.flatnonzero(points[1:-1]) + 1
        if len(middle):
            mixed = (points[middle - 1] * np.uint64(0x9E3779B97F4A7C15) + points[middle] * np.uint64(0xC2B2AE3D27D4EB4F)
                     + points[middle + 1] * np.uint64(0x165667B19E3779F9))
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            yield (mixed >> np.uint64(40)).astype(np.int64) % code.buckets


def margins(text: str, weights: np.ndarray, code: Code) -> np.ndarray | None:
    """Mean log odds per trigram for each bit; None without letters."""
    total, n = np.zeros(weights.shape[1]), 0
    for grams in trigrams(text, code):
        total += np.bincount(grams, minlength=code.buckets) @ weights if len(grams) > 4 * code.buckets \
            else weights[grams].sum(axis=0, dtype=np.float64)
        n += len(grams)
    return total / n if n else None


def losses(model: Model, margin: np.ndarray) -> np.ndarray:
    """Loss of each language: logistic loss of its bits, weighted by the trust in them."""
    agree = model.words * (margin / model.scale)
    return (model.trust * np.logaddexp(0.0, -4.0 * agree)).sum(axis=1)


def decode(model: Model, text: str | None) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of one text."""
    if not text or not model.langs:
        return UND, 0.0, False
    margin = margins(text, model.weights, model.code)
    if margin is None:
        return UND, 0.0, False
    if len(model.langs) == 1:
        return model.langs[0], 1.0, False
    loss = losses(model, margin)
    best = int(np.argmin(loss))
    shares = np.exp(-2.0 * (loss - loss[best]))
    gap = np.partition(loss, 1)[1] - loss[best]
    return model.langs[best], float(1.0 / shares.sum()), bool(gap < model.code.ambiguous_gap)


def fit(labelled: DataFrame, code: Code = Code()) -> Model:
    """Model from rows (id, text, lang) with a non-null lang.

    The sample's trigram counts are summed per language on the executors; one vector of
    ``buckets`` counts per language and task, then one row of hit rates per language,
    reach the driver.
    """
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return Model([], np.ones((0, 0)), np.zeros((code.buckets, 0)), np.ones((0, 0)), np.ones(0), code)
    each = max(1, min(code.sample_each, code.sample_rows // len(langs)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (labelled.select("id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)
              .select(F.col("id").alias("chosen_id")))
    # at most sample_rows ids (or one per language): a proven bound
    sample = settled(labelled.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id"), "left_semi").select("lang", "text"))

    def counted(batches):
        sums: dict = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                for grams in trigrams(text or "", code):
                    sums.setdefault(lang, np.zeros(code.buckets))
                    sums[lang] += np.bincount(grams, minlength=code.buckets) / math.sqrt(len(grams))
        if sums:
            yield pd.DataFrame({"lang": list(sums), "counts": [v.tobytes() for v in sums.values()]})

    counts = {lang: np.zeros(code.buckets) for lang in langs}
    for row in sample.mapInPandas(counted, "lang string, counts binary").toLocalIterator():
        counts[row["lang"]] += np.frombuffer(row["counts"])
    rates = np.stack([(counts[x] + 0.05) / (counts[x].sum() + 0.05 * code.buckets) for x in langs])
    words = codewords(len(langs))
    weights = np.zeros((code.buckets, words.shape[1]), dtype=np.float32)
    for bit in range(words.shape[1]):
        yes = words[:, bit] > 0
        weights[:, bit] = np.log(rates[yes].mean(axis=0)) - np.log(rates[~yes].mean(axis=0))

    def hit(batches):
        sums: dict = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                margin = margins(text or "", weights, code)
                if margin is not None:
                    right = (margin * words[langs.index(lang)] > 0).astype(float)
                    old = sums.get(lang, (0, np.zeros(len(right)), np.zeros(len(right))))
                    sums[lang] = old[0] + 1, old[1] + right, old[2] + np.abs(margin)
        if sums:
            yield pd.DataFrame([(x, n, h.tobytes(), s.tobytes()) for x, (n, h, s) in sums.items()], columns=["lang", "n", "hits", "size"])

    n, hits, size = np.ones(len(langs)), np.full(words.shape, 0.5), np.full(words.shape[1], 1e-6)
    for row in sample.mapInPandas(hit, "lang string, n long, hits binary, size binary").toLocalIterator():
        i = langs.index(row["lang"])
        n[i] += row["n"]
        hits[i] += np.frombuffer(row["hits"])
        size += np.frombuffer(row["size"])
    right = hits / n[:, None]
    trust = np.maximum(right, 1e-3)
    return Model(langs, words, weights, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9), size / n.sum(), code)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (id, held_out, text) with lang_pred, score and ambiguous in place of the text."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [decode(model, text) for text in batch["text"]]
            out = batch.drop(columns="text")
            out["lang_pred"], out["score"], out["ambiguous"] = zip(*answers) if answers else ([], [], [])
            yield out

    return docs.mapInPandas(rows, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, folds: int = 5, code: Code = Code()) -> DataFrame:
    """Language of every document; learns from the labelled documents outside the held-out fold.

    A document is held out where crc32 of its id as text is divisible by ``folds``; one
    without an id is predicted and teaches nothing.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    learn = (docs.where((fold != 0) & F.col("lang").isNotNull())
             .select(F.col("doc_id").alias("id"), "text", "lang"))
    model = fit(learn, code)
    return predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"),
                     model)
