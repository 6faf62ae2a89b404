"""Target-distribution importance resampling over hashed word runs.

Documents are drawn so that their word runs look like those of a target corpus. Features
are all runs of one to three consecutive words; a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. A bucket's gain is the scaled log ratio of its smoothed shares
in the target and in the documents, a document weighs the sum of its features' gains, and
Gumbel noise from a hash of its id turns "the highest scores" into a draw without
replacement.

1. Dictionary: the words found most often in all documents and targets, each bounded by
   its delimiters, in an Aho-Corasick automaton. A word's payload is its CRC, the CRC of
   the word with the blank before it, and its length.
2. Scan: text is brought to one delimiter byte; the automaton emits the payload of each
   dictionary word. Words outside the dictionary (whose size bounds a task's memory and
   the broadcast) get the same payload from their own bytes, so results do not depend on
   the dictionary.
3. Composition: CRC is linear, so the CRC of adjacent words follows from their payloads
   (the left CRC moved by the right length, plus the right CRC) without touching the bytes
   again.
4. Counting sums ``buckets`` counts per task; scoring scans again with the gains at hand.
5. The drawn rows are numbered by range partitions, so no task holds the whole order.

A word is a run of characters other than ASCII controls, blanks, punctuation and capitals,
after A-Z are lower-cased.

Defined results: a null or empty text, or one without words, has no features and weighs 0;
a null doc_id hashes as an empty one and comes last among ties; repeated rows count, and
are scored and drawn, each; equal scores of equal ids are told apart by their features,
equal rows by nothing. Empty tables give an empty result (an empty target makes every gain
that of unseen features). Long texts are scanned in slices that carry two words over. Only
the named columns are read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settled

#: bytes of words, lower-cased; every other byte becomes a blank
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                  for b in range(256))


@dataclass(frozen=True)
class Draw:
    """Longest run, buckets, per cent drawn, least words of a drawn document, the seed of the noise,
    words in the dictionary at most, bytes scanned at once."""

    run: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42
    dictionary: int = 65_536
    slice: int = 1 << 20


# ---- CRC-32 of a concatenation ------------------------------------------------------

def _byte_shift() -> np.ndarray:
    """4 x 256 table: the CRC register after one more zero byte, by each byte of the register."""
    one = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ 0xEDB88320, one >> 1)  # fixed value: the reflected CRC-32 polynomial
    table = np.zeros((4, 256), np.uint32)
    table[0] = one
    for k in range(1, 4):
        table[k] = np.arange(256, dtype=np.uint32) << (8 * (k - 1))
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24])


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The table of one linear step after another."""
    return np.stack([_apply(second, row) for row in first])


NEAR = 64


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Steps over 0..NEAR-1 zero bytes, flattened for one lookup, and over NEAR, 2 NEAR, 4 NEAR, ... bytes."""
    one = _byte_shift()
    steps = [np.stack([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)])]
    for _ in range(NEAR):
        steps.append(_then(steps[-1], one))
    far = [steps[NEAR]]
    for _ in range(40):
        far.append(_then(far[-1], far[-1]))
    return np.concatenate([s.ravel() for s in steps[:NEAR]]), far


_NEAR_TABLE, _FAR_TABLES = _shift_tables()


def crc_joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of left || right from both CRCs (uint32) and the length of the right part."""
    at = (length % NEAR).astype(np.int32) << 10
    moved = (_NEAR_TABLE[at + (left & 255)] ^ _NEAR_TABLE[at + 256 + (left >> 8 & 255)]
             ^ _NEAR_TABLE[at + 512 + (left >> 16 & 255)] ^ _NEAR_TABLE[at + 768 + (left >> 24)])
    rest = length // NEAR
    far = np.flatnonzero(rest)
    bit = 0
    while len(far):
        on = far[(rest[far] >> bit & 1).astype(bool)]
        moved[on] = _apply(_FAR_TABLES[bit], moved[on])
        bit += 1
        far = far[(rest[far] >> bit) > 0]
    return moved ^ right


# ---- dictionary and scan --------------------------------------------------------------

def as_words(text: str | None) -> bytes:
    """The text's UTF-8 bytes with every delimiter a blank and A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


def pieces(texts, how: Draw) -> Iterator[tuple[int, bytes, int]]:
    """(text's number, words as bytes, words carried over) in slices that end between words.

    A further slice begins with the last words of the one before, one fewer than the longest
    run, which complete the runs across the cut and count nothing by themselves.
    """
    for i, text in enumerate(texts):
        data, at, carried = as_words(text), 0, b""
        while at < len(data) or at == 0:
            to = at + how.slice
            if to < len(data):
                blank = data.find(b" ", to)
                to = len(data) if blank < 0 else blank
            part = carried + b" " + data[at:to]
            yield i, part, len(carried.split())
            carried = b" ".join(part.rsplit(None, how.run - 1)[1 - how.run:]) if how.run > 1 else b""
            at = max(to, at + 1)


def buffers(texts, how: Draw) -> Iterator[list[tuple[int, bytes, int]]]:
    """The pieces of several texts in lists of about ``how.slice`` bytes."""
    held, room = [], how.slice
    for piece in pieces(texts, how):
        held.append(piece)
        room -= len(piece[1])
        if room <= 0:
            yield held
            held, room = [], how.slice
    if held:
        yield held


class Scanner:
    """The automaton of a dictionary, and the buckets of all word runs of a buffer."""

    def __init__(self, words: list[bytes], how: Draw):
        import ahocorasick
        self.how, self.automaton = how, None
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.crc_after_blank = np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32)
        if words:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for payload, word in enumerate(words):
                self.automaton.add_word(f" {word.decode('latin-1')} ", payload)
            self.automaton.make_automaton()

    def payloads(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, CRC with the blank before) of each word data[begin:end]; ``data`` starts and ends with a blank."""
        crc, after_blank = np.zeros(len(begin), np.uint32), np.zeros(len(begin), np.uint32)
        missing = np.ones(len(begin), dtype=bool)
        if self.automaton is not None:
            hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
            at = np.searchsorted(end, hits[:, 0])  # a hit ends at the blank after its word
            crc[at], after_blank[at], missing[at] = self.crc[hits[:, 1]], self.crc_after_blank[hits[:, 1]], False
        for i in np.flatnonzero(missing).tolist():
            word = data[begin[i] - 1:end[i]]
            crc[i], after_blank[i] = zlib.crc32(word[1:]), zlib.crc32(word)
        return crc, after_blank

    def buckets(self, buffer: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece of each feature, its bucket, new words of each piece) for the pieces of a buffer."""
        data = b" ".join([b"", *[p for _, p, _ in buffer], b""])
        raw = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(raw == 32))
        begin, end = edge[0::2] + 1, edge[1::2] + 1
        length = end - begin
        starts = np.cumsum([1] + [len(p) + 1 for _, p, _ in buffer])
        piece = np.searchsorted(starts, begin, side="right") - 1
        first_word = np.searchsorted(begin, starts[:-1])
        nth = np.arange(len(begin)) - first_word[piece]
        carried = np.array([c for _, _, c in buffer], dtype=np.int64)[piece]
        crc, after_blank = self.payloads(data, begin, end)
        new = nth >= carried
        words = np.bincount(piece[new], minlength=len(buffer))
        found, of, run = [crc[new]], [piece[new]], crc
        for k in range(1, self.how.run):
            # runs[i] is the CRC of the k words before word i + k, joined to that word
            run = crc_joined(run[:-1], after_blank[k:], length[k:] + 1) if len(run) else run
            whole = new[k:] & (piece[k:] == piece[:len(piece[k:])])
            found.append(run[whole])
            of.append(piece[k:][whole])
        return np.concatenate(of), np.concatenate(found) % np.uint32(self.how.buckets), words


def frequent_words(texts: DataFrame, how: Draw) -> list[bytes]:
    """The most frequent words of all texts: at most ``how.dictionary``, of at most 64 bytes each.

    Every task counts all its words, forgets rare ones only when it holds over sixteen
    times the dictionary, and hands on at most ``how.dictionary``. A histogram of the counts
    by steps of a sixteenth of a doubling says from which count on the words fit.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for _, part, _ in pieces(batch["text"], how):
                counts.update(part.split())
                if len(counts) > 16 * how.dictionary:
                    counts = Counter(dict(counts.most_common(4 * how.dictionary)))
        top = [(w, n) for w, n in counts.most_common(how.dictionary) if len(w) <= 64]
        if top:
            yield pd.DataFrame(top, columns=["word", "n"])

    words = settled(texts.select("text").mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
                    .withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    least, room = None, how.dictionary
    for step, n in sorted(words.groupBy("step").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = step
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in words.where(F.col("step") >= least).select("word").collect())


_SCANNERS: dict = {}


def _scanner(words, how: Draw) -> Scanner:
    """One automaton per worker and broadcast dictionary."""
    if _SCANNERS.get("of") is not words.value:
        _SCANNERS.update(of=words.value, scanner=Scanner(words.value, how))
    return _SCANNERS["scanner"]


def bucket_counts(texts: DataFrame, words, how: Draw) -> np.ndarray:
    """Features of all texts by bucket; each task hands on one row per bucket it met."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for buffer in buffers(batch["text"], how):
                total += np.bincount(_scanner(words, how).buckets(buffer)[1], minlength=how.buckets)
        met = np.flatnonzero(total)
        if len(met):
            yield pd.DataFrame({"bucket": met, "n": total[met]})

    out = np.zeros(how.buckets, np.int64)
    for row in texts.select("text").mapInPandas(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    k, whole, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (whole + k) / ((float(s) + 1) * (wanted + k))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, words, how: Draw) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) of each document."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for buffer in buffers(batch["text"], how):
                of, bucket, counts = _scanner(words, how).buckets(buffer)
                doc = np.array([i for i, _, _ in buffer])
                np.add.at(n_words, doc, counts)
                np.add.at(n_features, doc, np.bincount(of, minlength=len(buffer)))
                # sums of whole numbers far below 2**53 are exact in doubles
                sums = np.bincount(of, weights=gains[bucket].astype(np.float64), minlength=len(buffer)).astype(np.int64)
                np.add.at(weight, doc, sums)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "known": batch["known"], "text_hash": batch["text_hash"], "n_words": n_words, "n_features": n_features, "weight": weight})

    # a missing id goes through pandas as 0, so that ids stay whole numbers
    return (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"),
                        "text", F.xxhash64("text").alias("text_hash"))
            .mapInPandas(rows, "doc_id long, known boolean, text_hash long, n_words long, n_features long, weight long")
            .withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known"))


def drawn(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """One row per document (doc_id, text): a hash of its text, n_words, n_features, weight, score, and its rank if drawn.

    ``target`` needs a text column. The dictionary (at most ``how.dictionary`` words of 64
    bytes) and the gains are all that reaches the driver.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(frequent_words(docs.select("text").unionByName(target.select("text")), how))
    gains = bucket_gains(bucket_counts(docs, words, how), bucket_counts(target, words, how))
    name = F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = settled(weighed(docs, gains, words, how).withColumn("score", (F.col("weight") + noise).cast("long"))
                     .withColumn("__tie", F.monotonically_increasing_id()))
    able = F.col("n_words") >= how.least_words
    n_drawn = how.percent * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "__tie"]
    ranked = numbered(scored.where(able), [], order, "place")
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= n_drawn, F.col("place")).cast("long")).drop("place")
    return (ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
            .select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", "rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """The drawn documents with all their columns; rows equal in id and text stay or go together."""
    chosen = (drawn(docs, target, how).where("rank IS NOT NULL")
              .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("__all"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__own"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    return rows.join(chosen, same, "left_semi").select("__all.*")
