"""Removing repeated passages: exact substring dedup over phrases of the corpus.

Every byte that lies in a ``length``-byte string starting earlier in the corpus (smaller
doc_id, or earlier in the same document) is removed; strings are judged on the input and
never cross documents.

1. Rolling-hash triggers: the least rolling hash of the ``gram``-byte strings inside a
   window of ``length`` bytes is its trigger (leftmost if tied). It depends on the
   window's bytes alone, so equal windows have equal triggers at equal places, and, unlike
   with a fixed modulus, every window has one. Consecutive windows of one trigger make a
   phrase: the bytes they cover, some ``length`` + 35.
2. The dictionary is the distinct phrases with the first document of each. A phrase in any
   other document repeats as a whole. Phrases whose trigger occurs once in the corpus need
   no further look. Tables name a phrase by its hash alone; where it lies in a text comes
   from parsing that text again, so a place never meets another text.
3. Dictionary phrases that differ but share a trigger may still share windows (at the
   edges of a passage). Their windows, the dictionary's suffixes cut to ``length`` bytes,
   are put in order within the trigger, and each but the first in corpus order repeats.
   Only equality of windows matters here, so they are ordered by hash, not by letters.
4. The repeats of a document are laid over its bytes.

A trigger shared by more than ``crowd`` dictionary phrases (a line found in very many
places) has its windows counted by grouped minima instead, combined before the shuffle,
so no task holds a crowded trigger. Strings are compared by 64-bit hashes of phrase and
trigger together, or of window and trigger together.

Defined results: a null text is empty; texts shorter than ``length`` bytes stay whole; a
row without a doc_id is a document of its own, compared with itself alone; rows that repeat a doc_id
are compared as that document's text, each on its own, and repeat nothing of each other,
be their texts equal or different (a hash of the text tells them apart).
An empty table gives an empty result. Long texts are parsed in slices.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .jaccard_join import _BYTE, _powers, grouped, mixed, run_ends

_PLACE = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Passages:
    """Bytes of a passage, bytes of a trigger, most phrases a trigger's task holds, window starts of a slice."""

    length: int = 100
    gram: int = 32
    crowd: int = 32768
    slice: int = 1 << 20


@dataclass
class Phrases:
    """Phrases of a buffer of documents, as parallel arrays; ``start`` is relative to the document."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray


def _prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    return sums, down


def _parse(data: bytes, begins: np.ndarray, ends: np.ndarray, shift: np.ndarray, how: Passages) -> Phrases:
    """Phrases of documents data[begins:ends]; ``shift`` is added to the starts of each."""
    raw = np.frombuffer(data, np.uint8)
    sums, down = _prefix(raw)
    span = how.length - how.gram + 1
    grams = mixed((sums[how.gram:] - sums[:-how.gram]) * down[:len(raw) - how.gram + 1])
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(grams) // span) * span, ~np.uint64(0))
    padded[:len(grams)] = keyed
    block = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - how.length + 1
    least = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(begins)), ends - begins)[:n]
    valid = np.flatnonzero(np.arange(n) + how.length <= ends[doc])
    least, doc = least[valid], doc[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first, windows, trigger = valid[at], np.diff(np.append(at, len(valid))), least[at]
    last = first + windows - 1 + how.length
    whole = (sums[last] - sums[first]) * down[first] + ((trigger - first) << 32 | windows).astype(np.uint64)
    doc = doc[at]
    return Phrases(doc, first - begins[doc] + shift[doc], windows, grams[trigger], mixed(whole))


def parsed(texts: list[bytes], how: Passages) -> Phrases:
    """Phrases of several documents, each parsed apart, long ones in slices that overlap by length - 1 bytes."""
    parts: list[Phrases] = []
    buffer: list[tuple[int, int, bytes]] = []

    def flush():
        size = np.array([len(b) for _, _, b in buffer])
        ends = np.cumsum(size)
        if len(buffer) and ends[-1] >= how.length:
            got = _parse(b"".join(b for _, _, b in buffer), ends - size, ends, np.array([s for _, s, _ in buffer]), how)
            got.doc = np.array([d for d, _, _ in buffer])[got.doc]
            parts.append(got)
        buffer.clear()

    held = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - how.length + 1), how.slice):
            piece = text[at:at + how.slice + how.length - 1]
            if len(piece) < how.length:
                continue
            buffer.append((i, at, piece))
            held += len(piece)
            if held >= 1 << 16:
                flush()
                held = 0
    flush()
    if not parts:
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Phrases(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("doc", "start", "windows", "trigger", "phrase")])


def first_in_document(p: Phrases) -> np.ndarray:
    """Whether each phrase is the first of its kind in its document."""
    order = np.lexsort((p.start, p.phrase, p.trigger, p.doc))
    same = np.zeros(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    same[1:] = (p.doc[a] == p.doc[b]) & (p.trigger[a] == p.trigger[b]) & (p.phrase[a] == p.phrase[b])
    first = np.ones(len(order), dtype=bool)
    first[order] = ~same
    return first


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def triggers(docs: DataFrame, how: Passages) -> DataFrame:
    """(t): the trigger of each phrase, once per distinct phrase of a document."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                p = parsed(_bytes(batch["text"].iloc[at:at + 500]), how)
                yield pd.DataFrame({"t": p.trigger[first_in_document(p)].astype(np.int64)})

    return docs.mapInPandas(rows, "t long")


def phrases(docs: DataFrame, how: Passages) -> DataFrame:
    """(t, p, doc): the distinct phrases of each document."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                p = parsed(_bytes(part["text"]), how)
                keep = first_in_document(p)
                yield pd.DataFrame({"t": p.trigger[keep].astype(np.int64), "p": p.phrase[keep].astype(np.int64),
                                    "doc": part["doc"].to_numpy()[p.doc[keep]]})

    return docs.mapInPandas(rows, "t long, p long, doc long")


def shared_windows(docs: DataFrame, listed_phrases: DataFrame, how: Passages) -> DataFrame:
    """(t, doc, own, start, hashes): hashes of all windows of the phrases listed (doc, p), at the first
    place of each in every text of the document; ``own`` is the hash of the text."""
    listed = listed_phrases.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list("p").alias("listed"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["t", "doc", "own", "start", "hashes"]
        for batch in batches:
            out: list = []
            for doc, own, text, items in zip(batch["doc"], batch["own"], _bytes(batch["text"]), batch["listed"]):
                p = parsed([text], how)
                wanted = np.flatnonzero(first_in_document(p) & np.isin(p.phrase, np.asarray(items, np.int64).astype(np.uint64)))
                for start, n, t in zip(p.start[wanted].tolist(), p.windows[wanted].tolist(), p.trigger[wanted].astype(np.int64).tolist()):
                    sums, down = _prefix(np.frombuffer(text, np.uint8)[start:start + n - 1 + how.length])
                    values = mixed((sums[how.length:] - sums[:n]) * down[:n])
                    out.append((t, doc, own, start, values.astype(np.int64)))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return (docs.join(listed, F.col("doc") == F.col("__doc")).select("doc", F.xxhash64("text").alias("own"), "text", "listed")
            .mapInPandas(rows, "t long, doc long, own long, start long, hashes array<long>"))


def repeated_by_trigger(windows: DataFrame) -> DataFrame:
    """(doc, own, start, windows): runs of windows that are found in an earlier document, or earlier in
    their own text, among a trigger's phrases."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in grouped(batches, ["t"]):
            group = run_ends(run, ["t"])
            sizes = np.array([len(h) for h in run["hashes"]])
            row = np.repeat(np.arange(len(run)), sizes)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            docs, owns, start = run["doc"].to_numpy(), run["own"].to_numpy(), run["start"].to_numpy()[row] + offset
            kind, in_group = np.concatenate(run["hashes"].to_numpy()), group[row]
            order = np.lexsort((start, owns[row], docs[row], kind, in_group))
            new = np.ones(len(order), dtype=bool)
            a, b = order[1:], order[:-1]
            new[1:] = (kind[a] != kind[b]) | (in_group[a] != in_group[b])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            earlier = docs[row[order]] != docs[row[first]]
            new[1:] |= (docs[row[a]] != docs[row[b]]) | (owns[row[a]] != owns[row[b]])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            again = np.zeros(len(order), dtype=bool)
            again[order] = earlier | (start[order] != start[first])
            hit = np.flatnonzero(again)
            if len(hit):
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
                at = np.flatnonzero(new)
                of = row[hit[at]]
                yield pd.DataFrame({"doc": docs[of], "own": owns[of], "start": start[hit[at]], "windows": np.diff(np.append(at, len(hit)))})

    return (windows.repartition("t").sortWithinPartitions("t", "doc", "own", "start")
            .mapInPandas(rows, "doc long, own long, start long, windows long"))


def repeated_by_count(windows: DataFrame) -> DataFrame:
    """The same answer from grouped minima, one row per window: for triggers too crowded for a task."""
    one = settled(windows.select("t", "doc", "own", "start", F.posexplode("hashes").alias("i", "h"))
                  .select("t", "h", "doc", "own", (F.col("start") + F.col("i")).alias("start")))
    texts = settled(one.groupBy("t", "h", "doc", "own").agg(F.min("start").alias("least"), F.count("*").alias("n")))
    first = (texts.groupBy("t", "h").agg(F.min("doc").alias("first_doc"), F.sum("n").alias("n"))
             .where("n > 1").select(F.col("t").alias("__t"), F.col("h").alias("__h"), "first_doc"))
    same = (F.col("t") == F.col("__t")) & (F.col("h") == F.col("__h"))
    earlier = one.join(first, same).where("doc != first_doc").select("doc", "own", "start")
    twice = texts.where("n > 1").select(F.col("t").alias("__t"), F.col("h").alias("__h"), F.col("doc").alias("__doc"),
                                        F.col("own").alias("__own"), "least")
    inside = (one.join(twice, same & (F.col("doc") == F.col("__doc")) & (F.col("own") == F.col("__own")))
              .where("start != least").select("doc", "own", "start"))
    return earlier.unionByName(inside).withColumn("windows", F.lit(1).cast("long"))


def known_phrases(docs: DataFrame, how: Passages) -> DataFrame:
    """Phrases whose trigger occurs more than once in the corpus, settled."""
    common = triggers(docs, how).groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    return settled(phrases(docs, how).join(common, "t"))


def resolved_phrases(docs: DataFrame, how: Passages) -> tuple[DataFrame, DataFrame]:
    """(whole, several), both settled: phrases that occur in an earlier document as (doc, p), and the
    dictionary phrases that share a trigger with another as (doc, p, crowded)."""
    known = known_phrases(docs, how)
    release(docs)
    entries = settled(known.groupBy("t", "p").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")))
    again = entries.where("n > 1").select(F.col("t").alias("__t"), F.col("p").alias("__p"), "first_doc")
    whole = settled(known.join(again, (F.col("t") == F.col("__t")) & (F.col("p") == F.col("__p"))).where("doc != first_doc")
                    .select("doc", "p"))
    crowds = (entries.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
              .select(F.col("t").alias("__t"), (F.col("n") > how.crowd).alias("crowded")))
    several = settled(entries.join(crowds, F.col("t") == F.col("__t"))
                      .select(F.col("first_doc").alias("doc"), "p", "crowded"))
    return whole, several


def repeats(docs: DataFrame, how: Passages) -> DataFrame:
    """(doc, p, run): all that occurs earlier in the corpus, but for phrases repeated inside one text: a
    whole phrase by its hash ``p``, or a ``run`` (own, start, windows) of window starts in one text."""
    whole, several = resolved_phrases(docs, how)
    release(docs)
    runs = repeated_by_trigger(shared_windows(docs, several.where("NOT crowded"), how))
    if not several.where("crowded").isEmpty():
        runs = runs.unionByName(repeated_by_count(shared_windows(docs, several.where("crowded"), how)))
    runs = runs.select("doc", F.lit(None).cast("long").alias("p"), F.struct("own", "start", "windows").alias("run"))
    return whole.select("doc", "p", F.lit(None).cast(runs.schema["run"].dataType).alias("run")).unionByName(runs)


def release(df: DataFrame) -> None:
    """Let the context cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def repeated_inside(data: bytes, how: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(start, windows) of the windows of one text that are found earlier in it."""
    if len(data) < how.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, down = _prefix(np.frombuffer(data, np.uint8))
    n = len(data) - how.length + 1
    first = np.zeros(n, dtype=bool)
    first[np.unique(mixed((sums[how.length:] - sums[:n]) * down[:n]), return_index=True)[1]] = True
    again = np.flatnonzero(~first)
    new = np.flatnonzero(np.append(True, again[1:] != again[:-1] + 1)) if len(again) else again
    return again[new], np.diff(np.append(new, len(again)))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]


def kept_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def deduplicated(docs: DataFrame, how: Passages = Passages(), with_text: bool = True) -> DataFrame:
    """One row per document (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, the removed
    ``spans`` (start, end in bytes) and, if asked for, the bytes kept."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    # one frame for both joins that need the texts, so that they are shuffled once
    compared = own.where("doc IS NOT NULL AND text IS NOT NULL")
    alone = own.where("doc IS NULL OR text IS NULL")
    found = (repeats(compared, how).groupBy(F.col("doc").alias("__doc"))
             .agg(F.collect_list("p").alias("phrases"), F.collect_list("run").alias("runs")))
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<start:long,end:long>>" + (", kept binary" if with_text else ""))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                texts = _bytes(part["text"])
                p = parsed([b"" if d is None or d != d else t for d, t in zip(part["doc"], texts)], how)
                inside = ~first_in_document(p)
                bounds = np.searchsorted(p.doc, np.arange(len(part) + 1))
                out = []
                for i, (doc, own, data, whole, runs) in enumerate(zip(part["doc"], part["own"], texts, part["phrases"], part["runs"])):
                    local = slice(bounds[i], bounds[i + 1])
                    gone = inside[local]
                    if whole is not None and len(whole):
                        gone = gone | np.isin(p.phrase[local], np.asarray(whole, np.int64).astype(np.uint64))
                    starts, windows = p.start[local][gone], p.windows[local][gone]
                    if doc is None or doc != doc:
                        starts, windows = repeated_inside(data, how)
                    runs = [] if runs is None else [x for x in runs if x["own"] == own]
                    if runs:
                        starts = np.append(starts, [x["start"] for x in runs])
                        windows = np.append(windows, [x["windows"] for x in runs])
                    if len(starts):
                        a, b = _merged(starts, starts + windows - 1 + how.length)
                    else:
                        a = b = np.zeros(0, np.int64)
                    kept = kept_bytes(data, a, b)
                    row = [doc, len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(),
                           [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]]
                    out.append((*row, kept) if with_text else tuple(row))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    laid = compared.join(found, F.col("doc") == F.col("__doc"), "left").select("doc", "text", "phrases", "runs")
    nothing = {c: F.lit(None).cast(laid.schema[c].dataType) for c in ("phrases", "runs")}
    return laid.unionByName(alone.withColumns(nothing)).withColumn("own", F.xxhash64("text")).mapInPandas(rows, schema)
