"""Packing documents into fixed-length sequences by minimum bin slack.

Documents are tokenized and cut at multiples of the capacity; the whole-capacity pieces
are sequences of their own, and the tails are packed. Pieces are dealt by hash into
groups of bounded size. In a group each window starts from the longest piece left; a
bitset dynamic program over the remaining lengths (with their counts) finds the multiset
that fills the window closest to capacity, backtracking gives its counts, and the same
multiset is used as often as the counts allow.

Ids are those of the byte-level BPE vocabulary, with the string of its special token
read as that token; id 0 ends each document. The rank file's encoder is the faster one; a
text with a very long run of blanks, which it cannot split, goes to the encoder of the
JSON file, which gives the same ids.

Defined results: a null or empty text is the closing id alone; repeated rows are packed
each; an empty table gives an empty result; of equally close fills the one found first is
taken, from the longest length down. A very long text is many pieces, which the hash
spreads over the groups, as a number of the row in it spreads rows that share or lack an
id (so ``docs`` should be a table or a checkpoint, whose rows come back in the same order).
Only the named columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: pieces a group holds on average, at most; fewer where they carry their ids, some 16 MB
GROUP_ROWS, GROUP_ROWS_WITH_IDS = 8192, 4096
SPECIAL = ("<|endoftext|>", 50256)
CLOSING = 0
#: blanks in a row from which on a text is encoded by the JSON file's encoder
LONG_RUN = 50_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL[0]: SPECIAL[1]})


@lru_cache(maxsize=2)
def _json_encoder(json_path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(json_path)


def token_ids(text: str | None, ranks_path: str, pattern: str, json_path: str | None = None) -> np.ndarray:
    """Ids of one document with the closing id, as little-endian unsigned 32-bit numbers."""
    if json_path and len(text or "") >= LONG_RUN and _LONG_RUN.search(text):
        ids = np.array(_json_encoder(json_path).encode(text, add_special_tokens=False).ids, dtype=np.int64)
    else:
        ids = _encoder(ranks_path, pattern).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, CLOSING).astype("<u4")


def pieces(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, doc_tokens, ``ids`` (packed bytes) and
    ``row``, a number of the document's row."""
    import public_tokenizers
    json_path = public_tokenizers.path("byte_bpe_50k.json") if ranks_path is None else None
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    names = ["doc_id", "row", "start", "length", "doc_tokens", "ids"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = []
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                ids = token_ids(text, ranks_path, pattern, json_path)
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    out.append((doc_id, row, at, len(part), len(ids), part.tobytes()))
                    if len(out) == 2048:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").mapInPandas(
        cut, "doc_id long, row long, start long, length long, doc_tokens long, ids binary")


def group_count(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> int:
    """Groups enough for all pieces: a document has at most one piece more than bytes / capacity."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(1, -(-(rows + (size or 0) // capacity) // group_rows))


def closest_fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """Counts of the multiset of lengths whose sum comes closest to ``space`` from below.

    Bit s of ``reach`` says that a sum s can be made; each step adds one copy of a length,
    longest first, and the search ends as soon as ``space`` itself is reached. Walking the
    steps back tells which copies the best sum uses.
    """
    reach, full, steps = 1, (1 << (space + 1)) - 1, []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        for _ in range(min(counts[length], space // length)):
            steps.append((length, reach))
            grown = (reach | (reach << length)) & full
            if grown == reach:
                steps.pop()
                break
            reach = grown
        if reach >> space & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + 1
            left -= length
    return used


def packed_windows(lengths: list[int], capacity: int) -> Iterator[list[int]]:
    """Index lists of the windows; ``lengths`` are in 1..capacity."""
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        by_length.setdefault(x, []).append(i)
    counts = {x: len(v) for x, v in by_length.items()}
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        used = closest_fill({x: n for x, n in rest.items() if n}, capacity - longest) if longest < capacity else {}
        used[longest] = used.get(longest, 0) + 1
        for _ in range(min(counts[x] // n for x, n in used.items())):
            window = []
            for x in sorted(used, reverse=True):
                window += [by_length[x].pop() for _ in range(used[x])]
                counts[x] -= used[x]
            yield window
        counts = {x: n for x, n in counts.items() if n}


def assigned(spans: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``spans`` (doc_id, row, start, length and any more columns) with sequence_id and offset, without ``row``."""
    names = [c for c in spans.columns if c != "row"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields if f.name != "row")

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        for n, window in enumerate(packed_windows(lengths.tolist(), capacity)):
            at = 0
            for i in window:
                sequence[i], offset[i] = n * groups + key[0], at
                at += lengths[i]
        group = group[names]
        group["sequence_id"], group["offset"] = sequence, offset
        return group

    return (spans.withColumn("__group", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)))
            .groupBy("__group").applyInPandas(pack, f"{fields}, sequence_id long, offset long"))


def packed(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of all documents, with its place: the digest form, without the ids."""
    spans = pieces(docs, ranks_path, capacity).select(
        "doc_id", "row", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assigned(spans, group_count(docs, capacity), capacity)


def sequences(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per sequence: its ids, their number, and the spans (doc_id, start, length, offset) it holds."""
    placed = assigned(pieces(docs, ranks_path, capacity).select("doc_id", "row", "start", "length", "ids"),
                      group_count(docs, capacity, GROUP_ROWS_WITH_IDS), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("__parts"))
            .select("sequence_id", "n_tokens",
                    F.transform("__parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"),
                                                              p["length"].alias("length"), p["offset"].alias("offset"))).alias("spans"),
                    F.aggregate("__parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
