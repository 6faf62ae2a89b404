"""Near-duplicate documents: n-gram Jaccard join with Bayesian candidate pruning.

A document is its set of five-word shingles; two documents are linked at a Jaccard
similarity of 0.8 or more.

1. Documents of equal shingle sets are one class, which has a number of its own; a row
   with the least doc_id stands for it.
2. MinHash values in bands of four give candidate buckets. Inside a bucket two classes
   are compared sixteen MinHash values at a time, and the pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below
   ``tolerance``. What survives joins classes into cells.
3. Within a cell all pairs are verified exactly: shingles are compared as words, and all
   intersections of a block of documents come from one matrix product.

No step lists pairs: a bucket or cell reports one edge per member, and link counts.
Buckets and cells too large for a task are dealt in pairs of blocks. A pair at exactly
0.8 shares no band with probability 3e-6 (24 bands), and loses its chance in the Bayes
test about as rarely.

Words are runs of characters other than ASCII white space, compared as they stand. A
document of one to four words is one shingle of all of them.

Defined results: a null text or one without words links with nothing, as does a row
without a doc_id. Rows that repeat a doc_id are told apart by a hash of their text: equal
ones are one class, different ones link as different documents do; in the result by id they
share the least class and the sum of links. An empty table gives an empty result. Very long texts are hashed in slices. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled

BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 20


@dataclass(frozen=True)
class Join:
    """Words per shingle, similarity num / den, bands x rows of MinHash values, Bayes tolerance,
    and a block's documents and shingles, on average at most."""

    words: int = 5
    num: int = 4
    den: int = 5
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    block: int = 1024
    block_shingles: int = 400_000


_POWERS: dict = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2**64, and their inverses."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; a difference of polynomial prefix sums, moved to exponent 0."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words of one text, in slices that end between words."""
    if len(text) <= SLICE:
        return _hash_words(text)[0]
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + SLICE)
        while to < len(text) and not _BLANK[text[to]]:
            to += 1
        out.append(_hash_words(text[at:to])[0])
        at = to
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, or of the whole text when it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = (total + words[i:i + n]) * np.uint64(BASE)
    return mixed(total + np.uint64(size))


def minhash_factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


def profile(docs: DataFrame, how: Join) -> DataFrame:
    """(doc_id, own, print, n, keys, sketch) of each document with words: hash of the text, fingerprint and size of its
    shingle set, one bucket key per band, and the low byte of each MinHash value."""
    total = how.bands * how.rows
    a, b = minhash_factors(total)
    bands = mixed(np.arange(1, how.bands + 1, dtype=np.uint64))

    def flush(ids, owns, prints, sets):
        flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        values = np.empty((total, len(sets)), np.uint64)
        for k in range(total):
            values[k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), starts)
        keys = np.zeros((how.bands, len(sets)), np.uint64)
        grouped = values.reshape(how.bands, how.rows, len(sets))
        for r in range(how.rows):
            keys = mixed(keys * np.uint64(BASE) + grouped[:, r])
        keys = mixed(keys ^ bands[:, None]).T.astype(np.int64)
        low = (values.T & np.uint64(255)).astype(np.uint8)
        return pd.DataFrame({"doc_id": ids, "own": owns, "print": prints, "n": [len(x) for x in sets], "keys": list(keys), "sketch": [x.tobytes() for x in low]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, owns, prints, sets, size = [], [], [], [], 0
            for doc_id, own, text in zip(batch["doc_id"], batch["own"], batch["text"]):
                found = np.unique(shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass")), how.words))
                if not len(found):
                    continue
                ids.append(doc_id)
                owns.append(own)
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sets.append(found)
                size += len(found)
                if size >= 1 << 15:
                    yield flush(ids, owns, prints, sets)
                    ids, owns, prints, sets, size = [], [], [], [], 0
            if ids:
                yield flush(ids, owns, prints, sets)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
            .where("doc_id IS NOT NULL AND text IS NOT NULL")
            .mapInPandas(rows, "doc_id long, own long, print binary, n long, keys array<long>, sketch binary"))


def least_matches(how: Join) -> list[tuple[int, int]]:
    """(values compared, matches needed) after each step of the Bayes test.

    With a uniform prior on the similarity s and one byte kept per value, a value matches
    with probability s + (1 - s) / 256; fewer matches than the second number leave a
    posterior probability below the tolerance of s reaching the threshold.
    """
    s = (np.arange(4000) + 0.5) / 4000
    match = s + (1 - s) / 256
    reached = s >= how.num / how.den
    out = []
    for n in range(how.step, how.bands * how.rows + 1, how.step):
        for m in range(n + 1):
            weight = np.exp(m * np.log(match) + (n - m) * np.log1p(-match) - np.max(m * np.log(match) + (n - m) * np.log1p(-match)))
            if weight[reached].sum() / weight.sum() >= how.tolerance:
                out.append((n, m))
                break
    return out


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from sorted batches; a run may be many groups, never part of one."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        last = np.ones(len(batch), dtype=bool)
        for k in keys:
            last &= (batch[k] == batch[k].iloc[-1]).to_numpy()
        cut = int(np.argmax(last))
        if cut:
            yield batch.iloc[:cut]
        rest = batch.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def run_ends(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """For each row, the row after the last one of its group."""
    new = np.ones(len(frame), dtype=bool)
    new[1:] = False
    for k in keys:
        column = frame[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(new)
    return np.append(starts[1:], len(frame))[np.cumsum(new) - 1]


def surviving_roots(ends: np.ndarray, sketch: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Root row of each row when the pairs that pass the Bayes test are joined, within groups.

    Rows are compared at growing distance; pairs already joined are skipped.
    """
    root = np.arange(len(ends))
    rows, distance = root, 0
    starts = np.append(0, np.unique(ends)[:-1])
    begins = starts[np.searchsorted(starts, root, side="right") - 1]
    while True:
        distance += 1
        rows = rows[rows + distance < ends[rows]]
        if not len(rows):
            return root
        i = rows[root[rows] != root[rows + distance]]
        matches, done = np.zeros(len(i), np.int32), 0
        for upto, least in needed:
            matches += (sketch[i, done:upto] == sketch[i + distance, done:upto]).sum(axis=1, dtype=np.int32)
            i, matches, done = i[matches >= least], matches[matches >= least], upto
        for x in i:
            p, q = sorted((root[x], root[x + distance]))
            if p != q:
                group = root[begins[x]:ends[x]]
                group[group == q] = p


def cells(classes: DataFrame, how: Join) -> DataFrame:
    """(node, component): classes that candidate pairs surviving the Bayes test connect."""
    spread = classes.select(F.explode("keys").alias("key"), "rep")
    shared = (spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
              .select("key", F.ceil(F.col("n") / how.block).cast("int").alias("blocks")))
    dealt = (in_blocks(spread.join(shared, "key"), "rep").join(classes.select("rep", "sketch"), "rep")
             .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep"))
    needed = least_matches(how)

    def survive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in grouped(batches, ["key", "lo", "hi"]):
            sketch = np.frombuffer(b"".join(run["sketch"]), dtype=np.uint8).reshape(len(run), -1)
            root = surviving_roots(run_ends(run, ["key", "lo", "hi"]), sketch, needed)
            rep = run["rep"].to_numpy()
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})

    return components(dealt.mapInPandas(survive, "a long, b long"))


def in_blocks(rows: DataFrame, member: str) -> DataFrame:
    """Deals the rows of a group to its pairs of blocks: adds lo, hi and ``own``, the row's block.

    ``blocks`` is the number of blocks of the row's group; with one, the row comes once.
    """
    return (rows.withColumn("own", F.pmod(F.hash(F.col(member), F.lit(1)), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks"))


def shingle_sets(texts: list[str], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of the shingles that at least two of the texts have, and each text's number of distinct shingles.

    Words are numbered, then pairs of (number so far, next word) are numbered anew for each
    further word of the window: exact, and a few numbers per shingle in memory. A text
    shorter than a window is filled up with a number that is no word's.
    """
    vocabulary: dict[bytes, int] = {}
    numbers = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        numbers.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), dtype=np.int64, count=len(words)))
    fill = len(vocabulary)
    numbers = [x if len(x) >= size else np.append(x, np.full(size - len(x), fill)) for x in numbers]
    windows = np.array([len(x) - size + 1 for x in numbers])
    code = np.concatenate([x[:n] for x, n in zip(numbers, windows)])
    for o in range(1, size):
        code = np.unique(code * (fill + 1) + np.concatenate([x[o:o + n] for x, n in zip(numbers, windows)]), return_inverse=True)[1]
    kinds = int(code.max()) + 1
    pairs = np.unique(np.repeat(np.arange(len(texts)), windows) * kinds + code)
    text_of, code = pairs // kinds, pairs % kinds
    shared = np.bincount(code, minlength=kinds) > 1
    rank = np.cumsum(shared) - 1
    ends = np.searchsorted(text_of, np.arange(len(texts) + 1))
    sets = [code[x:y] for x, y in zip(ends[:-1], ends[1:])]
    return [rank[c[shared[c]]] for c in sets], np.diff(ends)


def intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols], by slices of the shingles."""
    both = np.union1d(rows, cols)
    at = np.concatenate([np.full(len(sets[i]), n) for n, i in enumerate(both)])
    ids = np.concatenate([sets[i] for i in both])
    order = np.argsort(ids, kind="stable")
    at, ids = at[order], ids[order]
    out = np.zeros((len(rows), len(cols)), np.float64)
    r, c = np.searchsorted(both, rows), np.searchsorted(both, cols)
    for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        lo, hi = np.searchsorted(ids, [start, start + width])
        if lo < hi:
            block = np.zeros((len(both), min(width, int(ids[hi - 1]) - start + 1)), np.float32)
            block[at[lo:hi], ids[lo:hi] - start] = 1
            out += block[r] @ block[c].T
    return out


def verified(members: DataFrame, how: Join) -> DataFrame:
    """(rep, links, least) for rows (cell, blocks, rep, times, text): link counts by exact comparison, and an edge.

    A pair is compared in one block pair only, so counts of a class add up over its blocks.
    """
    keys = ["cell", "lo", "hi"]
    dealt = in_blocks(members, "rep").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        sets, sizes = shingle_sets(cell["text"].tolist(), how.words)
        own, rep, times = cell["own"].to_numpy(), cell["rep"].to_numpy(), cell["times"].to_numpy()
        low, high = np.flatnonzero(own == cell["lo"].iloc[0]), np.flatnonzero(own == cell["hi"].iloc[0])
        shared = intersections(sets, low, high)
        alike = (how.num + how.den) * shared >= how.num * (sizes[low][:, None] + sizes[high][None, :])
        links = np.zeros(len(cell), np.int64)
        if low is high or cell["lo"].iloc[0] == cell["hi"].iloc[0]:
            alike[np.arange(len(low)), np.arange(len(low))] = False
            links[low] = alike @ times[high]
        else:
            links[low], links[high] = alike @ times[high], alike.T @ times[low]
        root = np.arange(len(cell))
        for x, row in zip(low, alike):
            met = np.unique(np.append(root[high[row]], root[x]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
        return pd.DataFrame({"rep": rep, "links": links, "least": rep[root]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in grouped(batches, keys):
            ends = run_ends(run, keys)
            at = 0
            while at < len(run):
                yield one(run.iloc[at:ends[at]])
                at = ends[at]

    return dealt.mapInPandas(rows, "rep long, links long, least long")


def memberships(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, own, root, class_id, n_links) of each row with an id and words: ``own`` is the hash of its
    text, ``root`` the number of its class and class_id the least doc_id reachable by links."""
    found = settled(profile(docs, how))
    # a class is its shingle set, not its least document, which may repeat its id with another text
    classes = settled(found.groupBy("print").agg(F.min(F.struct("doc_id", "own", "n", "keys", "sketch")).alias("r"), F.count("*").alias("times"))
                      .select(F.monotonically_increasing_id().alias("rep"), "print", "times", F.col("r.doc_id").alias("doc_id"),
                              F.col("r.own").alias("own"), "r.n", "r.keys", "r.sketch"))
    cell = cells(classes, how).withColumnRenamed("component", "cell")
    wanted = cell.join(classes.select("rep", "times", "n", "doc_id", "own"), F.col("node") == F.col("rep"))
    blocks = F.ceil(F.greatest(F.count("*") / how.block, F.sum("n") / how.block_shingles)).cast("int")
    wanted = wanted.join(wanted.groupBy("cell").agg(blocks.alias("blocks")), "cell")
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__own"), "text").where("text IS NOT NULL")
    # rows equal in id and text give their text once
    members = (wanted.join(texts, (F.col("doc_id") == F.col("__doc")) & (F.col("own") == F.col("__own")))
               .groupBy("cell", "blocks", "rep", "times").agg(F.first("text").alias("text")))
    checked = settled(verified(members, how))
    edges = checked.where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    joined = components(edges).withColumnRenamed("component", "root")
    named = joined.join(classes.select("rep", "doc_id"), F.col("node") == F.col("rep"))
    least = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("node", "root", "component")
    linked = (checked.groupBy("rep").agg(F.sum("links").alias("links"))
              .join(least, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("__rep"), "links", "root", "component"))
    # links meet the classes first, one row each; the copies of a class then meet it by its fingerprint
    solved = (classes.select(F.col("print").alias("__print"), "rep", "doc_id", "times").join(linked, F.col("rep") == F.col("__rep"), "left")
              .select("__print", F.coalesce("root", "rep").alias("root"), F.coalesce("component", "doc_id").alias("class_id"),
                      (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    return (found.select("doc_id", "own", "print").join(solved, F.col("print") == F.col("__print"))
            .select("doc_id", "own", "root", "class_id", "n_links"))


def near_duplicates(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """One row per document (doc_id, text): class_id (least doc_id reachable by links), n_links, kept."""
    known = (memberships(docs, how).groupBy(F.col("doc_id").alias("__id"))
             .agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return (ids.join(known, F.col("doc_id") == F.col("__id"), "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))))


def distinct_documents(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The documents without their near copies, with all columns: of each class the least doc_id stays.

    Where several texts of a class share the least doc_id, the one of least hash stays; of
    rows that repeat both doc_id and text one stays; rows without words stay, and all rows
    without an id.
    """
    members = settled(memberships(docs, how).select("doc_id", "own", "root"))
    first = members.groupBy(F.col("root").alias("__root")).agg(F.min(F.struct("doc_id", "own")).alias("__first"))
    copies = (members.join(first, F.col("root") == F.col("__root")).where(F.struct("doc_id", "own") != F.col("__first"))
              .select(F.col("doc_id").alias("__doc"), F.col("own").alias("__own")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("__all"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"))
    named = (rows.where("__id IS NOT NULL").join(copies, (F.col("__id") == F.col("__doc")) & (F.col("__hash") == F.col("__own")), "left_anti")
             .groupBy("__id", "__hash").agg(F.min_by("__all", F.xxhash64("__all")).alias("__all")).select("__all.*"))
    return named.unionByName(rows.where("__id IS NULL").select("__all.*"))
