"""Filter interaction audit by an incremental, retracting stream.

What each of several filters removes depends on those before it. All files of the table
run through one Structured Streaming query as available-now micro-batches that keep part
counters of failure masks (which of the filters a document fails); every order of the
filters is then evaluated on the counters.

1. A document's text gives its mask bits A to D and a 128-bit key. Labels join by document.
2. Bit E, a copy of a smaller id's text, may change with every micro-batch: keyed state
   holds the least doc_id seen of each text, with the masks counted for it. A row with a
   larger id fails E at once. A smaller id retracts the earlier mask from the counters and
   counts it again with E.
3. The stream's file sink holds signed counts of (part, mask, labels), so a replayed
   micro-batch counts once; their sums are the counters, at most 128 rows per part.
4. Orders and steps are read off the counters: 600 rows per part.

Rows are pre-combined in each batch of rows before the shuffle, so copies of one text
arrive as one row per batch. State is kept per cell of some sixteen texts, as one call of
the state store per text would cost more than the texts themselves. Nothing that grows
with the table meets in the driver: labels join by two sorted sides, never broadcast, and
the state has a bounded number of partitions, as each task reports on the stores of all.

Filters (words are runs of characters other than ASCII white space): A under 100 words; B
100 * distinct words < 80 * words; C 100 * capitals A-Z > 10 * code points; D any of
``#$%&*|``; E identical to the text of any smaller doc_id, removed or not.

Defined results: a null text is empty; a null part is the empty string; a row without a
doc_id is no copy and makes none; rows that repeat id and text fail E together or not at
all; several labels of one document count as their maximum, none as 0; an empty table gives
an empty result. Whole texts are judged. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillroll.session import ensure_checkpoint_dir

from .common import remove_folder, settled, shuffle_parts

LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
_CAPITALS = bytes(range(0x41, 0x5B))
_JUNK = re.compile(rb"[#$%&*|]")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Audit:
    """Micro-batches that the files are dealt to, texts of a state cell on average, the salt of the label join, and the most state partitions."""

    batches: int = 4
    cell_texts: int = 16
    spread: int = 8
    stores: int = 200


def text_mask(data: bytes, points: int) -> int:
    """Bits A to D of one text, given as UTF-8 bytes and its number of code points."""
    words = data.split()  # of bytes: at exactly the six ASCII white-space characters
    mask = BIT["A"] if len(words) < 100 else 0
    if 100 * len(set(words)) < 80 * len(words):
        mask |= BIT["B"]
    if 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 10 * points:
        mask |= BIT["C"]
    if _JUNK.search(data):
        mask |= BIT["D"]
    return mask


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, known, part, key, mask) of each document (doc_id, lang, text); batch or stream.

    A missing id goes through pandas as 0 and ``known`` false, so that ids stay whole numbers.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "known": batch["known"], "part": batch["part"],
                                "key": [hashlib.blake2b(d, digest_size=16).digest() for d in data],
                                "mask": [text_mask(d, len(t)) for d, t in zip(data, texts)]})

    return (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
            .mapInPandas(rows, "doc_id long, known boolean, part string, key binary, mask int"))


def with_labels(rows: DataFrame, labels: DataFrame, how: Audit) -> DataFrame:
    """Adds ``good`` and ``toxic`` (0 or 1). Rows of one id are spread over ``how.spread`` salts, rows without an id by their texts.

    Spark judges the salted labels by their compressed file; as a hash table they take over a hundred times
    as much, all in the driver. So the join is a sort-merge join at any size.
    """
    one = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id"))
           .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
           .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(how.spread - 1)))))
    salts = F.when(F.col("known"), F.lit(how.spread)).otherwise(F.lit(2**31 - 1))
    return (rows.withColumn("salt", F.pmod(F.xxhash64("key", "part"), salts).cast("int"))
            .join(settled(one).hint("merge"), (F.col("doc_id") == F.col("__id")) & F.col("known") & (F.col("salt") == F.col("__salt")), "left")
            .select("doc_id", "known", "part", "key", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def combined(rows: DataFrame) -> DataFrame:
    """Rows folded within each batch: (key, doc_id, part, mask, good, toxic, n, open).

    Open rows are those of the least id of a text in the batch; all others are settled:
    copies, which fail E whatever else comes, and rows without an id, which never do. Settled
    rows only go to be added up, so they borrow the keys of open rows and do not all follow a frequent text.
    """
    facts = ["part", "mask", "good", "toxic"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            known = batch["known"].to_numpy()
            least = batch["doc_id"].mask(~known, np.iinfo(np.int64).max).groupby(batch["key"]).transform("min")
            is_open = known & (batch["doc_id"] == least).to_numpy()
            batch["mask"] = batch["mask"] + BIT["E"] * (known & ~is_open)
            first = batch[is_open].groupby(["key", "doc_id", *facts], as_index=False).size().assign(open=True)
            rest = batch[~is_open].groupby(facts, as_index=False).agg(size=("key", "size"), key=("key", "first")).assign(open=False, doc_id=0)
            if len(first):
                rest["key"] = first["key"].to_numpy()[np.arange(len(rest)) % len(first)]
            for frame in (first, rest):
                yield frame.rename(columns={"size": "n"})[["key", "doc_id", *facts, "n", "open"]]

    return rows.mapInPandas(fold, "key binary, doc_id long, part string, mask int, good int, toxic int, n long, open boolean")


class LeastIds(StatefulProcessor):
    """State: for each cell of texts, the least id of each text and the counts that stand for it."""

    def __init__(self, cells: int):
        self.cells = cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getMapState("least", "cell long", "texts binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for frame in rows:
            counts: Counter = Counter()
            for cell, part in frame.groupby("cell"):
                self._count(cell, part, counts)
            out = [(*fact, n) for fact, n in counts.items() if n]
            yield pd.DataFrame(out, columns=["part", "mask", "good", "toxic", "n"])

    def _count(self, cell: int, rows: pd.DataFrame, counts: Counter) -> None:
        texts = None
        for key, doc_id, part, mask, good, toxic, n, is_open in zip(*[rows[c] for c in ("key", "doc_id", "part", "mask", "good", "toxic", "n", "open")]):
            fact = (part, int(mask), int(good), int(toxic))
            if not is_open:
                counts[fact] += n
                continue
            if texts is None:
                held = self.least.getValue((int(cell),))
                texts = pickle.loads(held[0]) if held is not None else {}
            key, doc_id, n = bytes(key), int(doc_id), int(n)
            known = texts.get(key)
            if known is None or doc_id < known[0]:
                for old, times in known[1].items() if known else ():
                    counts[old] -= times                      # the earlier least id is a copy after all
                    counts[_copy(old)] += times
                texts[key] = (doc_id, {fact: n})
                counts[fact] += n
            elif doc_id == known[0]:
                known[1][fact] = known[1].get(fact, 0) + n
                counts[fact] += n
            else:
                counts[_copy(fact)] += n
        if texts is not None:
            self.least.updateValue((int(cell),), (pickle.dumps(texts, protocol=5),))

    def close(self) -> None:
        pass


def _copy(fact: tuple) -> tuple:
    return (fact[0], fact[1] | BIT["E"], *fact[2:])


def file_stream(spark: SparkSession, path: str, schema, files_at_once: int) -> DataFrame:
    """The Parquet files of a table, be it a folder or a single file, as a stream.

    A file stream wants folders; as a pattern below its parent, a lone file will do too.
    """
    parent, name = path.rstrip("/").rsplit("/", 1)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("basePath", parent)
            .parquet(f"{parent}/{name[:-1]}[{name[-1]}]"))


DELTAS = "part string, mask int, good int, toxic int, n long"


def counters(spark: SparkSession, docs_path: str, labels: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail, from all files under ``docs_path``."""
    given = spark.read.parquet(docs_path)
    files, rows = len(given.inputFiles()), given.count()
    cells = max(1, rows // how.cell_texts)
    groups = 4 * shuffle_parts(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    stream = file_stream(spark, docs_path, given.schema, max(1, -(-files // how.batches)))
    cell = F.pmod(F.xxhash64("key"), F.lit(cells))
    keyed = (combined(with_labels(masked(stream), labels, how)).withColumn("cell", cell)
             .withColumn("group", F.pmod(F.col("cell"), F.lit(groups))))
    deltas = keyed.groupBy("group").transformWithStateInPandas(LeastIds(cells), DELTAS, "append", "none")
    # changes alone are uploaded after a micro-batch, and no disk is set aside for the logs of a store; with as many
    # stores as the session's partitions, what the tasks report would grow with the square of the input
    wanted = {"spark.sql.shuffle.partitions": str(min(shuffle_parts(spark), how.stores)),
              "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        query = (deltas.writeStream.format("parquet").option("path", f"{folder}/deltas").option("checkpointLocation", f"{folder}/state")
                 .outputMode("append").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if files and rows:
        signed = spark.read.schema(DELTAS).parquet(f"{folder}/deltas")
    else:
        signed = spark.createDataFrame([], DELTAS)
    out = settled(signed.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0"))
    remove_folder(spark, folder)
    return out


def every_order(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters.

    A part's counters, at most 128, meet in one row; its 600 steps read them there.
    """
    steps = [(order, i + 1, letter, BIT[letter], sum(BIT[x] for x in order[:i]))
             for order in map("".join, itertools.permutations(LETTERS)) for i, letter in enumerate(order)]
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(x).alias("filter"),
                                F.lit(b).alias("bit"), F.lit(p).alias("prior")) for o, s, x, b, p in steps])
    held = (counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
            .select("part", "counts", F.explode(listed).alias("s")).select("part", "counts", "s.*"))

    def total(condition) -> F.Column:
        return F.aggregate(F.filter("counts", condition), F.lit(0).cast("long"), lambda a, c: a + c["n"])

    bit, prior = F.col("bit"), F.col("prior")
    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    alive = lambda c: c["mask"].bitwiseAND(prior) == 0
    rows = held.select(
        "part", "filter_order", "step", "filter",
        total(lambda c: alive(c) & ~fails(c)).alias("kept"),
        total(lambda c: alive(c) & fails(c)).alias("removed"),
        total(lambda c: ~alive(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"),
        total(lambda c: alive(c) & fails(c) & (c["good"] == 1)).alias("good_lost"),
        total(lambda c: alive(c) & fails(c) & (c["toxic"] == 1)).alias("toxic_lost"))
    # a window over 120 rows per part and filter
    return (rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
            .drop("filter"))


def audited(spark: SparkSession, docs_path: str, labels: DataFrame, how: Audit = Audit()) -> DataFrame:
    """The audit of the documents (doc_id, text, lang) under ``docs_path``, with ``labels`` (doc_id, quality, toxic)."""
    return every_order(counters(spark, docs_path, labels, how))


#: DuckDB SQL of the query.
ORACLE = r"""
WITH facts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), bits AS (
  SELECT part, doc_id, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(least < doc_id, false) AS e FROM facts
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM bits LEFT JOIN marks USING (doc_id) GROUP BY ALL
), one AS (SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS ord FROM one p, one q, one r, one s, one t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), steps AS (
  SELECT ord, list_aggregate(list_transform(ord, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, i AS step, ord[i] AS f, ord[:i - 1] AS prior FROM orders, one
), judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS hit,
         len(list_filter(prior, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (hit AND alone), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND hit AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND toxic = 1), 0) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
"""
