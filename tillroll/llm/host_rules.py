"""Quality rules by host: page-level rule failures, shrunk per host, applied to its documents.

Native: DataFrame expressions only. The rules of one document are evaluated inside its
row (no shuffle of words or windows); failures are then summed per host, each host's
failure rate is shrunk through a beta prior fitted to all hosts by the method of
moments, and a host whose lower posterior bound stays above ``max_rate`` takes its
documents with it.

Defined results: a null or empty text has no words and fails (fewer than ten words). A
null host is no host: its documents are judged by their own rules alone. Repeated rows
are judged and counted each. An empty table gives an empty result. Only the named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, beta_prior, let, rate_sums, settled

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: rejected hosts that are broadcast, at most; some megabytes
BROADCAST_HOSTS = 50_000


@dataclass(frozen=True)
class HostRules:
    """Rules of a document and the bar for its host."""

    min_words: int = 10
    max_repeat_pct: int = 20
    #: a host is rejected when its failure rate surely exceeds this ...
    max_rate: float = 0.5
    #: ... with the posterior mean this many posterior deviations above it
    deviations: float = 2.0


def _words(text):
    return F.filter(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " ", -1), lambda w: w != "")


def _repeat_words(words, n):
    """Words inside five-word windows that occur twice or more; n is a long column.

    Windows are compared by 64-bit hashes. Most texts repeat none, which a hash set tells;
    in the others the hashes are sorted with their positions, equal neighbours mark both
    positions, and the union of [p, p+5) over the marked positions is summed.
    """
    def windows(ws):
        return F.transform(F.sequence(F.lit(0), n.cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + o) for o in range(WINDOW)]))


    def marked(s):
        return F.filter(F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull())

    def covered(hs):
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            F.sort_array(let(placed, marked)), start,
            lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")),
            lambda a: a["total"])

    found = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0)))
    return F.when(n >= WINDOW, found).otherwise(F.lit(0)).cast("long")


def _stripped(text, chars):
    return F.translate(text, chars, "")


def _counted(text):
    """Struct of n_words and n_repeat_words; the words are split once."""
    def count(words):
        n = F.size(words).cast("long")
        return F.struct(n.alias("n_words"), _repeat_words(words, n).alias("n_repeat_words"))

    return let(_words(F.coalesce(text, F.lit(""))), count)


def _fails(counts, rules: HostRules):
    return ((counts["n_words"] < rules.min_words)
            | (100 * counts["n_repeat_words"] > rules.max_repeat_pct * counts["n_words"]))


def failed(text, rules: HostRules) -> F.Column:
    """Whether a text fails, as one expression: however the optimizer moves it, it is evaluated once."""
    return let(_counted(text), lambda counts: _fails(counts, rules))


def measured(docs: DataFrame, rules: HostRules, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns plus the counts of the rules and ``base_failed``."""
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"), _counted(F.col(text)).alias("__counts"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(_stripped(x, BLANKS)) > 0)
    return (df.withColumn("n_words", F.col("__counts")["n_words"])
            .withColumn("n_repeat_words", F.col("__counts")["n_repeat_words"])
            .withColumn("word_chars", F.length(_stripped(F.col("__text"), BLANKS)).cast("long"))
            .withColumn("n_symbols", (F.length("__text") - F.length(_stripped(F.col("__text"), SYMBOLS))).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("base_failed", _fails(F.col("__counts"), rules)).drop("__text", "__counts"))


def host_verdicts(scored: DataFrame, rules: HostRules, host: str) -> DataFrame:
    """One row per non-null host: documents, failures, shrunk rate, and whether it is rejected.

    The prior's mean is the overall rate p and its strength follows from the spread of
    the hosts' rates beyond what binomial noise explains. Four sums over all hosts reach
    the driver, nothing else.
    """
    hosts = (scored.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host"))
             .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")))
    a, b = beta_prior(*rate_sums(hosts, "host_docs", "host_failed"))
    n, y = F.col("host_docs"), F.col("host_failed")
    mean = (y + F.lit(a)) / (n + F.lit(a + b))
    return (hosts.withColumn("host_rate", mean)
            .withColumn("host_low", mean - rules.deviations * F.sqrt(mean * (1 - mean) / (n + F.lit(a + b + 1))))
            .withColumn("host_rejected", F.col("host_low") > rules.max_rate))


def judged(docs: DataFrame, rules: HostRules = HostRules(), doc_id: str = "doc_id", host: str = "source",
           text: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed``, its host's figures and ``kept``."""
    scored = settled(measured(docs, rules, [F.col(doc_id).alias("doc_id"), F.col(host).alias("__host")], text))
    verdicts = host_verdicts(scored, rules, "__host")
    return (scored.join(verdicts, "__host", "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "host_docs", "host_failed"))


def kept_documents(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns.

    The rules are evaluated inside the rows. The rejected hosts are counted: up to
    ``BROADCAST_HOSTS`` of them are broadcast, and no text is shuffled; more of them meet
    the documents in a join that adaptive execution may split.
    """
    fails = failed(F.col(text), rules)
    bad = settled(host_verdicts(docs.select(F.col(host).alias("__host"), fails.alias("base_failed")), rules, "__host")
                  .where("host_rejected").select(F.col("__host").alias("__bad_host")))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    passed = docs.where(~fails).select(F.struct(*docs.columns).alias("__row"), F.col(host).alias("__host"))
    return passed.join(F.broadcast(bad) if few else bad, F.col("__host") == F.col("__bad_host"), "left_anti").select("__row.*")


#: DuckDB SQL of the query; lists of words and windows stay inside each row.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), win AS (
  SELECT doc_id, i, word,
         lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2, lead(word, 3) OVER p AS w3, lead(word, 4) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4) AS c FROM win WHERE w4 IS NOT NULL
  ) WHERE c >= 2
), spread AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(0, 5) AS r(o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
  ) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN spread USING (doc_id)
), judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS y FROM judged WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT count(*) AS k, sum(n) AS nn, sum(y) AS yy, (sum(y) + 0.5) / (sum(n) + 1.0) AS p,
         sum(CAST(n AS DOUBLE) * n) AS sq, sum(CAST(y AS DOUBLE) * y / n) AS r FROM hosts
), over AS (
  SELECT p, CASE WHEN k > 1 AND nn - sq / nn - (k - 1) > 0
    THEN (r - 2 * p * yy + p * p * nn - p * (1 - p) * (k - 1)) / (p * (1 - p) * (nn - sq / nn - (k - 1))) END AS rho FROM sums
), prior AS (
  SELECT p, CASE WHEN rho IS NULL THEN 2.0 WHEN rho <= 0 THEN 1e6 ELSE least(1e6, greatest(2.0, 1.0 / rho - 1.0)) END AS s FROM over
), post AS (
  SELECT source, n, y, s, (y + p * s) / (n + s) AS m FROM hosts, prior
), verdict AS (
  SELECT source, n, y, m - 2.0 * sqrt(m * (1 - m) / (n + s + 1)) > 0.5 AS rejected FROM post
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(rejected, FALSE)) AS kept,
       CAST(n AS BIGINT) AS host_docs, CAST(y AS BIGINT) AS host_failed
FROM judged LEFT JOIN verdict USING (source)
"""
