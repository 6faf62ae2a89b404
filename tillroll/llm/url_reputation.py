"""URL filter: listed rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes (1: bad) are counted per host. Each level is shrunk towards the
one above through a beta-binomial prior: suffix towards the whole table, registered
domain towards its suffix, host towards its domain, with prior strengths fitted to the
spread of the level's rates. A url is blocked if its host's lower posterior bound exceeds
the bar: ``lift`` times the rate of bad pages in the whole table (with half a bad page more,
so that a table without any has a bar), at most ``max_bad``.

Outcomes are a parameter, so reviewed labels can be given. Without any, ``listed_outcome``
takes them from the urls: a page is bad if a run of letters in its url is one of
``BAD_WORDS``. A host is then judged by all its pages, so that one page with such a word
does not block a host, and pages without one fall with a bad host.

The suffix is the host's last label and the registered domain its last two (no list of
public suffixes is used); a host that ends in a digit, an address, is its own domain.

Defined results: a url that is null or has no ``://`` has an empty host and path, no
rule and no reputation, and is allowed. Pages without an outcome count for nothing.
Repeated rows count and are judged each; an empty table gives an empty result. Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beta_prior, rate_sums, settled

#: Words of urls that label a page as bad.
BAD_WORDS = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "escort", "gambling", "lottery", "pills", "poker",
             "porn", "replica", "sex", "spam", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class Reputation:
    """A host is blocked when its rate of bad pages surely exceeds ``lift`` times the table's, or ``max_bad``."""

    lift: float = 5.0
    max_bad: float = 0.5
    deviations: float = 2.0


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a url column; only A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.coalesce(F.translate(host, letters, letters.lower()), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def rule_for(host, path, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    ``rules`` is a list of (verdict, host/path-prefix), a setting of a few entries: it
    becomes one CASE expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = name.partition("/")
        fits = (((host == rule_host) | F.endswith(host, F.lit("." + rule_host)))
                & F.startswith(path, F.lit(slash + rest)))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def listed_outcome(url, words: tuple[str, ...] = BAD_WORDS) -> F.Column:
    """1 where a run of letters in the url is a listed word, else 0; a null url has no outcome."""
    return F.lower(url).rlike(f"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)").cast("long")


def host_reputation(outcomes: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """(host, host_pages, host_bad, host_blocked) from rows (host, bad) with a non-empty host and an outcome.

    One shuffle of pre-aggregated hosts; domains and suffixes are summed from those. Five
    sums per level reach the driver, to fit the prior strengths.
    """
    hosts = settled(outcomes.where((F.col("host") != "") & F.col("bad").isNotNull()).groupBy("host")
                    .agg(F.count("*").alias("n"), F.sum("bad").alias("y"))
                    .withColumn("domain", F.when(F.col("host").rlike("[0-9]$"), F.col("host"))
                                .otherwise(F.substring_index("host", ".", -2)))
                    .withColumn("suffix", F.substring_index("domain", ".", -1)))
    domains = settled(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    sums = rate_sums(suffixes)
    bar = min(how.max_bad, how.lift * ((sums[2] or 0) + 0.5) / ((sums[1] or 0) + 1.0))
    a, b = beta_prior(*sums)
    strength = {name: sum(beta_prior(*rate_sums(level))) for name, level in (("domain", domains), ("host", hosts))}

    def shrunk(level, parent, name):
        return (F.col("y") + F.col(parent) * strength[name]) / (F.col("n") + F.lit(strength[name]))

    suffixes = suffixes.select("suffix", ((F.col("y") + a) / (F.col("n") + (a + b))).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(domains, "suffix_rate", "domain").alias("domain_rate"))
    rate, weight = F.col("host_rate"), F.col("n") + F.lit(strength["host"])
    return (hosts.join(domains, "domain").withColumn("host_rate", shrunk(hosts, "domain_rate", "host"))
            .withColumn("host_blocked", rate - how.deviations * F.sqrt(rate * (1 - rate) / (weight + 1)) > F.lit(bar))
            .select("host", F.col("n").alias("host_pages"), F.col("y").alias("host_bad"), "host_blocked"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], outcome, how: Reputation = Reputation(),
           page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: host, path, rule and verdict. ``outcome``: a 0/1/null column of ``pages``."""
    host, path = split_url(F.col(url))
    named = settled(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), outcome.alias("bad")))
    known = host_reputation(named, how).select(F.col("host").alias("__host"), "host_pages", "host_bad", "host_blocked")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("host_blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return (named.join(known, F.col("host") == F.col("__host"), "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"),
                    "host_pages", "host_bad"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]

_STRENGTH = """
  SELECT CASE WHEN k > 1 AND nn - sq / nn - (k - 1) > 0 THEN
           CASE WHEN over <= 0 THEN 1e6 ELSE least(1e6, greatest(2.0, 1.0 / over - 1.0)) END ELSE 2.0 END AS s, p
  FROM (SELECT *, CASE WHEN nn - sq / nn - (k - 1) > 0 THEN
          (r - 2 * p * yy + p * p * nn - p * (1 - p) * (k - 1)) / (p * (1 - p) * (nn - sq / nn - (k - 1))) END AS over
        FROM (SELECT count(*) AS k, sum(n) AS nn, sum(y) AS yy, (sum(y) + 0.5) / (sum(n) + 1.0) AS p,
                     sum(CAST(n AS DOUBLE) * n) AS sq, sum(CAST(y AS DOUBLE) * y / n) AS r FROM {0}))
"""

#: DuckDB SQL of the query.
ORACLE = rf"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path, url FROM rest
), marked AS (
  SELECT page_id, host, path, CAST(regexp_matches(lower(url), '(^|[^a-z])({'|'.join(BAD_WORDS)})([^a-z]|$)') AS BIGINT) AS bad FROM named
), h AS (
  SELECT host, count(*) AS n, sum(bad) AS y,
         CASE WHEN regexp_matches(host, '[0-9]$') THEN host
              ELSE regexp_extract(host, '[^.]*(\.[^.]*)?$') END AS domain
  FROM marked WHERE host <> '' AND bad IS NOT NULL GROUP BY host
), d AS (
  SELECT domain, regexp_extract(domain, '[^.]*$') AS suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL
), s AS (
  SELECT suffix, sum(n) AS n, sum(y) AS y FROM d GROUP BY suffix
), ks AS ({_STRENGTH.format('s')}), kd AS ({_STRENGTH.format('d')}), kh AS ({_STRENGTH.format('h')}
), sr AS (
  SELECT suffix, (y + ks.p * ks.s) / (n + ks.s) AS m FROM s, ks
), dr AS (
  SELECT domain, (d.y + sr.m * kd.s) / (d.n + kd.s) AS m FROM d JOIN sr USING (suffix), kd
), hr AS (
  SELECT host, n, y, (h.y + dr.m * kh.s) / (h.n + kh.s) AS m, n + kh.s AS w FROM h JOIN dr USING (domain), kh
), verdicts AS (
  SELECT host, n, y, m - 2.0 * sqrt(m * (1 - m) / (w + 1)) > (SELECT least(0.5, 5.0 * (sum(y) + 0.5) / (sum(n) + 1.0)) FROM s) AS blocked FROM hr
), rules(says, rule, rh, rp) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM marked JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, coalesce(marked.host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(says, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS host_pages, CAST(y AS BIGINT) AS host_bad
FROM marked LEFT JOIN verdicts USING (host) LEFT JOIN best USING (page_id)
"""
