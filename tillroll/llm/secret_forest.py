"""Secret scan: candidate strings, and a random forest that removes the false positives.

Native: DataFrame expressions and Spark's own random forest; no Python runs on the
executors. A candidate is the value assigned to a secret's name (what stands in quotes, or
a run without blanks, of any length), or a run of at least twelve key characters with a
digit in it. Of an unquoted value closing punctuation is no part.
The text is split at its candidates, so their places and neighbours come from the pieces
without a join. Features are the candidate's length, its mix of and transitions between
character classes, how much of it the corpus's own frequent words cover, the path of the
document, and the words before and after it.

The forest is trained on labelled findings. By default these are the reviewed ones that
ship with the library (``reviewed_findings``: some thousand findings of known kinds, each
with its reviewer's verdict, which looks at no feature), and those of the corpus that are
certain by their own characters: issued key formats are secrets; bare numbers and
placeholders are not. Everything else, whatever stands before it, is left to the forest.
Another reviewed table with the same columns can be given. A finding that repeats counts
once; the corpus gives a bounded sample of each label, drawn by hash against a threshold
set by the label's count, the same at each run.

Defined results: a null or empty text has no candidates; a null path counts as a plain
one; repeated rows give repeated findings; with given findings of one kind only, every
candidate gets that kind (none: all stand). An empty table gives an empty result. Only the
named columns are read; text in any amount stays in its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import most_frequent, settled

CANDIDATE = r"(?<![A-Za-z0-9_/+\-])(?=[A-Za-z_/+\-]*[0-9])[A-Za-z0-9_/+\-]{12,}={0,2}"
BEFORE, AFTER = 60, 30

#: Names a secret is assigned to, words that introduce other strings, issued key formats.
SECRET_NAMES = "password|passwd|pwd|secret|token|api_?key|access_?key|auth|credential|private_?key"
OTHER_NAMES = "commit|checksum|sha1|sha256|md5|digest|isbn|order|invoice|phone|card|uuid|version|build|example|sample"
#: The value after a secret's name and = or :, the second source of candidates; no group is repeated, so long values need no stack.
LEAD = rf"(?:{SECRET_NAMES})[\"'`]?[ \t]{{0,3}}[=:]{{1,2}}[ \t]{{0,3}}"
ASSIGNED = ("(?<=[=: \\t\"'`])(?<=[=:][ \\t]{0,3}[\"'`]?)(?i:" + "|".join(rf"(?<={LEAD}{q})[^{q}\r\n]++(?={q})" for q in "\"'`")
            + rf"|(?<={LEAD}[\"'`]?)[^\s\"'`](?:\S*[^\s.,;\"'`)\]}}>])?)")
STRINGS = f"{ASSIGNED}|{CANDIDATE}"
#: What is assigned to a secret's name without being one.
PLACEHOLDER = (r"(?i)^(?:a|an|the|is|are|was|were|your|my|our|his|her|their|this|that|to|for|of|and|or|not|none|null|nil|true|false|yes|no|"
               r"required|optional|missing|invalid|expired|wrong|incorrect|empty|unknown|changeme|string|str|text|bytes|int|"
               r"\*+|x+|\.+|-+|<.*|\$[\{(].*|\{\{.*|%[({].*|[a-z_][a-z_.]*[\[(].*|(?:os|self|this|env|config|settings|process)\..*)$")
KEY_FORMATS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abpr]-[A-Za-z0-9\-]{10,}$|^AIza[A-Za-z0-9_\-]{35}$"


@dataclass(frozen=True)
class Forest:
    """Size of the forest, findings it learns from at most (of the corpus, and reviewed ones that ship with
    it), words of the dictionary at most, its seed, and the probability that makes a finding."""

    trees: int = 40
    depth: int = 8
    train_rows: int = 20_000
    reviewed_rows: int = 6000
    dictionary: int = 2000
    seed: int = 5
    stands: float = 0.5


FEATURES = ["length", "digits", "uppers", "lowers", "transitions", "variety", "dictionary", "padding", "path_depth",
            "path_test", "named", "assigned", "quoted", "other_name", "number_before", "number_after", "words_before"]


def split_text(text) -> tuple[F.Column, F.Column]:
    """(pieces, candidates) of a text: one more piece than candidates."""
    return F.split(text, STRINGS, -1), F.regexp_extract_all(text, F.lit(STRINGS), F.lit(0))


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, text_hash, nth, start (in characters), candidate, before, after, path."""
    pieces, found = split_text(F.col("text"))
    df = (docs.select("doc_id", F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
          .where(F.col("text").rlike(STRINGS))
          .select("doc_id", "path", F.xxhash64("text").alias("text_hash"), pieces.alias("pieces"), found.alias("found")))
    # what a candidate needs is taken out of its row before the rows are spread, so the text is not copied
    one = F.transform("found", lambda c, i: F.struct(
        i.alias("nth"), c.alias("candidate"), F.substring(F.get("pieces", i), -BEFORE, BEFORE).alias("before"),
        F.substring(F.get("pieces", i + 1), 1, AFTER).alias("after"),
        (F.length(F.get("pieces", i)) + F.coalesce(F.length(F.get("found", i - 1)), F.lit(0))).cast("long").alias("gap")))
    spread = df.select("doc_id", "path", "text_hash", F.explode(one).alias("c")).select("doc_id", "path", "text_hash", "c.*")
    # the lengths up to a candidate give its start; repeated rows are peers in the frame and are divided out
    same = Window.partitionBy("doc_id", "text_hash")
    start = F.sum("gap").over(same.orderBy("nth")) / F.count("*").over(Window.partitionBy("doc_id", "text_hash", "nth"))
    return spread.select("doc_id", "text_hash", "nth", start.cast("long").alias("start"), "candidate", "before", "after", "path")


def dictionary(docs: DataFrame, words: int, text: str = "text") -> list[str]:
    """The words of 4 to 12 letters found in most documents: at most ``words``, counted over all texts."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0))))
    return most_frequent(docs.select(found.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", words)


def prefix_pattern(words: list[str]) -> str:
    """A pattern of any of the words, longest first, with common beginnings written once."""
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def written(at: dict) -> str:
        parts = [letter + written(rest) for letter, rest in sorted(at.items()) if letter]
        inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return "" if not parts else f"(?:{inner})?" if "" in at else inner

    return written(tree) if words else "(?!)"


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds the FEATURES, all doubles, to candidates; ``words`` is the dictionary."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")

    def share(chars):
        return (F.length(F.regexp_replace(c, f"[^{chars}]", "")) / n).cast("double")

    def flag(condition):
        return F.coalesce(condition, F.lit(False)).cast("double")

    edges = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    lower, where = F.lower("before"), F.lower(F.coalesce("path", F.lit("")))
    covered = F.length(F.array_join(F.regexp_extract_all(F.lower(c), F.lit(prefix_pattern(words)), F.lit(0)), "")) / n
    values = {
        "length": n, "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"),
        "transitions": (F.regexp_count(c, F.lit(edges)) / n).cast("double"),
        "variety": (F.size(F.array_distinct(F.split(c, ""))) / n).cast("double"),
        "dictionary": covered.cast("double"), "padding": flag(F.endswith(c, F.lit("="))),
        "path_depth": F.regexp_count(where, F.lit("/")).cast("double"),
        "path_test": flag(where.rlike("test|example|sample|fixture|mock|doc")),
        "named": flag(lower.rlike(f"({SECRET_NAMES})[^a-z]*$")),
        "assigned": flag(lower.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(lower.rlike("[\"'`]$")),
        "other_name": flag(lower.rlike(f"\\b({OTHER_NAMES})\\b[^a-z]*$")),
        "number_before": flag(lower.rlike(r"[0-9]\W*$")),
        "number_after": flag(F.col("after").rlike(r"^\W*[0-9]")),
        "words_before": F.regexp_count(lower, F.lit(r"\S+")).cast("double"),
    }
    return found.withColumns(values)


def certain(found: DataFrame) -> DataFrame:
    """Candidates with features and a ``label`` (1: secret, 0: not) where the characters alone are certain."""
    c = F.col("candidate")
    label = F.when(c.rlike(KEY_FORMATS), 1.0).when(c.rlike("^[0-9_/+\\-]+$") | c.rlike(PLACEHOLDER), 0.0)
    return found.withColumn("label", label).where("label IS NOT NULL")


# Kinds of findings with the reviewer's verdict and the paths they are seen in.
# {..} stands for random characters of a kind, or a word, so that no two findings are equal.
PLAIN, CODE, TESTS = ["", "notes", "mail"], ["src/app/main.py", "deploy/prod/settings.yml", "repo/lib/client.js"], ["repo/tests/test_api.py", "docs/example/readme.md", "sample/fixture.json"]
KINDS = [
    ('{w} {name} = "{hex40}" {w} {w}', 1.0, PLAIN + CODE + TESTS), ("{w} {w} {name}={hex18} {w}", 1.0, PLAIN + CODE), ('{name}: "{hex32}"', 1.0, CODE),
    ("export {name}={mixed}", 1.0, CODE), ("'{name}': '{mixed}', '{w}': 1", 1.0, CODE), ("{w} bearer {mixed} {w}", 1.0, PLAIN + CODE),
    ('{name} = "{b64}"', 1.0, CODE + PLAIN), ("{w} the {name}: {pass} {w} {w}", 1.0, PLAIN), ('{name} = "{pass}"', 1.0, CODE + PLAIN),
    ("login {name}={w}-{w}-{w} now", 1.0, PLAIN), ("{name} = '{pass}{mixed}'", 1.0, CODE), ('{w} {w} {name} = "{w}{hex4}" {w}', 1.0, PLAIN + CODE), ("{name}: {w}{digits4} {w}", 1.0, PLAIN + CODE), ('{name}="{w}{digits4}!" {w}', 1.0, PLAIN + CODE),
    ("{w} commit {hex40} {w}", 0.0, PLAIN + CODE), ("sha256 {hex40} {w}.tar", 0.0, CODE), ("{w} md5 checksum {hex32} {w}", 0.0, PLAIN + CODE), ('etag: "{hex32}"', 0.0, CODE),
    ("digest={hex40} {w}", 0.0, CODE), ("uuid {hex8}-{hex4}-{hex4}-{hex12} {w}", 0.0, PLAIN + CODE), ("version {w}_{w}_{digits4}", 0.0, CODE + TESTS),
    ("{w} card {digits16} {w}", 0.0, PLAIN), ("{w} order {digits16} {w}", 0.0, PLAIN), ("{w} {digits16} {w} {w}", 0.0, PLAIN), ("see {w}_{w}_{w}_{digits4} {w}", 0.0, PLAIN + CODE),
    ("def {w}_{w}_{w}{digits4}(x):", 0.0, CODE + TESTS), ("{w} {W}{W}{W}{digits4} {w}", 0.0, CODE), ("/usr/{w}/{w}/{w}{digits4} {w}", 0.0, CODE + PLAIN),
    ("{name}: is required {w}", 0.0, PLAIN), ("the {name}: {w} {w}", 0.0, PLAIN), ("{name} = ${NAME}", 0.0, CODE), ("{name} = get_{w}({digits4})", 0.0, CODE), ("{name}: null, {w}", 0.0, CODE),
    ('{name} = "{w}"', 0.0, TESTS), ('{name} = "{w}-{w}"', 0.0, TESTS), ('{name} = "test{digits4}"', 0.0, TESTS), ('password = "changeme"', 0.0, CODE + TESTS),
    ("image {b64} 12 {w}", 0.0, CODE + TESTS), ("{digits4} {hex40} {digits4} {w}", 0.0, PLAIN + CODE),
    ("{w} {digits4} {mixed} {w}", 0.0, PLAIN), ("row {digits4} {hex32} {w}", 0.0, PLAIN + CODE),
]
NAMES = ["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth", "client_secret", "private_key", "TOKEN", "API_KEY"]
WORDS = ["about", "account", "after", "build", "class", "client", "config", "content", "data", "default", "error", "example", "file", "function", "header", "image",
         "index", "list", "local", "message", "model", "name", "node", "object", "page", "parser", "query", "report", "request", "result", "server", "source",
         "string", "system", "table", "thread", "update", "value", "window", "worker", "correct", "horse", "battery", "summer", "winter"]


def reviewed_documents(spark: SparkSession, rows: int) -> DataFrame:
    """(doc_id, text, source, label): one reviewed finding per row, the kinds in turn."""
    def drawn(tag: str):
        return F.sha2(F.concat(F.lit(f"{tag}:"), F.col("doc_id").cast("string")), 256)

    def one_of(values, tag: str):
        values = values if isinstance(values, F.Column) else F.array(*[F.lit(v) for v in values])
        return F.element_at(values, (F.pmod(F.xxhash64(F.lit(tag), "doc_id"), F.size(values)) + 1).cast("int"))

    kinds = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(label).alias("label"), F.array(*[F.lit(p) for p in paths]).alias("paths")) for t, label, paths in KINDS])
    df = (spark.range(rows).withColumnRenamed("id", "doc_id")
          .withColumn("kind", F.element_at(kinds, (F.col("doc_id") % len(KINDS) + 1).cast("int"))))
    text, hexes = F.col("kind.text"), drawn("hex")
    mixed = F.regexp_replace(F.base64(F.unhex(drawn("mixed"))), "[+/=]", "x")
    digits = F.translate(F.regexp_replace(drawn("digits"), "^.", "7"), "abcdef", "135792")
    values = {"hex40": F.substring(hexes, 1, 40), "hex32": F.substring(hexes, 1, 32), "hex18": F.substring(hexes, 1, 18), "hex12": F.substring(hexes, 1, 12),
              "hex8": F.substring(hexes, 20, 8), "hex4": F.substring(hexes, 30, 4), "digits16": F.substring(digits, 1, 16), "digits4": F.substring(digits, 20, 4),
              "b64": F.base64(F.unhex(hexes)), "mixed": F.substring(mixed, 1, 24),
              "pass": F.concat(F.initcap(one_of(WORDS, "pass")), F.substring(digits, 9, 2), F.substring(mixed, 30, 2), F.lit("!")),
              "name": one_of(NAMES, "name"), "NAME": F.upper(one_of(NAMES, "other"))}
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), value)
    for nth in range(4):                                     # each word of a text is another one
        text = F.regexp_replace(text, F.lit(r"^((?:(?!\{w\}).)*)\{w\}"), F.concat(F.lit("$1"), one_of(WORDS, f"w{nth}")))
        text = F.regexp_replace(text, F.lit(r"^((?:(?!\{W\}).)*)\{W\}"), F.concat(F.lit("$1"), F.initcap(one_of(WORDS, f"W{nth}"))))
    return df.select("doc_id", text.alias("text"), one_of(F.col("kind.paths"), "path").alias("source"), F.col("kind.label").alias("label"))


def reviewed_findings(spark: SparkSession, rows: int, words: list[str]) -> DataFrame:
    """The reviewed findings with their features and labels."""
    given = reviewed_documents(spark, rows).coalesce(1)
    labels = given.select(F.col("doc_id").alias("__reviewed"), "label")
    found = with_features(candidates(given), words)
    return found.join(labels, F.col("doc_id") == F.col("__reviewed")).drop("__reviewed")


def bounded_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the distinct labelled findings, half of each label as far as they go."""
    names = ["label", *FEATURES]
    once = settled(labelled.groupBy(F.xxhash64("candidate", "before").alias("__finding"))
                   .agg(*[F.min(c).alias(c) for c in names]))
    counts = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bar = F.lit(0)
    for label, n in counts.items():
        bar = F.when(F.col("label") == label, F.lit(min(1 << 40, (1 << 40) * (rows // 2) // n))).otherwise(bar)
    return once.where(F.pmod("__finding", F.lit(1 << 40)) < bar).select(*names)


def trained(findings: DataFrame, how: Forest = Forest()):
    """The fitted forest, or the constant probability when the labels are of one kind or none."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = settled(findings.select("label", *FEATURES).coalesce(1).sortWithinPartitions("label", *FEATURES))
    kinds = sorted(r[0] for r in sample.select("label").distinct().collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else 1.0
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("label", "features")
    return RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=how.seed, featureSubsetStrategy="sqrt").fit(rows)


def scored(found: DataFrame, model, how: Forest = Forest()) -> DataFrame:
    """Adds ``probability`` of a secret and ``is_secret``."""
    if isinstance(model, float):
        out = found.withColumn("probability", F.lit(model))
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        out = (model.transform(vectors).withColumn("__p", vector_to_array("probability")[1])
               .drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("__p", "probability"))
    return out.withColumn("is_secret", F.col("probability") >= how.stands)


def findings(docs: DataFrame, how: Forest = Forest(), text: str = "text", path: str = "source",
             reviewed: DataFrame | None = None) -> DataFrame:
    """Every candidate with its place, probability and verdict.

    ``reviewed`` (the FEATURES and a label) replaces the findings that the forest learns from;
    its dictionary should be that of ``docs``.
    """
    words = dictionary(docs, how.dictionary, text)
    found = settled(with_features(candidates(docs, text, path), words))
    if reviewed is None:
        known = sorted({*words, *WORDS})
        reviewed = (reviewed_findings(docs.sparkSession, how.reviewed_rows, known).select("label", *FEATURES)
                    .unionByName(bounded_sample(certain(found), how.train_rows)))
    model = trained(reviewed, how)
    return (scored(found, model, how)
            .select("doc_id", "text_hash", "nth", "start", F.length("candidate").cast("long").alias("length"),
                    "candidate", "probability", "is_secret"))


def masked_documents(docs: DataFrame, how: Forest = Forest(), mask: str = "[SECRET]", text: str = "text",
                     path: str = "source", count: str | None = None) -> DataFrame:
    """The documents with every secret in their text replaced by ``mask``; other columns and texts unchanged.

    ``count`` names a column, if there is one, to hold the new length of a changed text.
    Only texts with a candidate are shuffled, to meet their verdicts.
    """
    verdicts = (findings(docs, how, text, path).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "nth")
                .agg(F.max("is_secret").alias("secret")))
    bad = (verdicts.groupBy("__id", "__hash").agg(F.max("secret").alias("any"), F.collect_list(F.struct("nth", "secret")).alias("flags"))
           .where("any").select("__id", "__hash", F.sort_array("flags").alias("__bad")))
    some = F.coalesce(F.col(text).rlike(STRINGS), F.lit(False))
    rows = docs.where(some).select(F.struct(*docs.columns).alias("__all"), F.col(text).alias("__text"), F.col("doc_id").alias("__doc"),
                                   F.xxhash64(text).alias("__own"))
    pieces, found = split_text(F.col("__text"))
    joined = rows.join(bad, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    joined = joined.withColumn("__pieces", pieces).withColumn("__found", found)
    clean = F.array_join(F.transform("__pieces", lambda p, i: F.concat(
        F.when(i == 0, "").when(F.get("__bad", i - 1)["secret"], mask).otherwise(F.get("__found", i - 1)), p)), "")
    joined = joined.withColumn("__clean", F.when(F.col("__bad").isNull(), F.col("__text")).otherwise(clean))
    new = {text: F.col("__clean")}
    if count in docs.columns:
        kind = docs.schema[count].dataType
        new[count] = F.when(F.col("__bad").isNull(), F.col("__all")[count]).otherwise(F.length("__clean").cast(kind))
    changed = joined.select(*[new.get(c, F.col("__all")[c]).alias(c) for c in docs.columns])
    return docs.where(~some).unionByName(changed)
