"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns the columns of ``documents``, but for the last, which returns the packed
sequences. ``run`` writes each stage's rows to the shared checkpoint folder and reads
them back for the next, so a lost executor costs at most the stage at hand; a stage's
folder goes once the next one is written.

For every stage: null or empty texts are texts without words (quality rules reject them,
the other stages keep them); rows without an id are kept apart from each other; repeated
rows are judged each, but the Jaccard join keeps one of rows equal in id and text; an empty
table gives an empty table; further columns pass through whatever their names; texts of any
length are read whole. The operators' docstrings say more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bin_packing, host_rules, jaccard_join, secret_forest, systematic_mix
from tillroll.llm.common import remove_folder, table
from tillroll.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host surely fails them, go."""
    return host_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, Jaccard 0.8) the least doc_id stays."""
    return jaccard_join.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are masked, and n_chars follows the text."""
    return secret_forest.masked_documents(docs, count="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target weight asks: zero to three times."""
    return systematic_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, with the documents' spans in them."""
    return bin_packing.sequences(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("packing", packing),
]

#: The forest and the packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
