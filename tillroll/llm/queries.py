"""Registered queries of the training-data operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

from . import bin_packing, ecoc_language, filter_audit, host_rules, importance_draw, jaccard_join, metric_join, phrase_dedup, secret_forest, systematic_mix, toxicity_gru, url_reputation, warc
from .common import settled, table


def op1_bin_packing(spark, sf_dir):
    return bin_packing.packed(table(spark, sf_dir, "documents"))


def op2_metric_join(spark, sf_dir):
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judged(pages, url_reputation.RULES, url_reputation.listed_outcome(pages["url"]))


def op4_ecoc_language(spark, sf_dir):
    return ecoc_language.identified(table(spark, sf_dir, "documents"))


def op5_secret_forest(spark, sf_dir):
    found = secret_forest.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"),
                        "probability", "is_secret")


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_systematic_mix(spark, sf_dir):
    return systematic_mix.mixed(table(spark, sf_dir, "documents"))


def op8_phrase_dedup(spark, sf_dir):
    return phrase_dedup.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("spans")


def op9_warc_assembly(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = settled(warc.round_trip(table(spark, sf_dir, "pages"), path))
    warc.remove_archives(spark, path)
    return rows


def op10_host_rules(spark, sf_dir):
    return host_rules.judged(table(spark, sf_dir, "documents"))


def op11_importance_draw(spark, sf_dir):
    rows = importance_draw.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audited(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_toxicity_gru(spark, sf_dir):
    return toxicity_gru.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LLM_QUERIES = {
    "op1_bin_packing": op1_bin_packing,
    "op2_metric_join": op2_metric_join,
    "op3_url_reputation": op3_url_reputation,
    "op4_ecoc_language": op4_ecoc_language,
    "op5_secret_forest": op5_secret_forest,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_warc_assembly": op9_warc_assembly,
    "op10_host_rules": op10_host_rules,
    "op11_importance_draw": op11_importance_draw,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity_gru": op13_toxicity_gru,
}

LLM_ORACLE_SQL = {
    "op2_metric_join": metric_join.ORACLE,
    "op3_url_reputation": url_reputation.ORACLE,
    "op7_systematic_mix": systematic_mix.ORACLE,
    "op9_warc_assembly": warc.ORACLE,
    "op10_host_rules": host_rules.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
