"""Nulls, empty texts and tables, repeated rows, and columns with clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import (bin_packing, ecoc_language, host_rules, jaccard_join, metric_join, phrase_dedup, secret_forest,
                          systematic_mix, url_reputation, warc)

LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ROWS = [(1, "a plain text of some ten or eleven words stands right here", "en", "s0"), (2, None, "en", "s0"), (3, "", None, "s1"),
        (4, " \n\t ", "en", None), (5, LONG, None, "s1"), (None, "no id but words enough to be kept by the rules of it", "en", "s1"),
        (6, "same text with words enough to be kept by the rules of it", "en", "s2"), (6, "same text with words enough to be kept by the rules of it", "en", "s2"),
        (7, "token = \"0123456789abcdef0123456789abcdef01234567\" is in this text with a few more words", "en", "s0"), (8, "1234 5678", "de", "s0")]
CLASH = ["kept", "size", "copies", "class_id", "rep", "cell", "n_words", "host", "__host", "part", "label", "node", "nth", "text_hash", "place"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({c: F.lit(c) for c in CLASH})


def vectors(docs):
    return docs.select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") != 2, F.array(F.col("n_chars").cast("float"), F.lit(1.0).cast("float"))).alias("embedding"),
                       F.when(F.col("doc_id") != 3, 1).alias("label"), "kept", "rep", "cell", "part")


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://h/"), "lang").alias("url"), F.col("text").alias("html"),
                       "host", "kept", "size")


OPERATORS = {
    1: lambda d, p: bin_packing.packed(d),
    2: lambda d, p: metric_join.near_duplicates(vectors(d)),
    3: lambda d, p: url_reputation.judged(pages(d), url_reputation.RULES, url_reputation.listed_outcome(F.col("url"))),
    4: lambda d, p: ecoc_language.identified(d),
    5: lambda d, p: secret_forest.findings(d),
    6: lambda d, p: jaccard_join.near_duplicates(d),
    7: lambda d, p: systematic_mix.mixed(d),
    8: lambda d, p: phrase_dedup.deduplicated(d),
    9: lambda d, p: warc.round_trip(pages(d), p),
    10: lambda d, p: host_rules.judged(d),
}


@pytest.mark.parametrize("number", OPERATORS)
def test_odd_rows_are_all_answered(docs, number, tmp_path):
    rows = OPERATORS[number](docs, str(tmp_path / "w")).collect()
    assert len(rows) == {1: len(rows), 5: 1}.get(number, len(ROWS))
    if number == 1:
        assert sum(r.start == 0 for r in rows) == len(ROWS)


@pytest.mark.parametrize("number", OPERATORS)
def test_an_empty_table_gives_an_empty_result(docs, number, tmp_path):
    assert OPERATORS[number](docs.limit(0), str(tmp_path / "w")).collect() == []


def test_defined_answers(docs):
    lang = {r.doc_id: r for r in ecoc_language.identified(docs).collect()}
    assert all((lang[i].lang_pred, lang[i].score) == ("und", 0.0) for i in (2, 3, 4, 8)) and lang[5].lang_pred != "und"
    near = [r for r in jaccard_join.near_duplicates(docs).collect()]
    assert {(r.doc_id, r.class_id, r.kept) for r in near if r.doc_id in (None, 2, 6)} == {(None, None, True), (2, 2, True), (6, 6, True)}
    long = next(r for r in phrase_dedup.deduplicated(docs).collect() if r.doc_id == 5)
    assert long.n_bytes == len(LONG) and len(long.kept) == 39         # every window from the second period on occurs a period earlier
    mix = systematic_mix.mixed(docs).collect()
    assert {r.size for r in mix if r.doc_id in (2, 3, 4)} == {0} and {r.target for r in mix if r.source is None} == {0.0}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_the_columns(spark, docs, number):
    stage = corpus_pipeline.STAGES[number][1]
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, None)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
        got = out.collect()
        assert bool(got) == (rows is docs)


def test_stage_decisions(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    after = lambda name: sorted((r.doc_id or 0, r.text or "") for r in stages[name](spark, docs, None).collect())
    assert [i for i, _ in after("quality rules")] == [0, 1, 6, 6, 7]        # 5 repeats itself; the others have too few words
    assert [i for i, _ in after("n-gram Jaccard join")] == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    masked = dict(after("secret scans"))
    assert masked[7] == 'token = "[SECRET]" is in this text with a few more words' and masked[5] == LONG and len(after("secret scans")) == len(ROWS)
    n_chars = {r.doc_id: r.n_chars for r in stages["secret scans"](spark, docs, None).collect()}
    assert n_chars[7] == len(masked[7]) and n_chars[1] == 0


def test_pipeline_is_its_stages_in_order(spark, sf_small):
    from tillroll.llm import common
    rows = common.table(spark, sf_small, "documents")
    step = rows
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_small)
    want = sorted((r.sequence_id, r.n_tokens, r.spans) for r in step.collect())
    assert sorted((r.sequence_id, r.n_tokens, r.spans) for r in corpus_pipeline.run(spark, sf_small).collect()) == want
