"""The filter audit against every order applied document by document."""

import itertools
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillroll.llm import filter_audit
from tillroll.llm.filter_audit import Audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 200_000 + "tail"


def fails(text):
    words = WORD.findall(text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def restated(rows, labels):
    docs = []
    for doc_id, text, lang in rows:
        failed = fails(text or "")
        failed["E"] = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in rows)
        docs.append((doc_id, lang or "", failed))
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    out = {}
    shapley = defaultdict(int)
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[1][letter]]
                left_ids = {id(d) for d in left}
                earlier = sum(d[1][letter] for d in own if id(d) not in left_ids)
                left = [d for d in left if not d[1][letter]]
                alone = sum(d[1][letter] and sum(d[1].values()) == 1 for d in own)
                shapley[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), earlier, alone, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def corpus():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") * rng.randrange(1, 40) for _ in range(rng.choice([3, 120]))) + rng.choice(["", " #", " SHOUT" * 9]) for _ in range(9)]
    texts += [" ".join(f"w{i}" for i in range(150)), None, "", "  x\x1fy", LONG]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (7, texts[1], "en"), (7, texts[1], "de"), (7, texts[1], "de"), (900, LONG, "fr"), (901, LONG, "fr")]
    big = 2**60 + 1
    rows += [(big, "big", "en"), (big + 1, "big", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 100, 2)] + [(4, 1, 1), (None, 1, 1), (big + 1, 1, 1)]
    return rows, labels


def given(spark, folder, rows, files=1):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("part", "mask", "key", "n", "open", "cell", "salt", "good")})
    for k in range(files):                                   # later files hold the smaller ids
        df.where(F.expr(f"pmod(-coalesce(doc_id, 0) div 3, {files}) = {k}")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def answered(spark, path, labels, how):
    rows = filter_audit.audited(spark, path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), how).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


@pytest.mark.parametrize("files, batches, cell", [(1, 4, 16), (5, 5, 1), (4, 2, 1000)])
def test_all_orders_equal_the_restatement(spark, tmp_path, files, batches, cell):
    rows, labels = corpus()
    rows = rows if files == 1 else rows[::-1]
    path = given(spark, str(tmp_path / "docs.parquet"), rows, files)
    assert answered(spark, path, labels, Audit(batches=batches, cell_texts=cell)) == restated(rows, labels)


def test_a_smaller_id_in_a_later_micro_batch_is_retracted(spark, tmp_path):
    path = str(tmp_path / "docs")
    for ids in ([9, 12], [5], [3, 30]):
        spark.createDataFrame([(i, "same", f"l{i}") for i in ids], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.counters(spark, path, labels, Audit(batches=3)).collect()
    a, e = filter_audit.BIT["A"], filter_audit.BIT["E"]
    assert {(r.part, r.mask, r.good, r.n) for r in got} == {("l3", a, 0, 1), ("l5", a | e, 0, 1), ("l9", a | e, 1, 1), ("l12", a | e, 0, 1), ("l30", a | e, 0, 1)}


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    path = given(spark, str(tmp_path / "none"), corpus()[0][:3])
    spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / "empty"))
    assert answered(spark, str(tmp_path / "empty"), [(1, 1, 1)], Audit()) == {}
    assert len(answered(spark, path, [], Audit())) == 600 * len({r[2] or "" for r in corpus()[0][:3]})


def test_labels_are_never_broadcast(spark, tmp_path):
    docs = spark.read.parquet(given(spark, str(tmp_path / "docs"), corpus()[0][:9]))
    spark.range(1000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels"))
    joined = filter_audit.with_labels(filter_audit.masked(docs), spark.read.parquet(str(tmp_path / "labels")), Audit())
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_without_an_id_get_no_label(spark):
    rows = [(0, False, "en", bytes([i]), 1) for i in range(100)] + [(0, True, "en", bytes([i]), 1) for i in range(100)]
    labels = spark.createDataFrame([(0, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    joined = filter_audit.with_labels(spark.createDataFrame(rows, "doc_id long, known boolean, part string, key binary, mask int"), labels, Audit())
    assert {(r.known, r.good, r.toxic, r.n) for r in joined.groupBy("known", "good", "toxic").agg(F.count("*").alias("n")).collect()} == {(False, 0, 0, 100), (True, 1, 1, 100)}


def test_state_has_a_bounded_number_of_partitions(spark, tmp_path, monkeypatch):
    rows, labels = corpus()
    path = given(spark, str(tmp_path / "docs.parquet"), rows, 4)
    before, stores = spark.conf.get("spark.sql.shuffle.partitions"), []
    monkeypatch.setattr(filter_audit, "remove_folder", lambda _, folder: stores.extend(p.name for p in Path(folder.removeprefix("file:")).glob("state/state/0/[0-9]*")))
    assert answered(spark, path, labels, Audit(stores=3)) == restated(rows, labels)
    assert sorted(stores) == ["0", "1", "2"] and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_settled_rows_do_not_all_follow_a_frequent_text(spark):
    rows = [(i, True, f"l{i % 5}", b"hot", 1, 0, 0) for i in range(50)] + [(100 + i, True, "", bytes([i]), 1, 0, 0) for i in range(5)]
    got = filter_audit.combined(spark.createDataFrame(rows, "doc_id long, known boolean, part string, key binary, mask int, good int, toxic int").coalesce(1)).collect()
    settled = [r for r in got if not r.open]
    assert sum(r.n for r in settled) == 49 and {r["mask"] for r in settled} == {1 | filter_audit.BIT["E"]}
    assert len({bytes(r.key) for r in settled}) == 5
