"""The importance draw against a plain restatement with the whole features' own CRCs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import importance_draw
from tillroll.llm.importance_draw import Draw

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, run=3):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def restated(docs, target, how):
    docs = [(i, *features(t)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % how.buckets
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ns + how.buckets) / ((s[b] + 1.0) * (nt + how.buckets)))) for b in range(how.buckets)]
    out = []
    for i, n, fs in docs:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= how.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(able[:how.percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdéßñ漢Ž09") for _ in range(rng.choice([1, 2, 3, 5, 70])))
    vocabulary = [word() for _ in range(120)]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", ", ", "-", "_", "\x7f", "\t."]) for _ in range(rng.randrange(60)))
             for _ in range(80)]
    texts += [None, "", " .,! ", "A", "a B", texts[0].upper(), "x" * 300_000, "w " * 5000, "\ud800 lone".encode("utf-8", "replace").decode()]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, texts[4]), (5, texts[5]), (5, texts[6]), (5, texts[5])]
    return rows, texts[10:14] + [None, "ß ß ß ß"]


@pytest.fixture(scope="module")
def frames(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    docs = docs.withColumns({c: F.lit(c) for c in ("rank", "score", "weight", "place", "__part", "text_hash")})
    return docs, spark.createDataFrame([(x,) for x in target], "text string"), rows, target


@pytest.mark.parametrize("how", [Draw(percent=40), Draw(percent=40, dictionary=7, slice=64), Draw(percent=100, dictionary=0, slice=1, buckets=13)])
def test_rows_equal_the_restatement(frames, how):
    docs, target, rows, texts = frames
    got = importance_draw.drawn(docs, target, how).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == restated(rows, texts, how)


def test_joined_crcs_of_any_length():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(n)) for n in [0, 1, 63, 64, 65, 127, 128, 1000, 70_000, 1 << 20]]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], dtype=np.uint32) for k in (0, 1))
    got = importance_draw.crc_joined(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_drawn_documents_keep_their_columns(frames):
    docs, target, _, _ = frames
    how = Draw(percent=40)
    want = {(r.doc_id, r.text_hash) for r in importance_draw.drawn(docs, target, how).where("rank IS NOT NULL").collect()}
    out = importance_draw.drawn_documents(docs, target, how)
    assert out.columns == docs.columns
    assert {(r[0], r[1]) for r in out.select("doc_id", F.xxhash64("text")).collect()} == want


def test_empty_tables(frames):
    docs, target, _, _ = frames
    assert importance_draw.drawn(docs.limit(0), target).collect() == []
    assert len(importance_draw.drawn(docs, target.limit(0)).collect()) == docs.count()
    assert importance_draw.drawn(docs.limit(0), target.limit(0)).collect() == []
