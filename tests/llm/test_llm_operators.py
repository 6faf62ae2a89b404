"""Each operator against a plain restatement of its definition, on small tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import (bin_packing, common, ecoc_language, host_rules, jaccard_join, metric_join, phrase_dedup,
                          secret_forest, systematic_mix, url_reputation, warc)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_corpus():
    """Groups of exact and near copies, shared passages, short and empty texts."""
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = prose(rng, 60 + 10 * g).split()
        for c in range(1 + g % 5):
            words = list(base)
            for _ in range(c):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    passage = prose(rng, 40)
    rows += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    rows += [rows[0], rows[0], "one two", "one two", "one  two ", "one three", "", None, " \t\n"]
    return [(i, t, "en", f"s{i % 3}") for i, t in enumerate(rows)]


def shingles(text):
    w = WORDS.findall(text or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def linked_classes(ids, alike):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(ids, 0)
    for a, b in itertools.combinations(ids, 2):
        if alike(a, b):
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: find(i) for i in ids}, links


# --- 6 ----------------------------------------------------------------------

@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_is_the_brute_force_join(spark, block):
    rows = near_corpus()
    sets = {r[0]: shingles(r[1]) for r in rows}
    want, links = linked_classes(list(sets), lambda a, b: sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    got = jaccard_join.near_duplicates(docs_frame(spark, rows), jaccard_join.Join(block=block)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.kept) for r in got} == {i: (want[i], links[i], want[i] == i) for i in sets}


def test_rows_that_repeat_a_doc_id_keep_their_unique_texts(spark):
    rng = random.Random(12)
    a, b, c, x = (prose(rng, 80, 5000) for _ in range(4))
    near = lambda t, k: t + f" tail{k}"
    rows = [(1, a), (2, near(a, 1)), (2, b), (3, c), (4, x), (4, near(x, 2)), (5, near(b, 3)), (5, near(c, 4)), (6, x), (6, x), (7, ""), (7, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, own string")
    got = sorted(((r.doc_id or 0, r.text) for r in jaccard_join.distinct_documents(docs).collect()))
    four = min((x, near(x, 2)), key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    assert got == sorted([(1, a), (2, b), (3, c), (4, four), (7, ""), (0, a), (0, a)])


def test_bayes_test_needs_more_matches_as_it_goes():
    needed = jaccard_join.least_matches(jaccard_join.Join())
    assert [n for n, _ in needed] == [16, 32, 48, 64, 80, 96]
    assert all(a[1] <= b[1] <= b[0] for a, b in zip(needed, needed[1:]))
    # a true pair at the threshold fails somewhere with a small probability
    rng = np.random.default_rng(1)
    matches = np.cumsum(rng.random((20000, 96)) < 0.8, axis=1)
    assert np.mean([any(m[n - 1] < k for n, k in needed) for m in matches]) < 1e-3


def test_words_hashed_in_slices_are_the_same_words(monkeypatch):
    text = (" ".join(f"word{i % 57}" for i in range(4000)) + " é\tü\n").encode()
    whole = jaccard_join.word_hashes(text)
    monkeypatch.setattr(jaccard_join, "SLICE", 512)
    assert len(whole) == len(text.split()) and (jaccard_join.word_hashes(text) == whole).all()
    assert len(set(whole.tolist())) == len(set(text.split()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame(chain + star + [(300, 301), (301, 300), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), 5: 5, **dict.fromkeys(range(200, 260), 5), 300: 300, 301: 300}
    assert common.components(edges.limit(0)).count() == 0


# --- 8 ----------------------------------------------------------------------

def removed_by_definition(texts, length):
    seen, out = set(), {}
    for doc, text in sorted(texts.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                gone[p:p + length] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", [phrase_dedup.Passages(), phrase_dedup.Passages(crowd=1), phrase_dedup.Passages(slice=130),
                                 phrase_dedup.Passages(length=40, gram=12, crowd=2)])
def test_phrase_dedup_is_the_definition(spark, how):
    rng = random.Random(8)
    passages = [prose(rng, 30, 5000) for _ in range(5)]
    texts = {i: prose(rng, rng.randrange(1, 60), 5000) + " " + rng.choice(passages)[rng.randrange(30):] + " " + prose(rng, 25, 5000)
             for i in range(40)}
    texts |= {50: texts[3], 51: texts[3] * 3, 52: "ab" * 400, 53: "a" * 700, 54: "ü" * 90, 55: "", 56: None, 57: "short",
              58: passages[0] + "é" + passages[0], 59: "a" * 99}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = phrase_dedup.deduplicated(frame, how).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_by_definition(texts, how.length)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert bytes(r.kept) == phrase_dedup.kept_bytes(data, np.array([s.start for s in r.spans], int), np.array([s.end for s in r.spans], int))


def test_a_row_without_an_id_loses_its_own_repeats_alone(spark):
    rng = random.Random(9)
    one, other = prose(rng, 40, 5000), prose(rng, 40, 5000)
    rows = [(1, one), (None, one), (None, one + " x " + one + other + one), (None, "short"), (None, None)]
    got = phrase_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), phrase_dedup.Passages(length=40, gram=12)).collect()
    want = [(d, *removed_by_definition({0: t}, 40)[0]) for d, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(map(str, want))


def removed_from_rows(rows, length):
    """The definition for rows that may repeat a doc_id: a window goes if a smaller doc_id has it, or its own text earlier."""
    seen, out = set(), []
    for _, same in itertools.groupby(sorted(rows), lambda r: r[0]):
        here = set()
        for doc, text in same:
            data, own = text.encode(), set()
            gone = np.zeros(len(data), dtype=bool)
            for p in range(len(data) - length + 1):
                if data[p:p + length] in seen | own:
                    gone[p:p + length] = True
                own.add(data[p:p + length])
            here |= own
            out.append((doc, len(data), int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
        seen |= here
    return sorted(out)


@pytest.mark.parametrize("how", [phrase_dedup.Passages(length=40, gram=12), phrase_dedup.Passages(length=40, gram=12, crowd=1)])
def test_rows_that_repeat_a_doc_id_lose_only_what_an_earlier_document_has(spark, how):
    rng = random.Random(18)
    passages = [prose(rng, 20, 5000) for _ in range(3)]

    def text():
        return f"{prose(rng, rng.randrange(1, 12), 5000)} {rng.choice(passages)} {prose(rng, 9, 5000)}"

    rows = [(i, text()) for i in range(12)]
    rows += [rows[0], rows[0], rows[4]]                                      # equal rows, the first document's too
    rows += [(2, rows[2][1][:70]), (2, text()), (5, "x" * 30), (5, rows[5][1] + " " + rows[5][1]), (9, text())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in phrase_dedup.deduplicated(frame, how).collect())
    assert got == removed_from_rows(rows, how.length)


# --- 2 ----------------------------------------------------------------------

@pytest.mark.parametrize("how", [metric_join.Range(), metric_join.Range(cell=4, pivots=50, block=3, place=7)])
def test_metric_join_is_the_brute_force_join(spark, how):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(15):
        centre = rng.normal(size=8)
        for _ in range(1 + c % 6):
            rows.append((centre + rng.normal(size=8) * 0.08 * (c % 4)).tolist())
    rows += [rows[0], [2 * x for x in rows[0]], [0.0] * 8, None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [], [1.0, 2.0]]
    table = [(i, v, None if i == 5 else i % 2) for i, v in enumerate(rows)]
    ok = {i: np.array(v) for i, v, lab in table if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in table}

    def alike(a, b):
        x, y = ok.get(a), ok.get(b)
        return x is not None and y is not None and label[a] == label[b] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    want, links = linked_classes([r[0] for r in table], alike)
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = metric_join.near_duplicates(frame, how).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], want[i], want[i] == i) for i in want}


# --- 1 ----------------------------------------------------------------------

def test_closest_fill_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        space = rng.randrange(0, 80)
        used = bin_packing.closest_fill(counts, space)
        sums = {sum(x * n for x, n in zip(counts, pick)) for pick in itertools.product(*[range(n + 1) for n in counts.values()])}
        assert all(used[x] <= counts[x] for x in used)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= space)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n"])
def test_a_long_run_of_blanks_has_the_ids_of_the_vocabulary(blank):
    import public_tokenizers
    from tokenizers import Tokenizer
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")]
    text = "begin" + blank * (2_000_000 // len(blank)) + "end"
    want = Tokenizer.from_file(paths[1]).encode(text, add_special_tokens=False).ids + [0]
    assert bin_packing.token_ids(text, paths[0], public_tokenizers.PATTERN, paths[1]).tolist() == want


def test_rows_without_an_id_are_spread_over_the_groups(spark):
    rows = spark.createDataFrame([(None, "one text for all of them")] * 10_000, "doc_id long, text string")
    spans = bin_packing.pieces(rows).drop("ids")
    groups = [r["count"] for r in bin_packing.assigned(spans, 10).groupBy((F.col("sequence_id") % 10).alias("g")).count().collect()]
    assert len(groups) == 10 and max(groups) < 1300


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    rng = random.Random(1)
    texts = {i: prose(rng, rng.randrange(0, 900)) for i in range(60)}
    texts |= {100: None, 101: "", 102: "a<|endoftext|>b <|endoftext|>", 103: prose(rng, 9000), 104: "naïve ßtraße \n\n  x", -5: "minus"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for d, t in texts.items()}
    by_doc: dict = {}
    filled: dict = {}
    for r in bin_packing.packed(frame).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, spans in by_doc.items():
        assert [s for s, _ in sorted(spans)] == list(itertools.accumulate([0] + [n for _, n in sorted(spans)][:-1]))
        assert sum(n for _, n in spans) == len(ids[d])
    assert set(by_doc) == set(texts)
    for spans in filled.values():
        assert [o for o, _ in sorted(spans)] == list(itertools.accumulate([0] + [n for _, n in sorted(spans)][:-1]))
    sizes = [sum(n for _, n in s) for s in filled.values()]
    assert max(sizes) <= 1024 and sum(1024 - n for n in sizes) < 0.1 * sum(sizes)
    for r in bin_packing.sequences(frame).collect():
        whole = np.frombuffer(bytes(r.ids), "<u4")
        assert len(whole) == r.n_tokens
        for s in r.spans:
            assert (whole[s.offset:s.offset + s.length] == ids[s.doc_id][s.start:s.start + s.length]).all()


# --- 4 ----------------------------------------------------------------------

def test_codewords_differ_in_many_bits():
    for k in (2, 3, 5, 7, 12, 40):
        words = ecoc_language.codewords(k)
        apart = min((a != b).sum() for a, b in itertools.combinations(words, 2))
        assert apart >= (words.shape[1] + 1) // 2 if k <= 7 else apart >= 0.25 * words.shape[1]


def test_language_is_found_on_held_out_texts(spark, sf_small):
    docs = common.table(spark, sf_small, "documents")
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = ecoc_language.identified(docs).collect()
    assert {r.doc_id for r in got} == set(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in held if len(lang[r.doc_id][1]) > 100]) > 0.97


def test_a_long_text_in_slices_has_the_same_trigrams():
    text = "Ein Fuchs, zwei Füchse. " * 50
    whole = np.sort(np.concatenate(list(ecoc_language.trigrams(text, ecoc_language.Code()))))
    parts = np.sort(np.concatenate(list(ecoc_language.trigrams(text, ecoc_language.Code(slice_chars=7)))))
    assert (whole == parts).all() and len(whole) == sum(c.isalpha() for c in text)


# --- 3 ----------------------------------------------------------------------

def test_url_rules_and_parts(spark):
    cases = {
        "http://A.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/1?q": ("example.org", "/en/1", "example.org/en/1", "block"),
        "https://notexample.org/en/17": ("notexample.org", "/en/17", "org/", "allow"),
        "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "https://x.com?de=/de/": ("x.com", "", None, "allow"),
        "https://com/fr/1://y": ("com", "/fr/1://y", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "x://ÄB.net#/org/": ("Äb.net", "", None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, "<p>fine words here</p>") for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = url_reputation.judged(frame, url_reputation.RULES, url_reputation.listed_outcome(frame["url"])).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == dict(enumerate(cases.values()))


def test_a_surely_bad_host_is_blocked_and_a_new_one_is_not(spark):
    rows = [("https://bad.spam.net/1", 1)] * 40 + [("https://once.other.net/1", 1)]
    rows += [(f"https://h{i % 30}.good.net/{i}", 0) for i in range(600)]
    frame = spark.createDataFrame([(i, u, bad) for i, (u, bad) in enumerate(rows)], "page_id long, url string, reviewed long")
    got = url_reputation.judged(frame, [], frame["reviewed"]).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bad.spam.net"}


def test_urls_carry_their_outcome(spark):
    urls = {"http://m.casino-win.example.com/x": 1, "http://CHEAP-pills.net": 1, "http://a.b/free/bets?x": 1, "http://uploads.example.org/adsl": 0,
            "http://essex.ac.uk/spammer": 0, "": 0, None: None}
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in frame.select("url", url_reputation.listed_outcome(frame["url"])).collect()} == urls


def test_the_posterior_blocks_hosts_of_the_given_pages(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    got = url_reputation.judged(pages, url_reputation.RULES, url_reputation.listed_outcome(pages["url"])).collect()
    blocked = {r.host for r in got if r.verdict == "block" and r.rule is None}
    assert blocked and all(re.search("|".join(url_reputation.BAD_WORDS), h) for h in blocked)


# --- 9 ----------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "https://a.org/x y\r\nz", "same"), (2, None, "same"), (7, "https://b.org", "same"), (3, "u", "é\r\n\r\nWARC/1.1\r\n"),
            (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (None, "u", "same")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(frame, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data, r = (html or "").encode(), got[page]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {
        1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None),
        6: ("response", None), None: ("response", None)}
    captures = warc.assembled(warc.read_records(spark, str(tmp_path / "w"))).collect()
    whole = {c.metadata.fields[0]["value"]: c for c in captures if c.metadata.fields}
    assert bytes(whole["3"].response.payload).decode() == rows[3][2] and whole["1"].request.target_uri == "https://a.org/x%20y%0D%0Az"
    assert all(c.request and c.response and c.metadata for c in captures)


def test_a_cut_record_is_refused():
    import io
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(io.BytesIO(good * 2))] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(good[:-6])))


# --- 5 ----------------------------------------------------------------------

def secret_corpus():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = prose(rng, 20)
        if i % 3 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" and {prose(rng, 5)}'
        if i % 4 == 0:
            text += f" card {rng.randrange(10**15, 10**16)} {prose(rng, 3)}"
        if i % 6 == 1:
            text += " password=" + "".join(rng.choice("0123456789abcdef") for _ in range(17)) + "7"
        if i % 6 == 5:
            text += f" see image_content_update_{i}"
        rows.append((i, text, "en", None if i % 7 else "repo/tests/x.py"))
    return rows + [(100, None, "en", "s"), (101, "", "en", "s"), rows[0]]


def test_secrets_are_found_and_other_strings_left(spark):
    rows = secret_corpus()
    texts = {r[0]: r[1] for r in rows}
    got = secret_forest.findings(docs_frame(spark, rows)).collect()
    pattern = re.compile(secret_forest.CANDIDATE)
    want = sorted((r[0], m.start(), m.group()) for r in rows for m in pattern.finditer(r[1] or ""))
    assert sorted((r.doc_id, r.start, r.candidate) for r in got) == want
    for r in got:
        before = texts[r.doc_id][:r.start]
        assert r.is_secret == bool(re.search(r'(token = "|password=)$', before)), (r.candidate, r.probability)


def test_masking_changes_secrets_alone(spark):
    rows = secret_corpus()
    got = secret_forest.masked_documents(docs_frame(spark, rows)).collect()
    masked = {r[0]: re.sub(r'(token = "|password=)\w+', r"\1[SECRET]", r[1]) if r[1] else r[1] for r in rows}
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((r[0], masked[r[0]] or "") for r in rows)


def test_labels_of_one_kind_decide_for_all(spark):
    docs = docs_frame(spark, [(1, "pay 4111111111111111 now", "en", "s"), (2, 'token = "0123456789abcdef0123"', "en", "s")])
    found = secret_forest.with_features(secret_forest.candidates(docs), [])
    for label in (0.0, 1.0):
        rows = secret_forest.findings(docs, reviewed=found.withColumn("label", F.lit(label))).collect()
        assert [(r.is_secret, r.probability) for r in rows] == [(bool(label), label)] * 2
    none = secret_forest.findings(docs, reviewed=found.withColumn("label", F.lit(0.0)).limit(0)).collect()
    assert [(r.is_secret, r.probability) for r in none] == [(True, 1.0)] * 2


@pytest.mark.parametrize("rare", [0, 1])
def test_a_rare_label_is_in_the_bounded_sample(spark, rare):
    key = "AKIA" + "Q7RZ4WXK2M5NTB9C"
    common = [f"card {10**15 + 7919 * i} ends" if rare else f"key AKIA{10**15 + i:016d} ends" for i in range(400)]
    rows = [*common, *([f"use {key} ends"] if rare else ["card 4111111111111111 ends"])]
    docs = docs_frame(spark, [(i % 300, t, "en", "s") for i, t in enumerate(rows + rows)])
    got = secret_forest.bounded_sample(secret_forest.certain(secret_forest.with_features(secret_forest.candidates(docs), [])), 100).groupBy("label").count().collect()
    count = {r.label: r["count"] for r in got}
    assert count[float(rare)] == 1 and 25 <= count[1.0 - rare] <= 85


def test_the_forest_judges_equal_strings_by_their_neighbours(spark):
    rng = random.Random(31)
    same = [f"{rng.getrandbits(160):040x}" for _ in range(12)]
    rows = [(i, f'set token = "{x}" here', "en", "s") for i, x in enumerate(same)] + [(100 + i, f"see commit {x} here", "en", "s") for i, x in enumerate(same)]
    got = {r.doc_id: r.is_secret for r in secret_forest.findings(docs_frame(spark, rows)).collect()}
    assert got == {i: i < 100 for i, _, _, _ in rows}
    found = secret_forest.with_features(secret_forest.candidates(docs_frame(spark, rows)), [])
    assert secret_forest.certain(found).count() == 0          # no rule is certain of any of them


def test_the_forest_uses_every_kind_of_feature_and_holds_out(spark):
    given = common.settled(secret_forest.reviewed_findings(spark, 4000, secret_forest.WORDS))
    assert 3900 < given.count() <= 4000 and given.select("candidate", "before", "after", "path").distinct().count() > 3000
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = secret_forest.trained(given.where(~held))
    weight = dict(zip(secret_forest.FEATURES, model.featureImportances.toArray()))
    assert all(weight[x] > 0.001 for x in ("length", "transitions", "dictionary", "path_test", "path_depth", "named", "other_name", "words_before", "number_before"))
    out = secret_forest.scored(given.where(held), model).select("label", "is_secret").collect()
    hit = sum(r.is_secret and r.label == 1 for r in out)
    assert hit >= 0.95 * sum(r.is_secret for r in out) and hit >= 0.95 * sum(r.label == 1 for r in out)


def test_the_dictionary_is_the_corpus_own(spark):
    docs = docs_frame(spark, [(i, "Window and thread " + ("rare%d" % i) + " the deadbeef1" + (" extra" if i < 3 else ""), "en", "s") for i in range(9)] + [(99, None, "en", "s")])
    assert secret_forest.dictionary(docs, 2) == ["thread", "window"] and secret_forest.dictionary(docs, 3) == ["extra", "thread", "window"]
    pattern = re.compile(secret_forest.prefix_pattern(["in", "index", "indexes", "inner", "table", "a.b"]))
    assert pattern.findall("indexesinnerxtableinindexa.b") == ["indexes", "inner", "table", "in", "index", "a.b"]
    assert re.compile(secret_forest.prefix_pattern([])).findall("abc") == []


def test_assigned_passwords_are_found_whatever_they_look_like(spark):
    cases = {200: ('log in with password = "hunter2x9" today', "hunter2x9"), 201: ("password: correct-horse-battery, then go", "correct-horse-battery"),
             202: ("export pwd=P@ssw0rd!2024.xy", "P@ssw0rd!2024.xy"), 203: ('{"passwd":"Zq 7# (b)","user":"x"}', "Zq 7# (b)"),
             204: ("the password: is required", None), 205: ("token = ${TOKEN}", None), 206: ('secret="' + "k7#" * 20000 + '"', "k7#" * 20000)}
    rows = secret_corpus() + [(300 + i, f"the secret: is out, token: null, auth = get_auth({i})", "en", "s") for i in range(20)]
    rows += [(400 + i, f'password = "{chr(97 + i)}7!{chr(98 + i)}x{i}"', "en", "s") for i in range(20)]
    frame = docs_frame(spark, rows + [(i, text, "en", "s") for i, (text, _) in cases.items()])
    got = secret_forest.findings(frame).collect()
    texts = {i: text for i, (text, _) in cases.items()}
    assert all(texts[r.doc_id][r.start:r.start + r.length] == r.candidate for r in got if r.doc_id in texts)
    found = {r.doc_id: r.candidate for r in got if r.doc_id in cases and r.is_secret and r.doc_id != 203}
    assert found == {i: secret for i, (_, secret) in cases.items() if secret and i != 203}
    assert [r.candidate for r in got if r.doc_id == 203] == ["Zq 7# (b)"]           # a phrase with blanks: the forest's to judge
    masked = {r.doc_id: r.text for r in secret_forest.masked_documents(frame).collect()}
    assert masked[202] == "export pwd=[SECRET]" and masked[201] == "password: [SECRET], then go" and masked[204] == cases[204][0]


# --- 7 ----------------------------------------------------------------------

def test_targets_are_the_reshared_weights(spark):
    for sizes in ([1000, 10, 500, 7, 0, 3], [5, 5, 5], [1], [100, 100, 100, 100], [0, 0]):
        weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
        while open_:
            rest = total - sum(3 * sizes[i] for i in range(len(sizes)) if i not in open_)
            share = {i: rest * weight[i] / sum(weight[j] for j in open_) for i in open_}
            over = {i for i in open_ if share[i] > 3 * sizes[i]}
            for i in open_:
                target[i] = 3.0 * sizes[i] if i in over else share[i]
            if not over:
                break
            open_ -= over
        frame = spark.createDataFrame([(i, f"s{i}", n) for i, n in enumerate(sizes)], "doc_id long, source string, size long")
        got = {r.source: r.target for r in systematic_mix.source_targets(frame).collect()}
        assert got == pytest.approx({f"s{i}": t for i, t in enumerate(target)})


def test_the_mix_comes_near_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 80)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    frame = docs_frame(spark, rows)
    got = systematic_mix.mixed(frame).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r.doc_id)] == [tuple(r) for r in sorted(systematic_mix.mixed(frame).collect(), key=lambda r: r.doc_id)]
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    for source in ("a", "b", "c", None):
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 2 * max(r.size for r in part)
        assert all(0 <= r.taken <= 3 * r.size for r in part)
    copies = {r.doc_id: r.copies for r in got}
    made = [r.doc_id for r in systematic_mix.mixed_documents(frame).collect()]
    assert sorted(made) == sorted(itertools.chain.from_iterable([i] * n for i, n in copies.items()))


def test_rows_that_share_or_lack_an_id_take_their_own_sources_copies(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, i + 10]), prose(rng, rng.randrange(1, 6), 3), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(500)]
    frame = docs_frame(spark, rows)
    want = Counter()
    for r in systematic_mix.mixed(frame).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    out = systematic_mix.mixed_documents(frame)
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert out.columns == frame.columns and got == Counter({k: n for k, n in want.items() if n})


def test_the_mix_writes_its_narrow_rows_to_few_files(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice([None, i]), prose(rng, rng.randrange(1, 9)), "en", rng.choice(["a", "a", "b", None])) for i in range(300)]
    frame = docs_frame(spark, rows).repartition(40)
    want = sorted(map(repr, systematic_mix.mixed(frame).collect()))
    files, settled = [], common.settled

    def counted(df):
        out = settled(df)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "settled", counted)
    monkeypatch.setattr(systematic_mix, "settled", counted)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = sorted(map(repr, systematic_mix.mixed(frame).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    # the sizes, the targets and the range-partitioned sizes: not one file for each of 40 or 64 parts
    assert got == want and len(files) == 3 and max(files) <= 8


# --- 10 ---------------------------------------------------------------------

def rule_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_rule_counts(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join(prose(rng, rng.randrange(0, 12), 6) + rng.choice(["", " #|", "\t<é>", "\x0b"]) for _ in range(rng.randrange(1, 9))), "en", f"s{i % 4}")
            for i in range(80)]
    rows += [(90, None, "en", None), (91, "", "en", None), (92, "a b c d e f g h i j k", "en", "s1"), (93, "x " * 50, "en", "s1"), (94, "\u2003wide\u00a0", "en", "s2")]
    got = {r.doc_id: r for r in host_rules.judged(docs_frame(spark, rows)).collect()}
    for doc_id, text, _, _ in rows:
        r, want = got[doc_id], rule_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_a_surely_failing_host_takes_its_documents_with_it(spark):
    good = "these are ten or more quite different words in one line"
    rows = [(i, "short" if i % 20 else good, "en", "bad") for i in range(100)] + [(200 + i, good, "en", f"g{i % 5}") for i in range(100)]
    rows += [(400, "short", "en", "tiny"), (401, good, "en", "tiny"), (402, good, "en", None)]
    got = {r.doc_id: r.kept for r in host_rules.judged(docs_frame(spark, rows)).collect()}
    want = {r[0]: r[1] == good and r[3] != "bad" for r in rows}
    assert got == want
    assert sorted(r.doc_id for r in host_rules.kept_documents(docs_frame(spark, rows)).collect()) == sorted(i for i, k in want.items() if k)
