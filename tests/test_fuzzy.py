"""Near spellings against all pairs, seeded misspellings, hot blocks, and components."""

import itertools
import random

import duckdb
import pytest

from tillroll.operators import fuzzy
from tillroll.operators.graph import connected_components


def misspelt(rng, text):
    i = rng.randrange(len(text))
    kind = rng.randrange(4)
    if kind == 0:
        return text[:i] + text[i + 1:]
    if kind == 1:
        return text[:i] + rng.choice("abcxyz") + text[i:]
    if kind == 2:
        return text[:i] + rng.choice("abcxyz") + text[i + 1:]
    i = rng.randrange(len(text) - 1) if len(text) > 1 else 0
    return text[:i] + text[i + 1:i + 2] + text[i:i + 1] + text[i + 2:]


@pytest.mark.parametrize("k, block", [(1, 1000), (2, 1000), (2, 3), (3, 7)])
def test_near_spellings_are_all_pairs_within_the_distance(spark, k, block):
    rng = random.Random(k)
    words = {"", "a", "b", "ab", "ba", "aab"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(60)}
    base = ["common prefix of " + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(25)]
    for w in base:
        words.add(w)
        for _ in range(2):
            x = w
            for _ in range(rng.randrange(1, 4)):
                x = misspelt(rng, x)
            words.add(x)
    texts = spark.createDataFrame([(w,) for w in words], "t string")
    got = {(r.a, r.b): r.distance for r in fuzzy.near_spellings(texts, k, block).collect()}
    want = {(a, b): d for a, b in itertools.combinations(sorted(words), 2) if (d := fuzzy.edit_distance(a, b)) <= k}
    assert got == want


def test_edit_distance_is_the_known_one():
    rng = random.Random(4)
    pairs = [("ca", "abc"), ("", "abc"), ("abcd", "acbd"), ("abcd", "badc")]
    pairs += [tuple("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in "ab") for _ in range(300)]
    con = duckdb.connect()
    for a, b in pairs:
        if a and b:
            assert fuzzy.edit_distance(a, b) == con.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchone()[0], (a, b)
    assert fuzzy.edit_distance("", "abc") == 3


def test_seeded_misspellings_meet_their_value(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(8)) for _ in range(300)]
    rows, truth = [], {}
    for name in names:
        rows += [(name,)] * 5
        wrong = misspelt(rng, name)
        if wrong != name:
            truth[wrong] = name
            rows.append((wrong,))
        rows.append((f"  {name.upper()} ",))
        truth[f"  {name.upper()} "] = name
    df = spark.createDataFrame(rows + [(None,)], "name string")
    groups = fuzzy.inconsistent_values(df, "name")
    got = {r.value: r for r in groups.collect()}
    assert all(got[w].canonical == n for w, n in truth.items())
    assert all(got[w].distance == 0 for w in truth if w.startswith(" ")) and all(got[n].distance == 0 and got[n].rows == 5 for n in names)
    fixed = fuzzy.harmonized(df, "name", groups)
    assert {r["name"] for r in fixed.distinct().collect()} == {*names, None} and fixed.count() == df.count()
    assert fuzzy.inconsistent_values(df.limit(0), "name").collect() == []


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    star = [("hub", f"s{i}") for i in range(90)]
    edges = spark.createDataFrame(chain + star + [("x", "x"), ("q", "p"), ("p", "q")], "a string, b string")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys([f"c{i:03d}" for i in range(71)], "c000"), **dict.fromkeys(["hub"] + [f"s{i}" for i in range(90)], "hub"), "p": "p", "q": "p"}
