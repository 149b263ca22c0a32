import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.llm import vocabulary as V

TERMS = [("launch date", "launch"), ("care notes", "care"), ("size run", "size"), ("vestibilità", "fit"), ("passform", "fit"), ("largo manga", "sleeve"), ("retail price", "price"), ("lining", "lining")]


@settings(max_examples=200, deadline=None)
@given(*[st.text("abc", max_size=6)] * 3)
def test_distance_is_a_metric(a, b, c):
    assert V.distance(a, b) == V.distance(b, a) and (V.distance(a, b) == 0) == (a == b)
    assert V.distance(a, c) <= V.distance(a, b) + V.distance(b, c)


def test_transposition_is_one_edit():
    assert V.distance("lanuch", "launch") == 1 and V.distance("ca", "abc") == 2


def test_tree_returns_all_within(seed=3):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 8))) for _ in range(400)})
    tree = V.BKTree(words)
    for q in r.sample(words, 20) + ["", "zzzz", "abcabc"]:
        for radius in (0, 1, 2, 3):
            assert sorted(tree.within(q, radius)) == sorted((d, w) for w in words if (d := V.distance(q, w)) <= radius)


@pytest.mark.parametrize(("raw", "want"), [
    ("LAUNCH DATE", "launch"), ("12) launch date (EUR)", "launch"), ("date, launch", "launch"), ("LaunchDate", "launch"), ("lanch daet", "launch"), ("laun. date", "launch"), ("l4unch d4t3", "launch"),
    ("vestibilitÃ ", "fit"), ("vestibilita - passform", "fit"), ("passform (vestibilità)", "fit"), ("passform vestibilità", "fit"), ("manga, largo *", "sleeve"), ("launch date in %", "launch"),
    ("launch party", None), ("lining-up date", None), ("lining - care notes", None), ("size of order", None), ("Column5", None), ("???", None), ("x" * 50_000, None), ("retail.price.-.pflicht", "price")])
def test_readings(raw, want):
    hit = V.Reference(TERMS).match(raw)
    assert (hit[1] if hit else None) == want


def _mapped(spark, rows, terms=TERMS):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(rows)], "row long, raw string, v int, distance int")
    ref = spark.createDataFrame(terms, "term string, ident string")
    return {r.row: (r.match_id, r.match_distance) for r in V.map_values(df, "raw", ref, "term", "ident").collect()}


def test_cases(spark):
    got = _mapped(spark, ["launch date", None, "", "  ", "launhc date", "no such thing", "launch date"], [*TERMS, (None, "x"), ("--", "y"), ("alpha beta", "one"), ("alpha beta", "two")])
    assert got == {0: ("launch", 0), 1: (None, None), 2: (None, None), 3: (None, None), 4: ("launch", 1), 5: ("none", None), 6: ("launch", 0)}
    assert _mapped(spark, ["alpha beta"], [("alpha beta", "one"), ("alpha beta", "two")]) == {0: ("none", None)}
    assert _mapped(spark, ["a"], []) == {0: ("none", None)} and _mapped(spark, []) == {}


def test_shards_agree_with_one_tree(spark, monkeypatch):
    rows = ["launch date", "lanch date", "care nots", None, "", "zzz", "passform", "date, launch"]
    one = _mapped(spark, rows)
    monkeypatch.setattr(V, "TREE_ENTRIES", 3)
    assert _mapped(spark, rows) == one


def test_shards_agree_on_parts_completions_and_ties(spark, monkeypatch):
    terms = [*TERMS, ("alpha beta", "one"), ("alpha beta", "two"), ("alphq betq", "three"), ("alqha betb", "four")]
    rows = ["passform (vestibilita)", "vestibilità / passform", "passform vestibilità", "laun. date", "car. notes", "retail pri.", "price, ret.", "alpha beta", "lining - care notes", "retail size", "x" * 500, None]
    one = _mapped(spark, rows, terms)
    assert [one[i][0] for i in (0, 1, 2, 3, 7, 8)] == ["fit", "fit", "fit", "launch", "none", "none"]
    for entries in (1, 2, 5):
        monkeypatch.setattr(V, "TREE_ENTRIES", entries)
        assert _mapped(spark, rows, terms) == one


def test_columns_are_kept(spark):
    df = spark.createDataFrame([("lining", 5)], "raw string, id int")
    out = V.map_values(df, "raw", spark.createDataFrame(TERMS, "term string, ident string"), "term", "ident")
    assert set(out.columns) == {"raw", "id", "match_id", "match_distance"} and out.agg(F.max("id")).first()[0] == 5
