import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.llm import duplicates as D

ROWS = "row_id long, cells array<string>, id string, key string, h1 int, table_name string"
PROPS = "value_id long, family_id string, property_name string, source_values array<string>, copies int"


def canon(s):
    s = unicodedata.normalize("NFC", s)
    s = re.sub(r"(?<=\d)[.,](?=\d)", "\0", s)
    return "".join("." if c == "\0" else c for c in s if c.isalpha() or c.isdecimal() or c == "\0").upper().lower()


def brute(rows, least):
    groups = defaultdict(list)
    for i, cells in rows:
        k = tuple(sorted(x for x in map(canon, [c for c in cells or [] if c is not None]) if x))
        if len(k) >= least:
            groups[k].append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


WORKSHEET = [
    (1, ["Red  Boot", "12,5 cm", "A-1"]), (2, ["a1", "RED-boot", "12.5cm", "", None]), (3, ["125 cm", "red boot", "A1"]),
    (4, None), (5, []), (6, [None, None, None]), (7, ["x", "y"]), (8, ["x", "y", "--"]), (9, ["é", "Straße", "q"]), (10, ["é", "STRASSE", "Q"]),
    (11, ["a", "a", "b"]), (12, ["a", "b", "b"]), (13, ["b", "a", "a"]), (14, ["z" * 100_000, "1", "2"]), (15, ["Z" * 100_000, "2", "1"]),
    (16, ["a\u0001b", "c", "d"]), (17, ["ab", "c", "d"]), (18, ["1.", ".2", "3,4"]), (19, ["1", "2", "3.4"]),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, c, "x", "y", 1, "t") for i, c in WORKSHEET], ROWS)
    got = sorted((r.first_id, r.copy_id) for r in D.duplicate_copies(D.worksheet_keys(df)).collect())
    assert got == brute(WORKSHEET, 3)
    assert (1, 2) in got and (9, 10) in got and (11, 13) in got and (14, 15) in got and (16, 17) in got and (18, 19) in got
    assert (1, 3) not in got and (11, 12) not in got


def test_properties(spark):
    rows = [(1, "11", "Size-Run", ["M", "L"], 0), (2, "11", "size run", ["l", " m"], 0), (3, "12", "size run", ["l", "m"], 0), (4, None, "size run", ["l"], 0), (5, None, "SIZE RUN", ["L", None], 0),
            (6, "11", None, ["x"], 0), (7, "11", "a", None, 0), (8, "11", "a", [], 0), (9, "11", "a", ["", None], 0), (10, "1", "1a", ["b"], 0), (11, "11", "a", ["b"], 0)]
    got = sorted((r.first_id, r.copy_id) for r in D.duplicate_copies(D.property_keys(spark.createDataFrame(rows, PROPS))).collect())
    assert got == [(1, 2), (4, 5)]


def test_counts_hot_group_and_collisions(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_LEAST", 5)
    df = spark.range(1, 401).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("u"), F.lit("v"), F.concat(F.lit("n"), F.col("id") % 50))).alias("cells"))
    keys = D.worksheet_keys(df)
    counts = D.count_copies(keys)
    assert counts.agg(F.sum("copies")).first()[0] == 400 and counts.agg(F.max("copies")).first()[0] == 133
    assert D.duplicate_copies(keys).count() == 400 - counts.count()
    assert D.collision_report(counts).isEmpty()
    forged = counts.withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(2).cast("long"))
    assert D.collision_report(forged).count() == 1


def test_empty(spark):
    assert D.duplicate_copies(D.worksheet_keys(spark.createDataFrame([], ROWS))).count() == 0
    assert D.duplicate_copies(D.property_keys(spark.createDataFrame([], PROPS))).count() == 0
