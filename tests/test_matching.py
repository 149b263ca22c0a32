import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import strings as S
from weftline.operators import matching as M
from weftline.plans.jobs import match_names, ordered_manifest

IMAGES = "evidence_id long, job_id string, source_filename string, key string"
TOKENS = "job_id string, family_id string, property_name string, family_token string, rec string"


def data(spark, names, tokens):
    img = spark.createDataFrame([(i, "J", n, "k") for i, n in enumerate(names)], IMAGES)
    tok = spark.createDataFrame([("J", f, p, t, "r") for f, p, t in tokens], TOKENS)
    return M.names(img), M.catalogue(tok), img, tok


@pytest.mark.parametrize(("tokens", "want"), [(["4", "4"], 1.0), (["1", "2345678"], 1.456), (["26368", "725", "010"], 2.057)])
def test_known_distances(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert abs(df.select(S.concatenation_distance(F.col("t"))).first()[0] - want) < 6e-4
    assert abs(M.kendall_distance(tokens, "".join(tokens)) - want) < 6e-4


def test_kendall_counts_inversions():
    assert M.kendall_distance(["b", "a"], "ab") == pytest.approx(2.0) and M.kendall_distance(["a", "b"], "ab") == pytest.approx(1.0)
    assert M.kendall_distance(["ab"], "ab") == 0 and M.kendall_distance(["ab"], "ba") == math.inf and M.kendall_distance(["a", "b"], "abc") == math.inf


def test_permuted_against_brute_force(spark):
    r = random.Random(1)
    keys = sorted({"".join(r.choice("0123") for _ in range(6)) for _ in range(40)})
    names = ["_".join("".join(r.choice("0123") for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 4))) + ".jpg" for _ in range(120)]
    img, cat, *_ = data(spark, names, [(f"fam{i:02}", "x", k) for i, k in enumerate(keys)])
    index = M.holders(M.digit_postings(cat.where("prop <> 'family_id'")))
    got = {x.id: x.rec for x in M.by_permutation(img, index).collect()}
    want = {}
    for i, n in enumerate(names):
        toks, hits = n[:-4].split("_"), set()
        for m in range(2, len(toks) + 1):
            for s in itertools.combinations(toks, m):
                hits |= {f"fam{j:02}" for j, k in enumerate(keys) if M.kendall_distance(list(s), k) <= M.MAX_DISTANCE_PERMUTED}
        if len(hits) == 1:
            want[i] = hits.pop()
    assert got == want and want


def test_brackets(spark):
    img, cat, images, tokens = data(spark, ["12345678_a.jpg", "1234 5678.jpg", "87654321.jpg", "x_7654321_y.png", "11111-22222.jpg", "red boot.jpg", "red boot2 zz99.jpg", None, "", "33333_back.jpg", "99999999.jpg"],
                                    [("12345678", "c", "red"), ("12345678", "t", "boot"), ("20000001", "e", "87654321"), ("20000002", "e", "87654321"), ("20000003", "e", "917654321"), ("20000004", "a", "11111"), ("20000004", "a", "22222"), ("20000005", "a", "11111"), ("20000006", "c", "red"), ("20000007", "x", "33333"), ("20000007", "x", None), ("20000007", None, "q")])
    out = {r.id: r for r in match_names(images, tokens).collect()}
    assert out[0].rec == "12345678" and out[0].bracket == "digits"
    assert out[1].rec == "12345678" and out[1].bracket in ("digits", "concatenated")
    assert out[2].rec is None and out[2].reason == "several records"
    assert out[4].rec == "20000004" and out[4].bracket == "intersection"
    assert out[5].rec == "12345678" and out[5].bracket == "words"
    assert out[6].rec is None  # a code that names nothing
    assert out[9].rec == "20000007" and out[10].reason == "number not in catalogue" and out[8].reason == "nothing found"
    assert {r.id: r.new_name for r in ordered_manifest(match_names(images, tokens), img).collect()}[9] == "20000007_det0.jpg"


def test_later_brackets(spark):
    names = ["red_boot.jpg", "gren_sandal.jpg", "darkblue_clog.jpg", "hero_shot_x.jpg", "KQWZY_front.jpg", "velvet cape.jpg", "velvet cape noir.jpg", "IMG_photo.jpg", "x_7654321_y.jpg", "reed_hat.jpg"]
    fams = [("20000001", "c", "rouge"), ("20000001", "t", "boot"), ("20000002", "c", "green"), ("20000002", "t", "sandal"), ("20000003", "c", "dark blue"), ("20000003", "t", "clog"), ("20000004", "x", "other"), ("20000005", "refco", "k-q-w-z-y"),
            ("20000006", "x", "thing"), ("20000007", "color", "ivory"), ("20000007", "producttype", "scarf"), ("20000008", "e", "917654321"), ("20000009", "c", "reef"), ("20000009", "t", "rees")]
    _, _, images, tokens = data(spark, names, fams)
    images = images.withColumn("image_ngp_summary", F.when(F.col("evidence_id") == 7, "color=ivory;type=scarf"))
    known = spark.createDataFrame([(5, "20000006")], "id long, rec string")
    terms = spark.createDataFrame([("color", "ivory", "c1"), ("producttype", "scarf", "t1"), ("color", "red", "c2"), ("color", "rouge", "c2")], "term_domain string, term string, canonical_id string")
    synonyms = terms.select("term", F.col("canonical_id").alias("group_id"))
    sheets = spark.createDataFrame([(1, ["20000004", "hero-shot-x"])], "row_id long, cells array<string>")
    out = {r.id: (r.rec, r.bracket) for r in match_names(images, tokens, known, synonyms, terms, sheets).collect()}
    assert out == {0: ("20000001", "words"), 1: ("20000002", "near words"), 2: ("20000003", "words"), 3: ("20000004", "cell"), 4: ("20000005", "cell start"), 5: ("20000006", "known"), 6: ("20000006", "related sibling"),
                   7: ("20000007", "narrowed"), 8: ("20000008", "contained"), 9: (None, None)}  # one mistyped word is no two


def test_empty(spark):
    img, cat, images, tokens = data(spark, [], [])
    assert match_names(images, tokens).count() == 0
    img, cat, images, tokens = data(spark, ["12345678.jpg"], [])
    assert match_names(images, tokens).first().reason == "number not in catalogue"


def test_near_words(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 6))) for _ in range(60)})
    lex, asked = words[:30], words[30:]
    got = {(x.word, x.key) for x in M.near_words(spark.createDataFrame([("", w) for w in asked], "grp string, word string"), spark.createDataFrame([("", w) for w in lex], "grp string, key string")).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {(a, b) for a in asked for b in lex if lev(a, b) == 1}


def test_wordy_records_are_met_word_by_word(spark, monkeypatch):
    tokens = [("10000001", "t", w) for w in ("red", "boot", "wool", "long")] + [("10000002", "t", w) for w in ("red", "hat")] + [("10000003", "t", w) for w in ("red", "boot")]
    names = ["red boot wool.jpg", "red hat.jpg", "red boot.jpg", "red.jpg", "long wool boot.jpg"]
    img, cat, *_ = data(spark, names, tokens)
    one = sorted((r.id, r.rec, r.matched) for r in M.by_words(img, M.word_postings(cat)).collect())
    monkeypatch.setattr(M, "PAIRED_WORDS", 3)
    assert sorted((r.id, r.rec, r.matched) for r in M.by_words(img, M.word_postings(cat)).collect()) == one == [(0, "10000001", 3), (1, "10000002", 2), (4, "10000001", 3)]


def test_long_digits(spark):
    """Keys and windows of more than 18 digits are met like any other."""
    long = "12345678901234567890123"
    img, cat, *_ = data(spark, [f"a_{long[:11]}_{long[11:]}.jpg", f"{long[11:]}x{long[:11]}.jpg", f"b {long[3:14]}.jpg", f"c {long}.jpg", "d 1112223.jpg"], [("10000001", "x", f"r{long}")])
    index = M.holders(M.digit_postings(cat))
    assert [(r.id, r.rec) for r in M.by_concatenation(img, index).collect()] == [(0, "10000001")]
    assert (1, "10000001") in [(r.id, r.rec) for r in M.by_permutation(img, index).collect()]
    assert {r.id: r.rec for r in M.by_containment(img, index).collect()} == {0: "10000001", 1: "10000001", 2: "10000001"}


def test_gates_of_words(spark):
    names = ["red boot 76.jpg", "red boot 13 76.jpg", "red boot.jpg", "ab12cd.jpg", "ab12cd red.jpg", "zz99yy.jpg", "ab12cd zz99yy.jpg", "red boot 99.jpg", "boot.jpg", "ab12cd boot red.jpg"]
    tokens = [("10000001", "c", "red"), ("10000001", "t", "boot"), ("10000001", "k", "76"), ("10000002", "c", "red"), ("10000002", "t", "boot"), ("10000002", "k", "13"), ("10000003", "r", "AB12CD"), ("10000004", "r", "zz99yy"), ("10000005", "r", "ZZ99YY")]
    img, cat, *_ = data(spark, names, tokens)
    got = {r.id: (r.rec, r.matched) for r in M.by_words(img, M.word_postings(cat), numbers=M.number_postings(cat)).collect()}
    # 0: the number tells; 1: two numbers tell different records; 3: a code of one record; 4, 6: other words lead elsewhere; 5: a code of two
    assert got == {0: ("10000001", 2), 3: ("10000003", 1)}
    assert 0 not in {r.id for r in M.by_words(img, M.word_postings(cat)).collect()}


def test_driver_holds_one_small_plan_at_a_time(spark, monkeypatch):
    """No table that the whole job writes needs a large plan, and the driver's heap is given back behind each bracket."""
    from pyspark.sql.readwriter import DataFrameWriter

    _, _, images, tokens = data(spark, ["red_boot.jpg", "12345678_a.jpg", "1234 5679.jpg"], [("20000001", "c", "red"), ("20000001", "t", "boot"), ("12345678", "x", "hat"), ("12345679", "color", "ivory")])
    images = images.withColumn("image_ngp_summary", F.lit("color=ivory;type=scarf"))
    known = spark.createDataFrame([(7, "20000006")], "id long, rec string")
    terms = spark.createDataFrame([("color", "ivory", "c1"), ("producttype", "scarf", "t1")], "term_domain string, term string, canonical_id string")
    sheets = spark.createDataFrame([(1, ["20000004", "hero-shot-x"])], "row_id long, cells array<string>")
    write, sizes, full = DataFrameWriter.parquet, [], []

    def counted(self, path, *args, **kwargs):
        sizes.append(self._df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        if "/found-" in path:  # a bracket's table
            full.append(sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName()))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    out = {r.id: r.bracket for r in match_names(images, tokens, known, terms.select("term", F.col("canonical_id").alias("group_id")), terms, sheets).collect()}
    assert out == {0: "words", 1: "digits", 2: "digits"}
    assert max(sizes) <= 24, sizes  # 64 when several brackets were planned as one
    assert len(full) >= 10 and all(a < b for a, b in zip(full, full[1:])), full
