import random

import numpy as np

from weftline.llm import reading_level as R

EASY = ["the cat sat on the mat", "my dog is big", "we like the red ball", "the sun is warm"]
HARD = ["notwithstanding heterogeneous provenance the jurisdictional certification remains contingent", "interdependent accreditation circumscribes the taxonomical segmentation of antecedent homologation", "volumetric permeability necessitates comprehensive reconciliation"]
DOCS = "doc_id long, text string, level string, n_words int, _text string"
LABELS = "doc_id long, rater string, reading_level int, _level int"


def make(level, r, n=12):
    share = (level - 1) / 4
    return ". ".join(r.choice(HARD if r.random() < share else EASY) for _ in range(n)) + "."


def test_isotonic_is_monotone_and_exact():
    r = np.random.default_rng(1)
    x, y = r.random(300), r.random(300)
    xs, ys = R.isotonic(x, y, np.ones(300))
    assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) >= 0).all()
    assert abs(np.interp(x, xs, ys).mean() - y.mean()) < 0.05
    xs, ys = R.isotonic(np.array([1.0, 2, 3]), np.array([1.0, 3, 2]), np.ones(3))
    assert ys.tolist() == [1, 1, 2.5, 2.5]


def test_held_out_accuracy(spark):
    r = random.Random(4)
    texts, levels = zip(*[(make(k, r), float(k)) for k in [1, 2, 3, 4, 5] * 60], strict=True)
    got = run(spark, list(enumerate(texts)), [(i, int(levels[i])) for i in range(200)])
    d, level = (np.array([getattr(got[i], f) for i in range(200, 300)]) for f in ("difficulty", "level"))
    assert np.abs(level - np.array(levels[200:])).mean() < 0.7 and np.corrcoef(level, levels[200:])[0, 1] > 0.85
    assert (np.diff(level[np.argsort(d)]) >= -1e-9).all()


def test_counts_against_brute_force(spark):
    texts = [(0, 1.0, 2, "The cat sat. The cat!"), (0, 2.5, 1, "the cat ran"), (1, 4.0, 1, "a cat sat"), (1, 5.0, 1, None)]
    rows = {(r.fold, r.a, r.b): r for r in R.ngram_counts(spark.createDataFrame(texts[:3], "fold int, level double, raters long, text string")).collect()}
    assert [getattr(rows[0, "", "cat"], f"l{k}") for k in range(1, 6)] == [2, 0.5, 0.5, 0, 0] and rows[0, "", "cat"].docs == 2
    assert [getattr(rows[0, "the", "cat"], f"l{k}") for k in range(1, 6)] == [2, 0.5, 0.5, 0, 0] and (0, "sat", "the") not in rows
    assert rows[1, "cat", "sat"].l4 == 1 and len(rows) == 4 + 3 + 3 + 2


def test_residual():
    """Nothing is left where the levels rise with the scores; a score that tells nothing leaves the variance."""
    x, y, w = np.arange(6.0), np.array([1.0, 1, 2, 3, 3, 5]), np.array([1.0, 2, 1, 1, 1, 1])
    assert R.residual(x, y, w) < 1e-12 and abs(R.residual(np.zeros(6), y, w) - (w * (y - np.average(y, weights=w)) ** 2).sum()) < 1e-9
    assert R.residual(-x, y, w) > 1


def test_surprisal_by_hand(spark):
    """Two sentences, one known to level 1 and one to level 5: the words' mean lies between; spread is their distance."""
    model = R.LevelModels({"a": 1, "b": 2, ".": -1}, np.log(np.array([[0.1] * 5, [0.9, 0.1, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.1, 0.5]])))
    one, two, both = (model.difficulty([t]) for t in ("a a", "b b", "a a. b b"))
    assert one.difficulty[0] < 1.1 and two.difficulty[0] > 4.8 and abs(both.difficulty[0] - (one.difficulty[0] + two.difficulty[0]) / 2) < 1e-9
    assert abs(one.surprisal[0] + np.log(0.9)) < 1e-6 and abs(both.spread[0] - abs(np.log(0.9) - np.log(0.5)) / 2) < 1e-6 and one.spread[0] < 1e-6


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "x", 1, "t") for i, t in docs], DOCS)
    return {r.doc_id: r for r in R.reading_levels(d, spark.createDataFrame([(i, "r", v, 1) for i, v in labels], LABELS)).collect()}


def test_cases(spark):
    r = random.Random(1)
    docs = [(i, make(i % 5 + 1, r)) for i in range(100)]
    labels = [(i, i % 5 + 1) for i in range(100)] + [(0, 2), (3, None), (None, 4), (999, 3), (5, 17)]
    docs += [(200, None), (201, ""), (202, " \n "), (203, "qqq zzz xxx"), (204, "<p>" + make(5, r).upper() + "</p> &nbsp; AB-123"), (205, make(1, r, 20_000)), (206, "12345 !!! ???"), (207, make(5, r))]
    got = run(spark, docs, labels)
    assert len(got) == len(docs) and all(got[i].level is None for i in (200, 201, 202, 203, 206)) and got[200].n_words == 0 and got[203].n_words == 3
    assert got[204].level > 3.5 and got[207].level > 3.5 and got[205].level < 2 and got[205].n_words > 80_000


def test_no_labels_and_empty(spark):
    assert run(spark, [], []) == {} and all(r.level is None for r in run(spark, [(1, "the cat sat"), (2, None)], []).values())
    assert len(run(spark, [(1, "the cat sat. the cat sat"), (1, "the cat sat. the cat sat")], [(1, 3)])) == 1


def test_training_texts(spark, monkeypatch):
    """Bounded in rows, never in length; a repeated id counts once."""
    monkeypatch.setattr(R, "TRAIN_DOCS", 7)
    docs = spark.createDataFrame([(i, "the cat" * 100_000, "x", 1, "t") for i in range(20)] + [(3, "other", "x", 1, "t")], DOCS)
    labels = spark.createDataFrame([(i, "r", 3, 1) for i in range(20)], LABELS)
    got = R.training_texts(docs, labels).selectExpr("length(text) AS n", "fold").collect()
    assert len(got) == 7 and {r.n for r in got} <= {700_000, 5} and {r.fold for r in got} <= {0, 1}


def test_all_rated_documents_count(spark):
    """Beyond 8,000 rated documents, too, the model has the words and counts of all; every word stands in two documents."""
    word = lambda n: "".join(chr(97 + int(x)) for x in str(n))
    docs = [(i, f"the {word(i // 2)} the {word(i // 2)}") for i in range(8400)]
    d = spark.createDataFrame([(i, t, "x", 1, "t") for i, t in docs], DOCS)
    training = R.training_texts(d, spark.createDataFrame([(i, "r", i // 2 % 5 + 1, 1) for i, _ in docs], LABELS))
    vocab, counts = R.fold_counts(R.ngram_counts(training))
    assert training.count() == 8400 and set(vocab) == {"the", *(word(n) for n in range(4200)), *".!?\n"}
    assert R.Counts.sum(counts).uni.sum() == 4 * 8400 and R.Counts.sum(counts).uni[vocab["the"]].tolist() == [2 * 1680] * 5


def test_blocks_of_ranges_are_the_whole_fit(spark):
    """Scores pooled within ranges on the executors give the isotonic map and the residual of all scores at once."""
    r = np.random.default_rng(5)
    level = r.integers(2, 11, 3000) / 2
    scores = [np.round(level + r.normal(0, s, 3000), 2) for s in (0.3, 2)] + [np.full(3000, 1.5)]  # with ties; all alike
    raters = np.where(level % 1 == 0, r.integers(1, 4, 3000), 2)
    rows = [tuple(map(float, x[:4])) + (int(x[4]),) for x in zip(*scores, level, raters, strict=True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = R.score_blocks(spark.createDataFrame(rows, "d0 double, d1 double, d2 double, level double, raters long"), ["d0", "d1", "d2"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for x, b in zip(scores, blocks, strict=True):
        assert 1 <= len(b) < 300 and b[:, 3].sum() == raters.sum() and abs(b[:, 2].sum() - (level * raters).sum()) < 1e-9
        (xs, ys), (own, fitted) = R.isotonic(x, level, raters), R.knots(R.pool(b))
        assert xs.tolist() == own.tolist() and np.abs(ys - fitted).max() < 1e-12
        assert abs(b[:, 4].sum() + R.residual(b[:, 0], b[:, 2] / b[:, 3], b[:, 3]) - R.residual(x, level, raters)) < 1e-6
