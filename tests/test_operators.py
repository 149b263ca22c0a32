import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry as G, strings as S, text as X
from weftline.operators import profile as P, ranking as R, rules as U, similarity as H
from weftline.plans import checks


def test_numbered_splits_a_hot_group(spark):
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", r.random()) for i in range(2000)]
    got = R.numbered(spark.createDataFrame(rows, "id long, g string, x double").repartition(7), "g", ["x", "id"]).collect()
    want = {}
    for g in {x[1] for x in rows}:
        want |= {i: n for n, (i, _, _) in enumerate(sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0])), 1)}
    assert {x.id: x["rank"] for x in got} == want
    null = R.numbered(spark.createDataFrame([(1, None, 1.0), (2, None, 0.5)], "id long, g string, x double"), "g", ["x"]).collect()
    assert {x.id: x["rank"] for x in null} == {1: 2, 2: 1}
    assert R.numbered(spark.createDataFrame([], "id long, g string, x double"), "g", ["x"]).count() == 0


def test_slots(spark):
    c = spark.createDataFrame([("f", 1, 0, 2), ("f", 2, 0, 1), ("f", 2, 1, 1), ("f", 1, 1, 2), ("f", 3, 1, 9)], "family string, item long, slot int, rank int")
    assert sorted((x.item, x.slot) for x in R.fill_slots(c, [0, 1, 2], "family", "item", ["rank"]).collect()) == [(1, 1), (2, 0)]


def test_three_valued_rules(spark):
    c = U.Condition
    rules = [U.Rule("a", (c("x", equals="1"), c("n", least=2, most=5))), U.Rule("b", (c(any_of=(c("x", equals="1"), c("y", one_of=("p", "q")))),)), U.Rule("c")]
    rows = [({"x": "1", "n": "3"},), ({"x": "1"},), ({"x": "2", "n": "3"},), ({"y": "Q"},), ({"x": "UNKNOWN", "n": "9"},), ({},), ({"n": "many"},)]
    df = spark.createDataFrame(rows, "f map<string,string>")
    got = [(r.s, r.p, r.first) for r in df.select(U.satisfied(rules, F.col("f")).alias("s"), U.remaining(rules, F.col("f")).alias("p"), U.first_satisfied(rules, F.col("f")).alias("first")).collect()]
    assert got == [(["a", "b", "c"], ["a", "b", "c"], "a"), (["b", "c"], ["a", "b", "c"], "b"), (["c"], ["b", "c"], "c"), (["b", "c"], ["a", "b", "c"], "b"), (["c"], ["b", "c"], "c"), (["c"], ["a", "b", "c"], "c"), (["c"], ["a", "b", "c"], "c")]


def greedy(hashes, radius):
    out, taken = {}, set()
    for i, a in enumerate(hashes):
        if i in taken:
            continue
        for j in range(i, len(hashes)):
            if j not in taken and bin(a ^ hashes[j]).count("1") <= radius:
                taken.add(j)
                out[j] = a
    return out


def test_anchor_groups_follow_the_greedy_order(spark):
    r = random.Random(2)
    hashes = [r.randrange(1, 1 << 10) for _ in range(150)]
    df = spark.createDataFrame([("n", i, h) for i, h in enumerate(hashes)], "name string, vec_id long, hash long")
    firsts = df.groupBy("name", "hash").agg(F.min("vec_id").alias("first"))
    state = H.anchors(firsts, H.near_hashes(df.select("name", "hash"), 2, 10))
    got = {x.vec_id: x.anchor for x in df.join(state, ["name", "hash"]).collect()}
    assert got == greedy(hashes, 2)


def test_near_hashes_are_complete(spark):
    r = random.Random(4)
    hashes = sorted({r.randrange(1, 1 << 12) for _ in range(200)})
    got = {(x.a, x.b) for x in H.near_hashes(spark.createDataFrame([("n", h) for h in hashes], "name string, hash long"), 3, 12).collect()}
    assert got == {(a, b) for a in hashes for b in hashes if a < b and bin(a ^ b).count("1") <= 3}


def test_near_wide_hashes_are_complete(spark):
    r = random.Random(5)
    base = [r.getrandbits(128) for _ in range(6)]
    hashes = sorted({b ^ sum(1 << k for k in r.sample(range(128), r.randint(0, 5))) for b in base for _ in range(12)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = {(signed(h >> 64), signed(h & (1 << 64) - 1)): h for h in hashes}
    df = spark.createDataFrame([("n", *h) for h in halves], "name string, hash_hi long, hash_lo long")
    for radius in (0, 1, 6):
        got = {frozenset(((x.a_hi, x.a_lo), (x.b_hi, x.b_lo))) for x in H.near_wide_hashes(df, radius).collect()}
        assert got == {frozenset((a, b)) for a in halves for b in halves if a < b and bin(halves[a] ^ halves[b]).count("1") <= radius}


def test_near_vectors_read_all_numbers(spark, tmp_path):
    from weftline.queries import QUERIES
    same = [float(i % 2) for i in range(30)]
    rows = [(1, 0, same + [float(i) for i in range(34)]), (2, 0, same + [float(-i) for i in range(34)])]  # differ after place 25 only
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["near_vector_pairs"](spark, str(tmp_path)).count() == 0
    assert {r.anchor for r in QUERIES["vector_groups"](spark, str(tmp_path)).collect()}.__len__() == 2
    assert {r.name for r in QUERIES["softmax_of_all"](spark, str(tmp_path)).collect()} == {"d63", "d1"}


def test_merged_groups():
    assert P.merged_groups(["a", "b", "c", "d"], [("a", "c"), ("c", "d")]) == {"a": "a", "b": "b", "c": "a", "d": "a"}


@pytest.mark.parametrize(("text", "want"), [("Größe 12 x 30 cm blau", "Größe cm blau"), ("10x20 mm", "mm"), ("from 2024 until 12.05.2024 red", "until red"), ("A100 45% wool", "A100 wool"), ("plain", "plain"), ("", ""), (None, None)])
def test_noise(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.without_noise(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b\\Ça 12_x (2).tar.JPG",)], "n string")
    n = F.col("n")
    assert df.select(S.basename(n), S.stem(n), S.extension(n), S.folder(n)).first()[:] == ("Ça 12_x (2).tar.JPG", "Ça 12_x (2).tar", ".jpg", "b")
    one = spark.createDataFrame([("STRASSE",), ("Straße",), ("é",), ("é",), ("1,5",), ("1.5",), ("15",)], "s string")
    k = [r[0] for r in one.select(X.canonical_text(F.col("s"))).collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[4] == k[5] != k[6]


def test_boxes(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1)
    assert one.select(G.overlap_ratio(lit(0, 0, 2, 2), lit(1, 1, 2, 2))).first()[0] == pytest.approx(1 / 7)
    assert one.select(G.overlap_ratio(lit(0, 0, 1, 1), lit(5, 5, 1, 1))).first()[0] == 0
    assert one.select(G.overlap_ratio(lit(0, 0, 0, 0), lit(0, 0, 0, 0))).first()[0] == 0
    assert one.select(G.nearest_colour(*lit(250, 250, 250))).first()[0] == "white"


def test_plan_checks(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")
    assert checks.read_columns(df) == ["l_orderkey", "l_quantity"] and any("l_quantity" in f for f in checks.pushed_filters(df))
    assert not checks.cross_joins(df) and checks.cross_joins(spark.range(2).crossJoin(spark.range(3)))


def test_exact_medians(spark):
    r = random.Random(6)
    rows = [("hot", r.randint(0, 9) / 2) for _ in range(999)] + [("two", 1.0), ("two", 4.0), ("one", 7.0), (None, 1.0), ("none", None)]
    got = {x.g: x.median for x in R.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert got == {"hot": hot[499], "two": 2.5, "one": 7.0}


def test_natural_key_of_long_runs(spark):
    names = ["a10", "a9", "A09b", "a" + "9" * 25, "a1" + "0" * 25, "a000", "b", "a" + "0" * 30 + "8"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.natural_key(F.col("n")).alias("k"))
    got = [r.n for r in df.orderBy("k").collect()]
    assert got == ["a000", "a" + "0" * 30 + "8", "a9", "A09b", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_long_chain_of_anchors(spark):
    """Each hash is near the next only; as many rounds are made as the chain asks for."""
    n = 30
    hashes = spark.createDataFrame([("x", i + 1, i) for i in range(n)], "name string, hash long, first long")
    pairs = spark.createDataFrame([("x", i + 1, i + 2) for i in range(n - 1)], "name string, a long, b long")
    assert {r.hash: r.anchor for r in H.anchors(hashes, pairs).collect()} == {i + 1: i + 1 - i % 2 for i in range(n)}


def test_changed_rows_of_a_stream(spark, tmp_path):
    """Over many small batches the last state of each key counts, as over one."""
    from weftline.streaming import progress as Q

    r = random.Random(6)
    rows = [(i, f"u{r.randrange(9)}", r.randrange(10_000), r.choice("abc")) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts long, event_type string")
    df.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    got = Q.run_to_table(Q.latest_states(Q.event_stream(spark, str(tmp_path), files_per_trigger=3)), "t", "update", ["user_id"]).collect()
    want = {u: max((t, i, e) for i, v, t, e in rows if v == u) for u in {x[1] for x in rows}}
    assert {x.user_id: (x.ts, x.event_type) for x in got} == {u: (t, e) for u, (t, _, e) in want.items()}


def test_bounded_jobs(spark):
    """What the queue can't hold is refused; the rest runs, faults stay with their job, waiting ones can be taken back."""
    import threading

    from weftline.plans.queue import BoundedJobs

    go, jobs = threading.Event(), BoundedJobs(spark, capacity=3, workers=2)
    running = [threading.Semaphore(0), go]

    def hold(s):
        running[0].release()
        go.wait(30)
        return s.range(5).count()

    first = [jobs.submit(hold) for _ in range(2)]
    for _ in first:
        running[0].acquire(timeout=30)
    waiting = [jobs.submit(lambda s: s.range(7).count()), jobs.submit(lambda s: 1 / 0), jobs.submit(lambda s: 3)]
    assert jobs.submit(lambda s: 4) is None and all(waiting) and waiting[2].cancel()
    go.set()
    jobs.close()
    assert [f.result(30) for f in first] == [5, 5] and waiting[0].result(30) == 7 and isinstance(waiting[1].exception(30), ZeroDivisionError)
