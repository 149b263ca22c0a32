import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.llm import survivors as S

SCHEMA = "id long, grp string, kind string, at timestamp_ntz, val string, size long, _rank int, _time int, value string, group_key string"
TRUST = [("studio", 1), ("upload", 2), ("link", 3), (None, 9)]


def run(spark, rows, trust=TRUST):
    df = spark.createDataFrame([(*r, 1, 2, "v", "g") for r in rows], SCHEMA)
    spec = S.Fields(df["grp"], df["id"], df["kind"], df["at"], {"val": df["val"]}, df["size"])
    out = S.survivors(df, spark.createDataFrame(trust, "source_kind string, trust_rank int"), spec)
    return {(r.group_key, r.field_name): r.value_text for r in out.collect()}


def naive(rows):
    out, groups = {}, {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    rank = {k: v for k, v in TRUST if k}
    for g, own in groups.items():
        if len(own) < 2:
            continue
        key = lambda r: (rank.get((r[2] or "").strip().lower(), S.UNLISTED), -(r[3] - dt.datetime(1970, 1, 1)).total_seconds() if r[3] else float("inf"), r[0])
        held = [r for r in own if r[4] is not None and r[4].strip() and r[4].strip().lower() not in S.MISSING]
        if held:
            out[g, "val"] = min(held, key=key)[4].strip()
        sized = [r for r in own if r[5] and r[5] > 0]
        if sized:
            out[g, "canonical"] = str(min(sized, key=lambda r: (-r[5], key(r)))[0])
    return out


def test_against_naive(spark):
    r = random.Random(5)
    times = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 3), dt.datetime(2025, 5, 5)]
    rows = [(i, r.choice(["a", "b", "c", "d", None, f"solo{i}"]), r.choice(["studio", " UPLOAD ", "link", "fax", None, ""]), r.choice(times), r.choice([None, "", " n/a", "TBD", "x ", "y", "(leer)", "z" * 5000]), r.choice([None, 0, -4, 10, 10, 20])) for i in range(300)]
    assert run(spark, rows) == naive(rows)


def test_one_hot_group(spark):
    rows = [(i, "hot", "link", dt.datetime(2024, 1, 1, 0, i // 60, i % 60), "v", 1) for i in range(900)]
    assert run(spark, rows) == {("hot", "val"): "v", ("hot", "canonical"): "899"}


def test_layers(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, "g", "studio", t[0], "old trusted", 5), (2, "g", "link", t[2], "new", 5), (3, "g", "link", t[1], "dominated", 5), (4, "g", "studio", t[2], None, None)]
    df = spark.createDataFrame([(*r, 1, 2, "v", "g") for r in rows], SCHEMA)
    spec = S.Fields(df["grp"], df["id"], df["kind"], df["at"], {"val": df["val"]})
    row = S.survivors(df, spark.createDataFrame(TRUST, "source_kind string, trust_rank int"), spec).first()
    assert row.value_text == "old trusted" and row.undominated == 2 and row.from_id == 1


def records(spark, rows):
    df = spark.createDataFrame(rows, "id long, grp string, kind string, at timestamp_ntz, a string, b string, c string, cells string")
    spec = S.Fields(df["grp"], df["id"], df["kind"], df["at"], {f: df[f] for f in "abc"})
    return {r.group_key: r for r in S.surviving_records(df, spark.createDataFrame(TRUST, "source_kind string, trust_rank int"), spec).collect()}


def peeled(rows):
    """Layers taken off one by one, among the newest records of each trust and set of fields."""
    rank, out, groups = {k: v for k, v in TRUST if k}, {}, {}
    for i, g, kind, at, *vals in rows:
        if g is not None:
            vals = [v.strip() if v and v.strip() and v.strip().lower() not in S.MISSING else None for v in vals[:3]]
            groups.setdefault(g, []).append((-rank.get((kind or "").strip().lower(), S.UNLISTED), at or dt.datetime(1, 1, 1), sum(v is not None for v in vals), -i, vals))
    for g, own in groups.items():
        if len(own) > 1:
            cells = {}
            for x in own:
                k = (x[0], *(v is None for v in x[4]))
                cells[k] = max(cells.get(k, x), x, key=lambda x: (x[1], x[3]))
            left, layers = list(cells.values()), []
            beats = lambda y, x: all(p >= q for p, q in zip(y[:3], x[:3])) and y[:3] != x[:3]  # noqa: E731, B905
            while left:
                layers.append(sorted((x for x in left if not any(beats(y, x) for y in left)), key=lambda x: x[:4], reverse=True))
                left = [x for x in left if x not in layers[-1]]
            order = [x for layer in layers for x in layer]
            got = [next((x[4][k] for x in order if x[4][k] is not None), None) for k in range(3)]
            out[g] = (-order[0][3], *got, sum(a is None and b is not None for a, b in zip(order[0][4], got)))  # noqa: B905
    return out


def test_records_against_peeling(spark):
    r = random.Random(11)
    times = [None, *(dt.datetime(2024, 1, d) for d in range(1, 6))]
    pick = lambda: r.choice([None, None, "-", " x", "y", "z"])
    rows = [(i, r.choice([None, *(f"g{k}" for k in range(40))]), r.choice(["studio", "upload", " LINK", None]), r.choice(times), pick(), pick(), pick(), "x") for i in range(400)]
    assert {g: (x.survivor_id, x.a, x.b, x.c, x.filled) for g, x in records(spark, rows).items()} == peeled(rows)


def test_successive_layers_fill(spark):
    """Field b: the policy's first holder over all records is 2 (trusted), but the first layer's holder is 3."""
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, "g", "studio", t[1], "own", None, None, ""), (2, "g", "studio", t[0], None, "covered", None, ""), (3, "g", "link", t[2], None, "first layer", None, ""), (4, "g", "link", t[0], None, None, "third", ""), (5, "g", None, None, "late", None, None, "")]
    x = records(spark, rows)["g"]
    assert (x.survivor_id, x.a, x.b, x.c, x.filled, x.undominated) == (1, "own", "first layer", "third", 2, 2)


def test_own_values_stay(spark):
    t = dt.datetime(2024, 1, 1)
    x = records(spark, [(1, "g", "studio", t, "less complete", None, None, ""), (2, "g", "studio", t, "complete", "b", None, "")])["g"]
    assert (x.survivor_id, x.a, x.b, x.filled) == (2, "complete", "b", 0)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, "a", None, None, "x", None)]) == {}
    assert run(spark, [(1, "a", None, None, "x", None), (1, "a", None, None, "y", None)], []) == {("a", "val"): "y"}
    assert run(spark, [(1, "a", None, None, None, None), (2, "a", None, None, "-", 0)]) == {}
    assert F.lit(1) is not None
