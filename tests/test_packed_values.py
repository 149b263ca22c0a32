import itertools
import math
import random

import numpy as np
import pytest

from weftline.operators import packed_values as P

SCHEMA = "id long, name string, vals array<string>, col string, pos int, entry string"


@pytest.mark.parametrize(("entry", "want"), [
    ("a; b|c", [["a"], ["b"], ["c"]]), ("a,b", [["a", ",", "b"]]), ("a,,b//c", [["a"], ["b"], ["c"]]), ('"x; y", z', [['"x; y"', ", ", "z"]]), ("« a, b » - 'c'", [["« a, b »", " - ", "'c'"]]), ("a-b – c", [["a-b", " – ", "c"]]),
    ("d'été, l'an", [["d'été", ", ", "l'an"]]), ("a\\nb\\r\\nc\td\n\ne", [["a"], ["b"], ["c"], ["d"], ["e"]]), (" , ", []), ("", []), ("teal,", [["teal"]]), ('"open, b', [['"open', ", ", "b"]]), ("5\" x, y", [['5" x', ", ", "y"]]),
    ('""', [['""']])])
def test_fields(entry, want):
    assert P.fields(entry) == want


def run(spark, rows):
    df = spark.createDataFrame([(i, n, v, "c", 1, "e") for i, n, v in rows], SCHEMA)
    out = {}
    for r in sorted(P.split_values([("t", df, "id", "name", "vals")]).collect(), key=lambda r: r.pos):
        out.setdefault(r.record_id, []).append(r.value_text)
    return out


def corpus(seed=1):
    """Records packed from known values: sizes without marks, lengths with decimals, dates, colours with slashes in quotes."""
    r = random.Random(seed)
    makers = {
        "size run": lambda: r.choice(["S", "M", "L", "38", "40", "42", "6-9 m", "128-134"]), "strap length": lambda: f"{r.randint(1, 120)}{r.choice([',', '.'])}{r.choice(['25', '5'])} {r.choice(['cm', 'in'])}",
        "launch date": lambda: f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(2024, 2027)}", "shade": lambda: r.choice(["teal", "dark-red", "mint", '"red/coral mix"', "«navy, matt»"]),
    }
    rows, want = [], {}
    for i in range(900):
        name = r.choice(list(makers))
        several, entries, values = False, [], []
        for _ in range(r.randint(1, 3)):
            own = [makers[name]() for _ in range(r.choice([1, 1, 1, 2, 3, 5]))]
            mark = r.choice([",", ", ", "/", " / ", " - ", " + ", ";", "\n", "|", ",,"])
            if mark == "," and name in ("strap length",):
                mark = ", "
            if mark == "/" and name == "launch date":
                mark = " / "
            entries.append(mark.join(own))
            several |= len(own) > 1
            values += [P.unquoted(v) for v in own]
        rows.append((i, name, entries))
        if several:
            want[i] = values
    return rows, want


def test_learned_cuts(spark):
    rows, want = corpus()
    got = run(spark, rows)
    right = sum(got.get(i) == v for i, v in want.items())
    assert right >= 0.985 * len(want) and len(set(got) - set(want)) <= 0.01 * len(rows)


def test_cases(spark):
    rows = [(1, "x", None), (2, "x", []), (3, "x", [None, "", " ; "]), (4, "x", ["a; b", None, "c"]), (5, None, ["p|q"]), (6, "x", ["a; a", "a"]), (7, "x", ["one value"]), (8, "x", ["w;" * 20_000]), (4, "x", ["a; b", None, "c"])]
    got = run(spark, rows)
    assert set(got) == {4, 5, 6, 8} and got[5] == ["p", "q"] and got[6] == ["a", "a", "a"] and got[8] == ["w"] * 20_000
    assert sorted(got[4]) == sorted(["a", "b", "c"] * 2)


def test_empty(spark):
    assert run(spark, []) == {}


def model_of(values):
    counts = {}
    for v, n in values:
        for h in P.value_keys("c", v)[:3]:
            counts[h] = counts.get(h, 0) + n
    keys = sorted(counts)
    return P.Model(np.array(keys, np.int64), np.array([counts[k] for k in keys], float), {"c": float(sum(n for _, n in values))}, {("c", ",00aa"): (3.0, 9.0)}, 1.0)


def every_path(model, f):
    """All ways to cut a field, with their log weights, by enumeration."""
    n = len(f) // 2 + 1
    quoted = [P.is_quoted(f[2 * k]) for k in range(n)]
    cuts = [model.cut("c", P._kind(f[2 * k + 1], f[2 * k], f[2 * k + 2])) for k in range(n - 1)]
    out = []
    for mask in itertools.product((0, 1), repeat=n - 1):
        w, start, path = 0.0, 0, []
        for k in range(n):
            if k == n - 1 or mask[k]:
                text = "".join(f[2 * start : 2 * k + 1])
                if start < k and any(quoted[start : k + 1]):
                    w = -math.inf
                own = P.Lattices()
                own.add("c", [text])
                w += float(model.segment_values(own)[0]) if k - start <= P.JOINED else P.UNSEEN - P.PER_CHARACTER * (len(text) + 1)
                path.append((start, k))
                start = k + 1
            if k < n - 1:
                w += cuts[k][0] if mask[k] else cuts[k][1]
        out.append((w, path))
    return out


@pytest.mark.parametrize("joined", [1, 2, 12])
def test_paths_agree_with_enumeration(monkeypatch, joined):
    """Also where values are longer than those that the lattice holds one by one."""
    monkeypatch.setattr(P, "JOINED", joined)
    model = model_of([("a", 5), ("b", 3), ("a,b", 4), ("b,a,b", 3), ("cc", 2), ("a,b,cc,a", 6)])
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(2, 7)
        f = [r.choice(["a", "b", "cc", '"q"', "long unknown text"]) if k % 2 == 0 else r.choice([",", ", ", "/"]) for k in range(2 * n - 1)]
        own = P.Lattices()
        own.add("c", f)
        own = P.Lattices.of_frame(own.frame())
        ways = every_path(model, f)
        top = max(w for w, _ in ways)
        total = sum(math.exp(w - top) for w, _ in ways)
        (best,) = P.paths(model, own, P.best_path)
        assert abs(dict((tuple(p), w) for w, p in ways)[tuple(best)] - top) < 1e-9
        p, q = P.expected(model, own)
        for k in range(n - 1):
            assert abs(q[k] - sum(math.exp(w - top) for w, path in ways if any(e == k for _, e in path)) / total) < 1e-9
        for s, e, x in zip(own.start, own.end, p, strict=True):
            assert abs(x - sum(math.exp(w - top) for w, path in ways if (s, e) in path) / total) < 1e-9


def test_long_enumerations_and_long_values(spark):
    """A hundred values are cut, a hundred numbers with commas between (mostly decimal marks) may be one: no bound on either."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    rows = [(i, "x", [w]) for i, w in enumerate(words * 3)] + [(1000, "x", [",".join(words)]), (1001, "y", ["; ".join(["p"] * 5)]), (1002, "x", [", ".join(f"unseen text number {i} of a long prose" for i in range(3000))])]
    got = run(spark, rows)
    assert got[1000] == words and len(got[1001]) == 5 and set(got) <= {1000, 1001, 1002}


def test_model_holds_what_returns_and_is_asked_for(spark):
    rows = [("x", f"only {i}") for i in range(500)] + [("x", "red")] * 5 + [("x", "blue")] * 4 + [("x", "green")] * 9 + [("x", "red, blue")] + [("y", "red, blue")]
    model = P.learn(spark.createDataFrame(rows, "col string, entry string")).model
    has = lambda v, col="x": P.value_keys(col, v)[0] in set(model.keys.tolist())
    assert has("red") and has("blue") and not has("green") and not has("only 3") and not has("red", "y") and len(model.keys) < 12
    assert model.got(np.array([P.value_keys("x", "red")[0]]))[0] > 4.5


def test_joined_counts_give_the_same(spark, monkeypatch):
    """A model too large to be sent: counts are joined to the lattices, and records look their fields up."""
    rows = corpus(5)[0] + [(2000, "x", None), (2001, None, ["p|q", None, "", "r"]), (2002, "shade", [" , ", '"a; b", c', "teal"]), (2003, "shade", ['""; x, y']), (2004, "size run", [", ".join(["S", "M"] * 40)]), (2004, "size run", ["S, M"])]
    sent = run(spark, rows)
    monkeypatch.setattr(P, "MODEL_KEYS", 0)
    assert run(spark, rows) == sent and len(sent) > 300


def test_rounds_end_when_cuts_settle(spark, monkeypatch):
    rows, _ = corpus(3)
    entries = spark.createDataFrame([(n, e) for _, n, own in rows for e in own], "col string, entry string")
    models, make = [], P._model
    monkeypatch.setattr(P, "_model", lambda counts: (models.append(make(counts)), models[-1])[1])
    P.learn(entries)
    assert 4 <= len(models) <= 8 and P.moved(models[-2][0], models[-1][0]) <= P.SETTLED < P.moved(models[0][0], models[1][0])
    assert P.moved(P.Model(np.zeros(0), np.zeros(0), {}, {}), P.Model(np.zeros(0), np.zeros(0), {}, {})) == 0


def test_cuts_do_not_depend_on_other_columns(spark):
    rows, _ = corpus(2)
    alone = run(spark, rows)
    letters = str.maketrans("0123456789", "abcdefghij")
    others = [(100_000 + i, f"other {i % 30}", [f"w{i:06}".translate(letters)]) for i in range(60_000)]
    got = run(spark, rows + others)
    assert {k: v for k, v in got.items() if k < 100_000} == alone
