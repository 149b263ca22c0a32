import random

from weftline.llm import leakage as L

DOCS = "doc_id long, text string, item_id long, kind string"
STOCK = "Read the sheet carefully and then choose the best answer from the options below."
ITEMS = [
    (1, f"{STOCK}\nOf 61 tinted sashes, Brulidorund recalled half below a cropped docket, then quilted the tinted muff for Savuviaolin. What folded brooch remains beyond the duffel once Savuviaolin weighed 71 pouches?"),
    (2, f"{STOCK}\nIf Vabrilara ironed a tote under 41 braided mittens, which waxed blazer had Mubrineolin hid below the throw? Mubrineolin pinned 9 woven toggles near the narrow pouch while Vabrilara swapped every corset."),
    (3, None), (4, ""), (5, "short one"),
]
FILL = "The catalogue entry updates the finished sleeve before the start of the season. " * 3


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, 9, "k") for i, t in docs], DOCS)
    return L.leaked(d, spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")).collect()


def test_cases(spark):
    body = ITEMS[0][1].split("\n")[1]
    words = body.split()
    edited = words.copy()
    edited[5], edited[20] = "mislaid", "striped"
    docs = [
        (1, FILL + body + FILL), (2, body.upper()), (3, FILL + " ".join(words[3:25]) + FILL), (4, " ".join(edited)), (5, "<b>" + body.replace(" ", " &nbsp; ") + "</b>"), (6, " ".join(words[:12]) + " " + FILL + " " + " ".join(words[12:])),
        (7, STOCK + FILL), (8, " ".join(words[:7])), (9, "Brulidorund saw Savuviaolin and 61 more. " + FILL), (10, None), (11, ""), (12, FILL * 400 + body), (13, body), (13, body), (14, "* " + "\n* ".join(body.split(". "))),
        (15, body.replace("Brulidorund", "Petomara").replace("Savuviaolin", "Zinoskelle").replace("61", "34").replace("71", "28")),
    ]
    rows = run(spark, docs)
    own = sorted({(r.doc_id, r.item_id) for r in rows if r.kind == "own text"})
    assert {d for d, _ in own} >= {1, 2, 3, 4, 5, 6, 12, 13, 14} and not {d for d, _ in own} & {7, 8, 9, 10, 11}
    assert {i for _, i in own} == {1} and len([r for r in rows if r.doc_id == 13]) == 2
    assert any(r.changed_slots for r in rows if r.doc_id == 15)


def brute(text, item):
    """Longest common subsequence of words."""
    a, b = L.words(text), item
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], max(best[j], best[j - 1], last + (x == y))
    return best[-1]


def test_random_edits(spark):
    r = random.Random(2)
    body = ITEMS[1][1].split("\n")[1]
    item = L.words(body)
    docs = []
    for i in range(40):
        w = body.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "other"
        a = r.randint(0, len(w) - 20)
        docs.append((i, FILL + " ".join(w[a : a + r.randint(20, len(w) - a)]) + " " + FILL))
    found = {x.doc_id for x in run(spark, docs)}
    # whatever shares a passage of twenty words with few edits is found
    assert {i for i, t in docs if brute(t, item) >= 18} <= found


def test_shards_and_empty(spark, monkeypatch):
    docs = [(1, ITEMS[0][1]), (2, ITEMS[1][1])]
    one = sorted((r.doc_id, r.item_id) for r in run(spark, docs))
    monkeypatch.setattr(L, "SHARD_CHARS", 100)
    assert sorted((r.doc_id, r.item_id) for r in run(spark, docs)) == one == [(1, 1), (2, 2)]
    assert run(spark, []) == [] and run(spark, docs, []) == []


def dense(r, n=6):
    """A question about three people, full of names and numbers, so that no long stretch has none."""
    name = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)).title()
    verbs = "gave sold lent owed mailed returned hid showed read promised denied taught cooked baked carved wove".split()
    things = "plates cups bowls trays lamps spoons ropes bells books cards coats boots hats drums flutes stones".split()
    who = [name() for _ in range(3)]
    part = lambda: f"{r.choice(who)} {r.choice(verbs)} {r.randint(2, 99)} {r.choice(things)}"
    return " ".join(f"Then {part()} to {r.choice(who)} before {part()} near {r.choice(who)}." for _ in range(n)), name


def refilled(text, r, name):
    """The same with other names and numbers of five and more digits, one for one."""
    to, out = {}, []
    for w in text.split():
        core = w.rstrip(".")
        if core.isdigit():
            core = to.setdefault(core, str(r.randint(10_000, 999_999)))
        elif core.istitle() and core != "Then":
            core = to.setdefault(core, name())
        out.append(core + w[len(w.rstrip(".")) :])
    return " ".join(out)


def test_other_fillers(spark):
    r = random.Random(4)
    items, docs = [], []
    for i in range(40):
        text, name = dense(r)
        items.append((i, text))
        docs.append((i, FILL + refilled(text, r, name) + " " + FILL))
    docs += [(100 + i, FILL + dense(r)[0]) for i in range(40)]
    rows = [x for x in run(spark, docs, items) if x.kind == "other fillers"]
    hit = {(x.doc_id, x.item_id) for x in rows}
    assert sum((i, i) in hit for i in range(40)) >= 36 and len(hit) <= 42


def test_short_items_and_shared_passages(spark):
    passage = "The lamps of Orvelia burn whale oil for 12 nights. Nobody in the lower town has seen them fade since the great flood of the harbour."
    items = [(1, "Why do the lamps of Orvelia never fade?"), (2, passage + " Who lit them?"), (3, passage + " What do they burn?"), (4, "Grasp nettles"), (5, f"{STOCK}\n{ITEMS[0][1].split(chr(10))[1]}"), (6, f"{STOCK}\n{ITEMS[1][1].split(chr(10))[1]}")]
    docs = [(1, FILL + "why do the lamps of orvelia never fade " + FILL), (2, passage), (3, "One should grasp\nnettles firmly."), (4, "grasp the nettles"), (5, STOCK), (6, "why do the lamps of Orvelia fade")]
    assert sorted((x.doc_id, x.item_id) for x in run(spark, docs, items)) == [(1, 1), (2, 2), (2, 3), (3, 4)]


def test_any_number_of_shards(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, dense(r)[0]) for i in range(12)] + [(20, "Grasp nettles"), *ITEMS]
    docs = [(i, FILL + t[: len(t) // 2] + FILL) for i, t in items if t] + [(50, refilled(items[3][1], r, dense(r)[1])), (51, FILL), (52, None)]
    got = []
    for chars in (10**9, 3000, 1000):
        monkeypatch.setattr(L, "SHARD_CHARS", chars)
        got.append(sorted(map(tuple, run(spark, docs, items))))
    assert got[0] == got[1] == got[2] and len(got[0]) > 10


def test_repeated_ids(spark):
    one, two = (t.split("\n")[1] for _, t in ITEMS[:2])
    assert [(r.doc_id, r.item_id) for r in run(spark, [(1, one), (2, two)], [(1, one), (1, two), (1, "short one")])] == [(1, 1), (2, 1)]


def test_repeated_items_leak_together(spark):
    body = ITEMS[0][1].split("\n")[1]
    assert sorted(r.item_id for r in run(spark, [(1, body)], [(1, body), (2, body)])) == [1, 2]
