from pyspark.sql import functions as F

from weftline.functions import strings as S
from weftline.operators import matching as M, profile as P

CELLS = "file string, sheet string, row int, row_id long, col int, confidence double, is_key boolean"


def found(spark, rows):
    return {r.sheet: (r.row, r.matched, r.filled) for r in P.header_row(spark.createDataFrame([("f", *r) for r in rows], CELLS)).collect()}


def test_header_row(spark):
    cells = []
    for sheet, rows in {
        "ratio": [[None, None], [1.0, 0.75, None], [1.0, 0.75, None]],  # the first of equal rows
        "more": [[1.0], [1.0, 1.0, None], [1.0, 0.75, None]],  # a sparse title row has a perfect share and loses
        "sure": [[1.0, 0.75], [1.0, 1.0]],
        "key": [[None] * 3, ["key", 1.0, *[None] * 9]],  # far below the share, but a key and one more
        "key alone": [["key", *[None] * 9]],
        "none": [[None, None, None], [1.0, None, None, None]],
    }.items():
        for r, own in enumerate(rows):
            cells += [(sheet, r, r, c, 1.0 if x == "key" else x, x == "key") for c, x in enumerate(own)]
    got = found(spark, cells)
    assert got == {"ratio": (1, 2, 3), "more": (1, 2, 3), "sure": (1, 2, 2), "key": (1, 2, 11)}
    assert found(spark, []) == {}


def test_key_column(spark):
    heads, values = [], []
    for sheet, (keys, others, columns) in {
        "one": ([2], [0, 1], {0: ["11111111", "22222222"]}),  # the only key header, whatever stands below
        "several": ([1, 3], [0], {1: ["11111111", "11111111"], 3: ["11111111", " 22222222 ", None, ""]}),
        "none fits": ([1, 3], [0], {1: ["x"], 3: ["11111111", "11111111"]}),
        "pattern": ([], [0, 1], {0: ["a", "b"], 1: ["11111111", "22222222"], 7: ["33333333"]}),  # column 7 has no header
        "two patterns": ([], [0, 1], {0: ["33333333"], 1: ["11111111", "22222222"]}),
        "empty": ([], [0], {}),
    }.items():
        heads += [("f", sheet, c, c in keys) for c in [*keys, *others]]
        values += [("f", sheet, c, v) for c, vs in columns.items() for v in vs]
    got = P.key_column(spark.createDataFrame(heads, "file string, sheet string, col int, is_key boolean"), spark.createDataFrame(values, "file string, sheet string, col int, value string"))
    assert {r.sheet: r.key_col for r in got.collect()} == {"one": 2, "several": 3, "none fits": 1, "pattern": 1, "two patterns": None, "empty": None}


def test_cell_probes_in_order(spark):
    """The base name decides before the stem, and that before the collapsed stem, also where it leads to several."""
    rows = [(1, ["10000001", "Pics: a/Shoe_77.jpg, b"]), (2, ["10000002", "shoe_77.png"]), (3, ["10000003", "SHOE-77"]), (4, ["10000004", "boot_99.jpg"]), (5, ["10000005", "boot_99.jpg"]), (6, ["10000006", "10000007", "lamp_55.jpg"]), (7, ["10000008", None])]
    img = spark.createDataFrame([(1, "x/shoe_77.JPG"), (2, "shoe_77.tif"), (3, "shoe 77 (1).jpg"), (4, "boot_99.jpg"), (5, "lamp_55.jpg"), (6, "shoe-77.gif"), (7, None)], "id long, name string")
    got = {r.id: r.rec for r in M.by_cell(img, spark.createDataFrame(rows, "row_id long, cells array<string>")).collect()}
    # 2: the stem leads to two; 3: so does the collapsed stem; 6: its own stem is in row 3 only
    assert got == {1: "10000001", 6: "10000003"}


def test_orientation(spark):
    names = ["a/deep back_FRONT.jpg", "top-skirt_x.jpg", "x_dos.png", "front", "", None, "back (1).jpg", "é.oben.tif"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.o for r in df.select(S.orientation(F.col("n")).alias("o")).collect()] == ["FRONT", None, "BACK", "FRONT", None, None, None, "TOP"]
