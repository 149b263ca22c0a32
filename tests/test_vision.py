import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import pixels as P, tensors as T
from weftline.operators import matching as M
from weftline.operators.images import probe


def jpeg(width, height, orientation=None, order="<"):
    out = b"\xff\xd8"
    if orientation:
        mark = b"II" if order == "<" else b"MM"
        tiff = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0" * 4
        out += b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 9 + b"\xff\xda" + b"x" * 4000


@pytest.mark.parametrize(("o", "order"), [(None, "<"), (6, "<"), (3, ">")])
def test_jpeg_header(o, order):
    assert P.jpeg_header(jpeg(800, 600, o, order)) == (800, 600, o or 1)


def test_broken_headers():
    assert P.jpeg_header(b"") is None and P.jpeg_header(b"\xff\xd8\xff") is None and P.jpeg_header(jpeg(8, 6)[:9]) is None and P.png_size(b"\x89PNG") is None
    assert P.png_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)) == (7, 9)


def test_orientations_undo_each_other():
    a = np.arange(6).reshape(2, 3)
    assert P.oriented(a, 1).tolist() == a.tolist() and P.oriented(a, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and P.oriented(a, 8).tolist() == [[2, 5], [1, 4], [0, 3]]
    assert P.oriented(a, 3).tolist() == [[5, 4, 3], [2, 1, 0]] and P.oriented(a, 2).tolist() == [[2, 1, 0], [5, 4, 3]] and P.oriented(a, 4).tolist() == [[3, 4, 5], [0, 1, 2]]
    assert P.oriented(a, 5).tolist() == a.T.tolist() and P.oriented(a, 7).tolist() == [[5, 2], [4, 1], [3, 0]]


def test_face_cut():
    a = np.zeros((100, 50, 3), np.uint8)
    assert P.face_cut(a, []).shape[0] == 100 and P.face_cut(a, [(5, 10, 10, 20), (5, 20, 10, 20)]).shape[0] == 65 and P.face_cut(a, [(0, 95, 5, 20)]).shape[0] == 100


def test_probe(spark):
    rows = [("ok.jpg", jpeg(800, 600)), ("turned.jpg", jpeg(800, 600, 6)), ("small.jpg", jpeg(100, 90)), ("tiny.jpg", jpeg(800, 600)[:100]), ("bad.jpg", b"\xff\xd8\xff" + b"0" * 5000), ("n.txt", b"hello" * 900), ("none.jpg", None)]
    df = spark.createDataFrame([(n, None if c is None else len(c), None if c is None else bytearray(c)) for n, c in rows], "id string, length long, content binary")
    got = {r.id: r for r in probe(df).collect()}
    assert {n: r.reason for n, r in got.items()} == {"ok.jpg": None, "turned.jpg": None, "small.jpg": "small picture", "tiny.jpg": "few bytes", "bad.jpg": "corrupt", "n.txt": "unsupported", "none.jpg": "missing"}
    assert got["ok.jpg"].conforming and not got["turned.jpg"].conforming and got["turned.jpg"].orientation == 6


def test_prompts_and_tensors():
    ids = T.prompt_ids(["a photo", "", None, "word " * 200])
    assert ids.shape == (4, 77) and (ids[:, 0] == T.START).all() and ids[1, 1] == T.END and ids[3, 76] == T.END and ids[0, -1] == T.PAD and (ids[1] == ids[2]).all()
    x = T.picture_tensor(np.full((10, 20, 3), 255, np.uint8))
    assert x.shape == (3, 224, 224) and abs(x[0, 0, 0] - (1 - T.MEAN[0]) / T.DEVIATION[0]) < 1e-5


def test_detections():
    out = np.zeros((300, 6))
    out[0] = (0, 0, 320, 640, 0.9, 0)
    out[1] = (-50, 0, 700, 10, 0.5, 3)
    out[2] = (0, 0, 10, 10, 0.32, 0)
    out[3:7] = (1, 1, 2, 2, 0.4, 1)
    found = T.detections(out)
    assert len(found) == 4 and found[0] == (0, 0, 0.5, 1, 0.9, 0) and found[1][:4] == (0, 0, 1, 10 / 640)
    assert T.people(found) == {"has_human": True, "count": 1, "hero": True, "confidence": 0.9} and T.people([])["confidence"] == 0.40
    s = T.label_scores(np.array([2.0, 0, 1, 1]), ["c", "c", "t", "t"], ["red", "blue", "bag", "belt"], {"c": 0.6})
    assert s["c"][0] == "red" and s["c"][2] == "influential" and s["t"] == ("bag", 0.5, "influential")


def test_narrowed(spark):
    cand = spark.createDataFrame([(1, "J", r) for r in "abc"] + [(2, "J", r) for r in "ab"], "id long, grp string, rec string")
    toks = spark.createDataFrame([(1, 0, "11"), (1, 1, "22"), (1, 2, "99"), (2, 0, "33"), (2, 1, "22")], "id long, n int, key string")
    post = spark.createDataFrame([("J", "11", "a"), ("J", "11", "b"), ("J", "22", "b"), ("J", "22", "c"), ("J", "33", "a"), ("J", "33", "b")], "grp string, key string, rec string")
    assert sorted((r.id, r.rec) for r in M.narrowed(cand, toks, post).collect()) == [(1, "b"), (2, "b")]
    assert M.narrowed(cand, toks.where("false"), post).count() == 5


def test_telling_folders(spark):
    img = spark.createDataFrame([(1, "J", "x/Red Boot/1.jpg"), (2, "J", "x/Blue Boot/1.jpg"), (3, "J", "x/web/1.jpg"), (4, "J", "y/Red/1.jpg"), (5, "J", "1.jpg")], "id long, grp string, name string")
    voc = spark.createDataFrame([("J", "red")], "grp string, key string")
    assert [(r.parent, r.folder) for r in M.meaningful_folders(img, voc, ["web"]).collect()] == [("x", "Red Boot")]
    assert F.lit(1) is not None


def test_boxes(spark):
    from weftline.functions import geometry as G

    df = spark.createDataFrame([(10.0, 20.0, 100.0, 200.0, True, 0.25, 30.0, 60.0), (0.0, 0.0, 5.0, 5.0, False, 0.1, 9.0, 9.0), (95.0, 2.5, 50.0, 3.0, False, 1.0, 100.0, 4.0)], "l double, t double, w double, h double, s boolean, k double, cw double, ch double")
    box = [F.col(c) for c in "ltwh"]
    got = [(r.a, r.b) for r in df.select(G.box_text(G.scaled_box(box, F.col("k"), F.col("cw"), F.col("ch"))).alias("a"), G.box_text(G.without_shadow(box, F.col("s"))).alias("b")).collect()]
    assert got[0] == ("2.0000,5.0000,25.0000,50.0000", "10.0000,20.0000,100.0000,188.0000")  # half to even
    assert got[1][0] == "0.0000,0.0000,1.0000,1.0000" and got[2][0] == "95.0000,2.0000,5.0000,2.0000" and got[2][1].endswith(",3.0000")
    texts = spark.createDataFrame([("1.5, 2,3.0000,-4",), ("1,2,3",), ("a,1,2,3",), (None,), ("",)], "t string")
    assert [r.b for r in texts.select(G.box_of_text(F.col("t")).alias("b")).collect()] == [[1.5, 2.0, 3.0, -4.0], None, None, None, None]


def test_stages(spark):
    from weftline.plans import stages as G

    G.register("flip", lambda a: a[:, ::-1])
    pixels = bytes(range(24))
    df = spark.createDataFrame([("a", 2, 4, 3, bytearray(pixels)), ("b", 2, 4, 3, bytearray(b"xx")), ("c", None, None, None, None)], "id string, height int, width int, channels int, data binary")
    out = {r.id: r for r in G.transformed(df, "flip").collect()}
    want = np.frombuffer(pixels, np.uint8).reshape(2, 4, 3)[..., ::-1][:, ::-1]
    assert bytes(out["a"].data) == want.tobytes() and out["a"].error is None and out["b"].error and out["c"].error and out["c"].height is None
    assert {r.id: (r.height, r.width) for r in G.transformed(df.where("id = 'a'"), "square").collect()} == {"a": (2, 2)}
    done = G.run_stages(df, [("one", lambda x: x.withColumn("n", F.length("data"))), ("two", lambda x: x.where("n > 2"))], ["id"])
    assert [r.id for r in done.collect()] == ["a"]
    with pytest.raises(ValueError, match="'drop' loses id"):
        G.run_stages(df, [("drop", lambda x: x.drop("id"))], ["id"])
