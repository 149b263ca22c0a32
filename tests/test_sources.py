import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import pixels as X
from weftline.operators.images import as_array, image_features
from weftline.sources import archives as A, outputs as O, workbooks as W
from weftline.streaming import progress as S

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 40
JPG = b"\xff\xd8\xff\xe0" + b"1" * 40


def workbook(sheets):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="x"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</R>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Family ID</t></si><si><r><t>Co</t></r><r><t>lor </t></r></si></sst>")
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet>{body}</worksheet>")
    return buf.getvalue()


def test_workbooks(spark, tmp_path):
    body = '<sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>30000001</v></c><c r="C2" t="inlineStr"><is><t> red </t></is></c></row><row><c r="C3"><v></v></c></row></sheetData><mergeCells><mergeCell ref="A2:A4"/><mergeCell ref="B1:C1"/></mergeCells>'
    (tmp_path / "a.xlsx").write_bytes(workbook({"One": body, "Two": ""}))
    (tmp_path / "b.csv").write_text('x,"y ""z""",\n1,2,3\n\n"open,4\n')
    (tmp_path / "c.tsv").write_text("p\tq\n")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    rows = W.read_cells(spark, str(tmp_path)).collect()
    a = {(r.row, r.col): r.value for r in rows if r.sheet == "One"}
    assert a == {(0, 0): "Family ID", (0, 2): "Color", (1, 0): "30000001", (2, 0): "30000001", (3, 0): "30000001", (1, 2): "red", (2, 2): ""}
    b = {(r.row, r.col): r.value for r in rows if r.sheet == "b"}
    assert b[0, 1] == 'y "z"' and b[1, 2] == "3" and (2, 0) not in b and (3, 0) in b
    assert [r.value for r in rows if r.sheet == "c"] == ["p", "q"]
    assert [r for r in rows if r.sheet is None and r.file.endswith("d.xlsx")]
    cells = W.read_cells(spark, str(tmp_path / "a.xlsx"))
    assert W.dense(cells).count() == 4 * 3
    down = W.filled_down(spark.createDataFrame([("f", "s", 1, 0, "v"), ("f", "s", 3, 0, "w"), ("f", "s", 5, 0, "x")], W.CELLS), spark.createDataFrame([("f", "s", 1, 3, 0)], W.MERGES))
    assert {r.row: r.value for r in down.collect()} == {1: "v", 2: "v", 3: "v", 5: "x"}


def archive(files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return buf.getvalue()


def test_archives(spark, tmp_path):
    deep = archive({"x.png": PNG})
    for _ in range(6):
        deep = archive({"n.zip": deep})
    (tmp_path / "a.zip").write_bytes(archive({"b/1.jpg": JPG, "../up.png": PNG, "/abs.png": PNG, "t.xlsx": workbook({"S": ""}), "note.txt": "hello", "in.zip": archive({"2.png": PNG}), "deep.zip": deep, "big.png": PNG + b"0" * 500}))
    (tmp_path / "bad.zip").write_bytes(b"PK no")
    found = A.read_archives(spark, str(tmp_path), A.Limits(image=300))
    got = {r.member: (r.kind, r.reason) for r in found.collect()}
    assert got["b/1.jpg"] == ("image", None) and got["in.zip/2.png"] == ("image", None) and got["t.xlsx"] == ("table", None)
    assert got["../up.png"][1] == got["/abs.png"][1] == "unsafe path" and got["note.txt"][1] == "ignored" and got["big.png"][1] == "too large" and got[None][1] == "corrupt archive"
    assert any(r == "nested too deep" for _, r in got.values())
    ok = {r.archive.rpartition("/")[2]: r for r in A.enough(found, 2, 1).collect()}
    assert ok["a.zip"].ok and ok["a.zip"].images == 2 and not ok["bad.zip"].ok


def test_triage_column(spark):
    rows = [("a.jpg", JPG, "image"), ("a", PNG, "image"), ("a.zip", archive({"x": "y"}), "archive"), ("a.xlsx", archive({"x": "y"}), "table"), ("a.docx", archive({"x": "y"}), "other"), ("a.webp", b"RIFF0000WEBP", "image"), ("a.bin", b"", "other"), ("x", b"%PDF-1", "image")]
    df = spark.createDataFrame([(n, bytearray(c), w) for n, c, w in rows], "n string, c binary, want string")
    assert df.where(A.media_kind(F.col("n"), F.col("c")) != F.col("want")).count() == 0
    assert all(A.kind_of(n, c[:16]) == w for n, c, w in rows)


@pytest.mark.parametrize(("url", "route"), [("https://www.dropbox.com/s/x", "dropbox"), ("https://we.tl/t-1", "wetransfer"), ("https://a.example/x", "https"), ("http://a.example/x", None), ("https://127.0.0.1/x", None), ("https://192.168.1.1/x", None), ("https://user@localhost/x", None), ("ftp://x", None), ("https://notdropbox.com/", "https")])
def test_routes(spark, url, route):
    assert spark.createDataFrame([(url,)], "u string").select(A.url_route(F.col("u"))).first()[0] == route


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("J", 1, "a", None), ("K", 2, None, "z")], "job string, id long, x string, y string")
    O.write_manifest(rows, rows.groupBy("job").count(), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/rows")).count() == 2
    O.write_documents(rows, "job", str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).where("job = 'J'").first().x == "a"
    parts = O.zip_parts(spark.createDataFrame([(f"f{i}.txt", bytearray(b"x" * i)) for i in range(25)], "name string, content binary").coalesce(1), 10).collect()
    assert sum(p.files for p in parts) == 25 and zipfile.ZipFile(io.BytesIO(bytes(parts[0].content))).testzip() is None
    assert {tuple(json.loads(r.json).items()) for r in O.as_map(rows, "job", "x").collect()} == {(("J", "a"),), (("K", None),)}
    c = tmp_path / "c.json"
    c.write_text('{ // note\n "Match": {"Shared": {"Ratio": 0.5, /* more */ "url": "http://x//y",},}}')
    assert O.section(str(c), "match", "shared", required=("ratio",)) == {"ratio": 0.5, "url": "http://x//y"}
    for bad in (("none",), ("match", "none")):
        with pytest.raises(KeyError):
            O.section(str(c), *bad)
    with pytest.raises(KeyError):
        O.section(str(c), "match", required=("gone",))


def test_streams(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    latest = S.run_to_table(S.latest_states(S.event_stream(spark, sf)), "t")
    assert latest.count() == ev.select("user_id").distinct().count()
    assert S.run_to_table(S.once_each(S.event_stream(spark, sf)).select("event_id"), "t", "append").count() == ev.select("event_id").distinct().count()


def test_pixels():
    a = np.full((60, 80, 3), 255, np.uint8)
    a[20:40, 30:50] = (200, 30, 30)
    assert X.subject_box(a) == (30, 20, 20, 20) and X.touched_edges(X.subject_box(a), 60, 80) == "" and X.background(a)["kind"] == "SOLIDCOLOR" and X.background(a)["near_white"] == 1
    assert X.difference_hash(a) == X.difference_hash(np.repeat(np.repeat(a, 2, 0), 2, 1)) != X.difference_hash(255 - a)
    assert X.centred_square(a).shape == (60, 60, 3) and X.detail_crop(a, "l")[:, :1].tolist() == a[:60, :1].tolist()
    assert X.colour_clusters(a) == 2 and X.exposure(a)[1] > 0.8 and not X.illustration(a)
    c = X.centred_on_canvas(a)
    assert c.shape[0] == c.shape[1] >= 20
    assert X.stretched(a, 5, 5, 5, 5).shape == (70, 90, 3) and X.stretched(a, 90, 0, 0, 0)[0, 0].tolist() == [255, 255, 255]
    g = np.tile(np.arange(100, 140, dtype=np.uint8), (40, 1))
    assert X.equalized(g).std() > g.std() and X.equalized(np.zeros((4, 4), np.uint8)).shape == (4, 4)
    assert X.feathered(a, a, 10).shape == (60, 150, 3) and X.resized(a, 8, 17).shape == (8, 17, 3)
    assert X.subject_box(np.zeros((5, 5), np.uint8)) == (0, 0, 5, 5) and X.edge_density(np.zeros((1, 1), np.uint8)) == 0


def test_image_features(spark):
    a = np.full((20, 30, 3), 255, np.uint8)
    a[5:10, 10:20] = 0
    rows = [("ok", 20, 30, 3, bytearray(a[..., ::-1].tobytes())), ("short", 20, 30, 3, bytearray(b"1")), ("none", None, None, None, None), ("alpha", 2, 2, 4, bytearray(16))]
    got = {r.id: r for r in image_features(spark.createDataFrame(rows, "id string, height int, width int, channels int, data binary")).collect()}
    assert got["ok"].box == [10, 5, 10, 5] and got["ok"].route == "centre" and got["short"].box is None and got["none"].width is None
    assert as_array(bytes(16), 2, 2, 4).tolist() == np.full((2, 2, 3), 255).tolist() and got["alpha"].bright == 1


def test_once_each_over_many_files(spark, tmp_path):
    import datetime as dt
    rows = [(i % 100, dt.datetime(2024, 1, 1) + dt.timedelta(days=37 * i % 300), "view") for i in range(200)]
    for n in range(20):
        spark.createDataFrame(rows[n::20], "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = S.run_to_table(S.once_each(S.event_stream(spark, str(tmp_path))).select("event_id"), "t", "append")
    assert sorted(r.event_id for r in got.collect()) == list(range(100))
