import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyhouse.sources import layouts, sinks, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def xlsx(rows):
    body = "".join(
        f'<row r="{i + 1}">' + "".join(
            f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i + 1}"><v>{v}</v></c>'
            for j, v in enumerate(r) if v is not None
        ) + "</row>" for i, r in enumerate(rows)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Data" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx([["A title"], [None, "notes"], ["URN", "LA  name", "URN"], [1, "x", 9], [2, None, 8]]))
    (tmp_path / "bad.xlsx").write_bytes(b"nothing")
    ods = io.BytesIO()
    x = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = '<table:table-cell office:value-type="{}" {}><text:p>{}</text:p></table:table-cell>'
    with zipfile.ZipFile(ods, "w") as z:
        z.writestr("content.xml", f'<d {x}><table:table table:name="T"><table:table-row>{cell.format("string", "", "urn")}{cell.format("string", "", "n")}</table:table-row>'
                   f'<table:table-row table:number-rows-repeated="2">{cell.format("float", "office:value=\"5\" table:number-columns-repeated=\"2\"", "5")}</table:table-row></table:table></d>')  # fmt: skip
    (tmp_path / "b.ods").write_bytes(ods.getvalue())
    cells, rejects = workbooks.workbook_cells(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in rejects.collect()] == ["bad.xlsx"]
    rows = sorted((r.sheet, r.row_no, tuple(sorted(r["values"].items()))) for r in workbooks.sheet_rows(cells, "urn").collect())
    assert rows == [("Data", 3, (("LA name", "x"), ("URN", "1"))), ("Data", 4, (("URN", "2"),)), ("T", 1, (("n", "5"), ("urn", "5"))), ("T", 2, (("n", "5"), ("urn", "5")))]


def test_csv_after_preamble(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes("Some title\r\n\r\nurn , Name,Town\r\n1,Caf\xe9,X\r\n,,\r\n2,B\r\n".encode("cp1252"))
    got = [tuple(r) for r in workbooks.csv_after_preamble(spark, str(p), "urn").collect()]
    assert got == [("1", "Café", "X"), ("2", "B", None)]
    with pytest.raises(ValueError, match="no header"):
        workbooks.csv_after_preamble(spark, str(p), "nothing")


def test_features(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    doc = {"features": [{"properties": {"code": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"code": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    got = {r.code: len(r.rings) for r in workbooks.features(spark, str(tmp_path / "g.json"), ["code"]).collect()}
    assert got == {"A": 1, "B": 2}


def test_pages(spark):
    df = spark.createDataFrame([(1, "<title> T </title><script>x</script><a href='u'>We have 1,200 pupils</a>"), (2, None), (3, "")], "id int, html string")
    rows = {r.id: r for r in workbooks.page_links(df, "html").collect()}
    assert (rows[1].title, rows[1].links, rows[1].text) == ("T", ["u"], "T We have 1,200 pupils")
    assert rows[3].title is None
    assert [r.number for r in workbooks.near_numbers(workbooks.page_links(df, "html"), "text", "have").collect()] == [1200.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "x" * 50, "k"), ("b", None, "y", "k")], "id string, v double, note string, la string")
    got = {r.id: (json.loads(r.doc), r.dropped) for r in sinks.shrink_to_budget(df, ["id", "v", "note"], ["note", "v"], 30).collect()}
    assert got["a"] == ({"id": "a", "v": 1.0}, ["note"])
    assert got["b"] == ({"id": "b", "note": "y"}, [])
    with pytest.raises(Exception, match="exceeds its budget"):
        sinks.shrink_to_budget(df, ["id", "v", "note"], ["note"], 5).collect()
    assert {len(r.path) for r in sinks.unique_paths(df, "la", "id").collect()} == {8}
    for _ in range(2):
        sinks.write_documents(df, str(tmp_path / "out"), "la")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="not a number"):
        sinks.no_nan(df.withColumn("v", F.lit(float("nan")))).collect()


def test_layouts(spark):
    html = "<table><tr><th>School</th><th>2023</th><th>Entry 2024</th></tr><tr><td>Mill <b>Lane</b></td><td>1.25 km</td><td>All offered</td></tr><tr><td>Moss</td><td>n/a</td><td>0.5</td></tr></table>"
    got = {(r.name, r.year): (r.value, r.note) for r in layouts.LAYOUTS["html year columns"](spark.createDataFrame([(1, html)], "doc int, html string")).collect()}
    assert got == {("Mill Lane", 2023): (0.777, None), ("Mill Lane", 2024): (None, "all offered"), ("Moss", 2023): (None, "not applicable"), ("Moss", 2024): (0.5, None)}
    lines = spark.createDataFrame([(1, "Mill Lane  distance 804.672 m"), (1, "page 3"), (1, " ")], "doc int, line string")
    got = {r.name: (r.value, r.note) for r in layouts.LAYOUTS["lines by pattern"](lines, r"^(.*?)\s+distance (.*)$", 2024).collect()}
    assert got == {"Mill Lane": (0.5, None), "page 3": (None, "unmatched")}
    words = [(1, 1, "Mill", 10.0, 20.0, 100.0), (1, 1, "Lane", 22.0, 30.0, 101.0), (1, 1, "0.4", 100.0, 110.0, 100.5), (1, 1, "Moss", 10.0, 20.0, 120.0), (1, 1, "0.9", 101.0, 111.0, 120.0)]
    df = spark.createDataFrame(words, "doc int, page int, text string, x0 double, x1 double, top double")
    got = {r.name: r.value for r in layouts.LAYOUTS["words in columns"](df, {"name": 20.0, "y": 105.0}, "name", {"y": 2024}).collect()}
    assert got == {"Mill Lane": 0.4, "Moss": 0.9}


def test_csv_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿A list\n\nURN , Name\n1,\"St Mary's\nSchool\"\n,\n2\n3,x,y\n".encode())
    (tmp_path / "b.csv").write_bytes("name,urn,x\nCaf\xe9,4,\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text("nothing\n")
    rows, rejects = workbooks.csv_files(spark, str(tmp_path / "*.csv"), "urn", ["urn", "name", "town"])
    assert sorted((r.urn, r.name, r.town) for r in rows.collect()) == [("1", "St Mary's\nSchool", None), ("2", None, None), ("4", "Café", None)]
    got = sorted((r.path[-5:], r.reason) for r in rejects.collect())
    assert got == [("a.csv", "more cells than headers"), ("a.csv", "no column town"), ("b.csv", "no column town"), ("c.csv", "no header with urn")]
    assert {tuple(r) for r in workbooks.csv_after_preamble(spark, str(tmp_path / "[ab].csv"), "URN").collect()} == {("1", "St Mary's\nSchool"), ("2", None), ("4", "Café")}


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, [2, "]"] , "t"]')
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": ')
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "d.json").write_text("[]")
    rows, rejects = workbooks.json_array(spark, str(tmp_path / "*.json"))
    assert sorted((r.path[-6:], r.pos, r.doc) for r in rows.collect()) == [("a.json", 0, '{"x": 1}'), ("a.json", 1, '[2, "]"]'), ("a.json", 2, '"t"'), ("b.json", 0, '{"x": 1}')]
    assert sorted((r.path[-6:], r.reason) for r in rejects.collect()) == [("b.json", "cut off"), ("c.json", "no array")]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "e.json").write_text("")
    with pytest.raises(ValueError):
        workbooks.json_lines(spark, str(tmp_path / "lines"), "x int")
