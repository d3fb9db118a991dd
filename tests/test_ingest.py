"""Delimited files in several encodings, tables within sheets, features, and workspaces."""

import json
import zipfile

import pytest

from tablework.sources import files, geography, workbooks
from tablework.sources.workspaces import Workspace, read_table, resolve


def put(path, data):
    path.write_bytes(data)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_encodings(spark, tmp_path):
    text = "name,n\nZoë €5,1\n“x”,2\n"
    for name, data in (("a", text.encode()), ("b", b"\xef\xbb\xbf" + text.encode()), ("c", text.encode("cp1252"))):
        df = files.read_csv(spark, put(tmp_path / f"{name}.csv", data))
        assert df.columns == ["name", "n"] and rows(df) == [("Zoë €5", 1), ("“x”", 2)], name
    df = files.read_csv(spark, put(tmp_path / "d.csv", "näme,n\n\x81é,1\n".encode("latin-1")))
    assert df.columns == ["näme", "n"] and rows(df) == [("\x81é", 1)]
    assert {(r["file"].rpartition("/")[2], r["encoding"]) for r in files.layouts(spark, str(tmp_path)).collect()} == {("a.csv", "UTF-8"), ("b.csv", "UTF-8"), ("c.csv", "windows-1252"), ("d.csv", "ISO-8859-1")}
    given = files.read_csv(spark, str(tmp_path / "c.csv"), encoding="ISO-8859-1")
    assert rows(given)[0] == ("Zoë \x805", 1)


def test_ragged_and_missing(spark, tmp_path):
    data = b'a, b ,a,\n1,NaN,x,9\n2,,y\n3,4.5,z,1,extra\n"4",NA,"q, r",2\n5,null,,3\n'
    df = files.read_csv(spark, put(tmp_path / "a.csv", data))
    assert df.columns == ["a", "b", "a.1", "Unnamed: 3"] and [t for _, t in df.dtypes] == ["bigint", "double", "string", "bigint"]
    assert rows(df) == [(1, None, "x", 9), (2, None, "y", None), (4, None, "q, r", 2), (5, None, None, 3)]
    assert df.count() == 4 and rows(df.select("b")) == [(None,)] * 4
    df = files.read_csv(spark, put(tmp_path / "b.csv", b"t,u,v,w,e\nTrue,1,1e3,2020-01-01,\nfalse,99999999999999999999,-.5,x1,NA\n"))
    assert [t for _, t in df.dtypes] == ["boolean", "double", "double", "string", "double"]
    assert rows(df) == [(True, 1.0, 1000.0, "2020-01-01", None), (False, 1e20, -0.5, "x1", None)]
    assert rows(files.read_csv(spark, put(tmp_path / "c.csv", b"x\n1f\n2d\n"), infer=True)) == [("1f",), ("2d",)]
    assert files.read_csv(spark, str(tmp_path / "a.csv"), max_rows=2).count() == 2
    assert [t for _, t in files.read_csv(spark, str(tmp_path / "a.csv"), infer=False).dtypes] == ["string"] * 4


def test_quoted_line_breaks(spark, tmp_path):
    data = 'k;text\n1;"two\nlines; ""quoted"""\n2;"é"\n'
    for code in ("utf-8", "cp1252"):
        df = files.read_csv(spark, put(tmp_path / f"{code}.csv", data.encode(code)), separator=";")
        assert rows(df) == [(1, 'two\nlines; "quoted"'), (2, "é")]


def test_empty_files_and_folders(spark, tmp_path):
    assert files.read_csv(spark, put(tmp_path / "e.csv", b"")).columns == []
    assert rows(files.read_csv(spark, put(tmp_path / "h.csv", b"a,b\n"))) == []
    (tmp_path / "f").mkdir()
    put(tmp_path / "f/1.csv", "a,b\n1,é\n".encode())
    put(tmp_path / "f/2.csv", "a,b\n2,é\n".encode("cp1252"))
    assert sorted(rows(files.read_csv(spark, str(tmp_path / "f")))) == [(1, "é"), (2, "é")]


def test_promote_header(spark, tmp_path):
    path = put(tmp_path / "p.csv", b"report,,\nid,NA,x\n1,2,3\n4,5,six\n")
    df = files.promote_header(spark, path, 1)
    assert df.columns == ["id", "col_1", "x"] and rows(df) == [(1, 2, "3"), (4, 5, "six")]
    with pytest.raises(ValueError):
        files.promote_header(spark, path, 9)


def workbook(path, sheets):
    """An .xlsx file; sheets: name to {cell: text}, and merged ranges."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (cells, merged) in enumerate(sheets.values()):
            lines: dict = {}
            for (r, c), text in cells.items():
                lines.setdefault(r, []).append(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{text}</t></is></c>')
            body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(lines.items()))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData><mergeCells>{''.join(f'<mergeCell ref={chr(34)}{m}{chr(34)}/>' for m in merged)}</mergeCells></worksheet>")
    return str(path)


def grid(top, left, table):
    return {(top + i, left + j): v for i, row in enumerate(table) for j, v in enumerate(row) if v is not None}


def test_tables_within_sheets(spark, tmp_path):
    """Two tables one above the other, two side by side, a title alone, and a blank cell that is none."""
    one, two, side = [["A", "B"], ["1", "2"], ["3", None]], [["X", "Y", "X"], ["7", "8", "9"]], [["P", "Q"], ["u", "v"]]
    cells = grid(0, 0, one) | grid(5, 0, two) | grid(5, 5, side) | {(9, 1): "title"} | {(3, 0): "  "}
    path = workbook(tmp_path / "m.xlsx", {"S": (cells, []), "Empty": ({}, []), "T": (grid(2, 1, one), ["B1:C1"])})
    found = workbooks.cells(spark, path, fill=False)
    got = sorted(tuple(r)[1:] for r in workbooks.detect_tables(found).collect())
    assert got == [("S", 0, 0, 2, 0, 1, 3, 2), ("S", 1, 5, 6, 0, 2, 2, 3), ("S", 2, 5, 6, 5, 6, 2, 2), ("T", 0, 2, 4, 1, 2, 3, 2)]
    assert [tuple(r)[2:] for r in workbooks.detect_tables(found, 1, 1).where("sheet = 'S' and rows = 1").collect()] == [(3, 9, 9, 1, 1, 1, 1)]
    second = workbooks.extract_table(found, "S", 1)
    assert second.columns == ["path", "row", "X", "Y", "X.1"] and [tuple(r)[1:] for r in second.collect()] == [(6, "7", "8", "9")]
    assert [tuple(r)[1:] for r in workbooks.extract_table(found, "S", 0).orderBy("row").collect()] == [(1, "1", "2"), (2, "3", None)]
    with pytest.raises(ValueError):
        workbooks.extract_table(found, "S", 9)
    out = workbooks.extract_all_sheets(spark, path, str(tmp_path / "out"))
    assert [(s, n) for s, _, n in out] == [("S", 6), ("T", 2)]
    assert rows(files.read_csv(spark, out[1][1])) == [(1, 2.0), (3, None)]


FEATURES = [
    ({"name": "North", "code": "01", "pop": 10, "x": None}, {"type": "Polygon", "coordinates": [[[0, 0], [1.5, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.1, 0.1]]]}),
    ({"name": "South", "code": "2", "pop": 2.5, "x": None}, {"type": "Point", "coordinates": [1e-7, -3]}),
    ({"name": "East", "code": "2", "pop": None, "x": None}, None),
    ({"name": "Far", "code": None, "pop": 4, "x": None}, {"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[1, 2, 3]]}, {"type": "LineString", "coordinates": []}]}),
]
TEXTS = ["POLYGON ((0 0, 1.5 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.1 0.1))", "POINT (1e-07 -3)", None, "GEOMETRYCOLLECTION (MULTIPOINT Z ((1 2 3)), LINESTRING EMPTY)"]


def geojson(path, features):
    return put(path, json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}, indent=1).encode())


def test_geojson(spark, tmp_path):
    path = geojson(tmp_path / "g.geojson", FEATURES)
    df = geography.read_geojson(spark, path, rename="region")
    assert set(df.columns) == {"region", "code", "pop", "x", "geometry"}
    assert [(r["region"], r["code"], None if r["pop"] is None else float(r["pop"]), r["geometry"]) for r in df.collect()] == [("North", "01", 10.0, TEXTS[0]), ("South", "2", 2.5, TEXTS[1]), ("East", "2", None, None), ("Far", None, 4.0, TEXTS[3])]
    assert geography.read_geojson(spark, path, keep=["pop", "nope"]).columns == ["pop", "geometry"]
    assert rows(geography.read_geojson(spark, geojson(tmp_path / "e.geojson", []))) == []
    assert rows(geography.read_geojson(spark, geojson(tmp_path / "n.geojson", [(None, FEATURES[1][1]), ({}, None)]))) == [(TEXTS[1],), (None,)]
    with pytest.raises(ValueError):
        geography.well_known_text({"type": "Circle", "coordinates": [1]})


def test_geo_joins(spark, tmp_path):
    geo = geography.read_geojson(spark, geojson(tmp_path / "g.geojson", FEATURES))
    df = spark.createDataFrame([(1, "2", 5.0), (2, "01", 1.0), (3, "9", 2.0), (4, None, 3.0), (5, "2", 7.0)], "pop long, area string, v double")
    got = geography.enrich(df, geo.select("code", "name", "pop", "geometry"), "area", "code")
    assert got.columns == ["pop_x", "area", "v", "code", "name", "pop_y", "geometry"]
    assert sorted((r["pop_x"], r["name"]) for r in got.where("name is not null").collect()) == [(1, "East"), (1, "South"), (2, "North"), (5, "East"), (5, "South")]
    assert got.where("name is null").count() == 2
    same = geography.enrich(df.withColumnRenamed("area", "code"), geo, "code", "code")
    assert same.columns.count("code") == 1 and same.count() == 7
    assert sorted(rows(geography.match_report(df, geo, "area", "code"))) == [("main", "9")]
    totals = {(r["region"], r["geometry"]): r["value"] for r in geography.region_totals(df, geo, "area", "code", "v").collect()}
    assert totals == {("01", TEXTS[0]): 1.0, ("2", TEXTS[1]): 12.0, ("2", None): 12.0, (None, TEXTS[3]): None}
    with pytest.raises(ValueError):
        geography.enrich(df, geo, "nope", "code")


def test_workspace(spark, tmp_path):
    base = str(tmp_path / "w")
    with pytest.raises(FileNotFoundError):
        Workspace(spark, base, "mine").open()
    w = Workspace(spark, base, "mine").create("what for")
    with pytest.raises(FileExistsError):
        Workspace(spark, base, "mine").create()
    source = put(tmp_path / "a.csv", b"x,y\n-3,a\n1,b\n2,NA\n")
    assert w.register(source, "start", active=True)["rows"] == 3
    with pytest.raises(ValueError):
        w.register(source, "bad", stage="nope")
    with pytest.raises(FileNotFoundError):
        w.register(str(tmp_path / "none.csv"), "none")
    with pytest.raises(ValueError):
        w.save_pipeline("p", [{"op": "nope"}])
    w.save_pipeline("p", [{"op": "filter_between", "column": "x", "min": -5, "max": 1}, {"op": "abs_values", "column": "x", "name": "z"}])
    assert sorted(rows(w.run_pipeline("p", "start", "done"))) == [(-3, "a", 3), (1, "b", 1)]
    assert w.table("start").count() == 3  # the input stays as it was
    w.run_pipeline("p", "start", "done", "trial")
    seen = w.open()
    assert seen["description"] == "what for" and seen["active_file"] == "start" and seen["pipelines"] == ["p"]
    assert {a: (f["stage"], f["rows"]) for a, f in seen["aliases"].items()} == {"start": ("raw", 3), "done": ("trial", 2)} and len(seen["history"]) == 2
    assert [r["alias"] for r in w.files("trial").collect()] == ["done"] and w.files().count() == 2 and w.files("output").count() == 0
    for name in ("workspace:mine/start", "project:mine/start", source):
        assert resolve(spark, name, base).count() == 3
    with pytest.raises(KeyError):
        resolve(spark, "workspace:mine/none", base)
    with pytest.raises(ValueError):
        Workspace(spark, base, "../up")
    # two changes from one version: the second is told
    a, b = w.manifest(), w.manifest()
    w._store(a)
    with pytest.raises(RuntimeError):
        w._store(b)
    assert read_table(spark, put(tmp_path / "t.tsv", b"a\tb\n1\t2\n")).columns == ["a", "b"]
