"""Sources and sinks on small files written by the tests themselves."""

import zipfile

import numpy as np
import pytest

from tablework.operators import inference
from tablework.plans import pipelines
from tablework.sources import files, workbooks


def test_csv_and_versions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name ,Unit Price\n"x, y",1.5\n ,\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Name", "Unit Price"]
    assert files.normalize_headers(df).columns == ["name", "unit_price"]
    assert [tuple(r) for r in files.trim_empty(df).collect()] == [("x, y", 1.5)]
    path = str(tmp_path / "t")
    assert files.convert(spark, str(tmp_path / "a.csv"), path).count() == 2
    first = files.snapshot(spark, path)
    files.write(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    files.restore(spark, path, first)
    assert spark.read.parquet(path).count() == 2 and len(files.list_versions(spark, path)) == 2
    files.append_receipt(spark, path, "convert", {"kind": "parquet"})
    assert files.read_receipts(spark, path).first()["tool"] == "convert"


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Value</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
    found = workbooks.cells(spark, str(tmp_path / "b.xlsx"))
    assert [(r["sheet"], r["rows"], r["cols"]) for r in workbooks.list_sheets(found).collect()] == [("One", 3, 2)]
    assert [(r["row"], r["Name"], r["Value"]) for r in workbooks.extract_sheet(found, "One").orderBy("row").collect()] == [(1, "x", "2.5"), (2, "x", None)]


def test_pipelines(spark, tmp_path):
    steps = [{"op": "abs_values", "column": "a", "name": "b"}, {"op": "sort", "by": ["b"]}]
    pipelines.save(spark, str(tmp_path / "p"), "mine", steps)
    assert pipelines.load(spark, str(tmp_path / "p"), "mine") == steps
    assert [r["b"] for r in pipelines.apply(spark.createDataFrame([(-2,), (1,)], "a long"), steps).collect()] == [1, 2]
    with pytest.raises(ValueError):
        pipelines.apply(spark.range(1), [{"op": "no"}])


def test_box_cox(spark):
    """Against the log-likelihood on a fine grid."""
    x = np.arange(1.0, 200.0) ** 2
    grid = np.arange(-2, 2, 0.0005) + 0.00025
    likely = [(k - 1) * np.log(x).sum() - len(x) / 2 * np.log(((x**k - 1) / k).var()) for k in grid]
    found = inference.box_cox(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", "y")[1]
    assert abs(found - grid[int(np.argmax(likely))]) < 0.001
