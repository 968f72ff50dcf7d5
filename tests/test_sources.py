"""Readers on small files of each kind."""

import hashlib
import json
import struct
import zipfile

import pytest

from corduroy.sources import files


def test_csv_in_other_encodings_with_dates_and_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("código;fecha;km\nñ€;20240131;1.5\nx;no;y\n".encode("cp1252"))
    df = files.read_csv(spark, f"file://{tmp_path}/a.csv", sep="auto", encoding="auto", dates={"fecha": ["yyyyMMdd"]}, numeric=["km"])
    assert [(r["código"], str(r.fecha), r.km) for r in df.collect()] == [("ñ€", "2024-01-31", 1.5), ("x", "None", None)]
    (tmp_path / "b.csv").write_bytes("\ufeffid,v\n1,ü\n".encode())
    assert [r.asDict() for r in files.read_csv(spark, f"file://{tmp_path}/b.csv", encoding="auto").collect()] == [{"id": "1", "v": "ü"}]


def test_json_by_rows_keys_and_columns(spark, tmp_path):
    for name, value in (("r", [{"a": 1, "b": "x"}]), ("i", {"k": {"a": 1, "b": "x"}}), ("c", {"a": {"k": 1, "l": 2}, "b": {"k": "x"}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    read = lambda name, **o: [r.asDict() for r in files.read_json(spark, f"file://{tmp_path}/{name}.json", "a long, b string", **o).collect()]
    assert read("r") == [{"a": 1, "b": "x"}]
    assert read("i", orient="index") == [{"key": "k", "a": 1, "b": "x"}]
    assert sorted(read("c", orient="columns"), key=str) == [{"key": "k", "a": 1, "b": "x"}, {"key": "l", "a": 2, "b": None}]


def test_geojson_points_lines_and_polygons(spark, tmp_path):
    shape = lambda kind, c, n: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {"n": n}}
    features = [shape("Point", [-77.0, -12.0], 1), shape("LineString", [[1.0, 2.0], [3.0, 4.0]], 2), shape("Polygon", [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]], 3), shape("MultiPoint", [[1.0, 1.0]], 4)]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {r.n: r for r in files.read_geojson(spark, f"file://{tmp_path}/g.json", "n long").collect()}
    assert (rows[1].lon, rows[1].lat, rows[2].coords, len(rows[3].coords), rows[4].coords) == (-77.0, -12.0, [[1.0, 2.0], [3.0, 4.0]], 3, None)
    assert files.read_geojson(spark, f"file://{tmp_path}/g.json", "n long", ["Point"]).count() == 1


def test_shapefile_with_two_parts(spark, tmp_path):
    points = [(0.0, 0.0), (1.0, 0.0), (5.0, 5.0), (6.0, 5.0)]
    body = struct.pack("<I4d2I2I", 3, 0, 0, 6, 5, 2, 4, 0, 2) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "r.shp").write_bytes(bytes(100) + struct.pack(">2I", 1, len(body) // 2) + body)
    field = b"RUTA".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15)
    (tmp_path / "r.dbf").write_bytes(bytes(4) + struct.pack("<IHH", 1, 65, 7) + bytes(20) + field + b"\r" + b" PE-1  ")
    (row,) = files.read_shapefile(spark, f"file://{tmp_path}", ["RUTA"]).collect()
    assert (row.RUTA, row.coords, row.parts) == ("PE-1", [list(p) for p in points], [0, 2])


def test_sheets_by_name_and_columns_by_letter(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Otra" sheetId="1"/><sheet name="Datos" sheetId="2"/></sheets></workbook>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/worksheets/sheet1.xml", sheet.replace("<v>1</v>", "<v>9</v>"))
        z.writestr("xl/worksheets/sheet2.xml", sheet)
    at = f"file://{tmp_path}/b.xlsx"
    assert [tuple(r) for r in files.read_excel(spark, at, ["a", "b"], sheet="Datos").collect()] == [("1", "2")]
    assert [tuple(r) for r in files.read_excel(spark, at, {"B": "km", "D": "none"}, sheet=1).collect()] == [("2", None)]
    with pytest.raises(ValueError):
        files.sheet_rows((tmp_path / "b.xlsx").read_bytes(), "Nada")


def test_file_facts_are_those_of_the_bytes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 9_000_000)
    (row,) = files.file_facts(spark, f"file://{tmp_path}/a.bin").collect()
    assert (row.size, row.md5, row.sha256) == (9_000_000, hashlib.md5(b"x" * 9_000_000).hexdigest(), hashlib.sha256(b"x" * 9_000_000).hexdigest())
