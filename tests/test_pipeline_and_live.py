"""The dataset pipeline end to end, and live operators."""

import json

from pyspark.sql import functions as F

from corduroy import pipeline
from corduroy.operators import live, quality, spatial

SPEC = {
    "clean": {"rename": {"CÓDIGO": "codigo"}, "fold": ["region"], "numeric": ["velocidad"], "dates": {"fecha": ["yyyyMMdd"]}, "key": ["codigo"], "order": "codigo"},
    "contract": {"columns": {"codigo": {"type": "string", "nullable": False, "unique": True}, "velocidad": {"type": "float", "min": 1, "max": 300}}},
    "quality": {"required": ["codigo", "fecha"], "ranges": {"velocidad": (1, 300)}, "key": "codigo", "nominal": ["region"], "date": "fecha"},
    "rules": [{"name": "velocidad", "kind": "rango", "column": "velocidad", "min": 1, "max": 300, "severity": "critical"}],
    "row_id": "codigo",
    "aggregations": [{"name": "por_region", "kind": "count_by", "by": "region"}],
}


def source(tmp_path, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / "a.csv").write_text("CÓDIGO;region;fecha;velocidad\n" + rows, encoding="utf-8")
    return SPEC | {"source": {"source_type": "csv", "path": f"file://{tmp_path}/in", "options": {"sep": ";"}}}


def test_all_stages(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    spec = source(tmp_path, "1;Lima;20240102;90°\n2;áncash;20240103;100\n2;áncash;20240103;100\n")
    out = pipeline.run_dataset(spark, "d", spec, root, "2024-01-31")
    assert out["status"] == "OK" and out["gate"] == "PASSED" and out["model_ready"] and set(out["stages"].values()) == {"OK"}, out
    assert spark.read.parquet(out["gold"]).count() == 2
    assert spark.read.schema("x string").json(f"{root}/quarantine/d/{out['run_id']}").count() == 0
    again = pipeline.run_dataset(spark, "d", spec, root, "2024-01-31")
    assert not again["bronze_written"] and again["dqs"] == out["dqs"]
    runs = quality.run_drift(pipeline.manifests(spark, root).select("dataset", "fingerprint", "dqs")).first()
    assert (runs.n_runs, runs.dqs_range, runs.verdict) == (2, 0.0, "stable")


def test_failed_gate_keeps_gold_away(spark, tmp_path):
    out = pipeline.run_dataset(spark, "d", source(tmp_path, "1;LIMA;20240102;900\n"), f"file://{tmp_path}/lake", "2024-01-31")
    assert out["status"] == "OK" and out["gate"] == "FAILED" and "gold" not in out and "silver" in out
    record = spark.read.json(f"file://{tmp_path}/lake/quarantine/d/{out['run_id']}").first()
    assert record.rule == "velocidad" and json.loads(record.record)["codigo"] == "1"


def test_reports_and_titles(spark):
    df = spark.createDataFrame([("bache", "x", "  hoyo   grande ", -12.0, -77.0, None), ("otro", "alta", "abcdef", -12.0, -77.0, "f"), ("bache", "alta", "abc", -12.0, -77.0, None), ("bache", "alta", "abcdef", 50.0, -77.0, None)], "tipo string, severidad string, descripcion string, lat double, lon double, foto string")
    rows = live.check_reports(df, ["bache"], ["media", "alta"], (-18.5, 0.2, -81.5, -68.5)).collect()
    assert [r.motivo for r in rows] == [None, "tipo", "descripcion", "posicion"] and (rows[0].descripcion, rows[0].severidad) == ("hoyo grande", "media")
    t = spark.range(1).select(*[c.alias(k) for k, c in live.parse_title(F.lit("Reporte 12 - 5/01/2024 - 13:45 horas – Distrito de Ate, provincia de Lima")).items()]).first()
    assert (str(t.fecha), t.hora, t.distrito, t.provincia) == ("2024-01-05", "13:45", "Ate", "Lima")


def test_near_route_and_polygons(spark):
    samples = spark.createDataFrame([("r", -12.0, -77.0), ("r", -12.0, -76.9), ("q", 5.0, 5.0)], "route_id string, s_lat double, s_lon double")
    pts = spark.createDataFrame([(1, -12.01, -77.0), (2, -13.0, -77.0)], "id long, lat double, lon double")
    got = live.near_route(pts, samples, 2.0).collect()
    assert [(r.route_id, r.id) for r in got] == [("r", 1)] and 1.0 < got[0].dist_km < 1.2
    ring = "array<struct<x: double, y: double>>"
    poly = spark.createDataFrame([(1, [(-78.0, -13.0), (-76.0, -13.0), (-76.0, -11.0), (-78.0, -11.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (3, [(4.0, 4.9), (6.0, 4.9), (6.0, 4.8)])], f"polygon_id long, ring {ring}")
    assert sorted((r.polygon_id, r.route_id) for r in live.warnings_on_route(poly, samples, 0.15).collect()) == [(1, "r"), (3, "q")]
    assert spatial.first_containing(spark.createDataFrame([("ATE",), ("ZZ",)], "name string"), spark.createDataFrame([("LIMA ATE", "p1", 2), ("ATE VITARTE", "p2", 1)], "key string, place string, ord int")).where("name = 'ATE'").first().place == "p2"
