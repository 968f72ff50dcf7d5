"""Golden cases and invariants of the engine's operators."""

import datetime as dt
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corduroy.functions import numeric, text
from corduroy.operators import aggregates, cleaning, matching, models, panel, quality, routes, spatial
from corduroy.session import steps as _writer
from corduroy.sources import files, sinks

EVENT = "id long, fecha date, lat double, lon double, ruta string, fallecidos long"
DAY = dt.date(2021, 3, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, d, la, lo, r, f) for i, (d, la, lo, r, f) in enumerate(rows)], EVENT)


def matched(spark, a, b, km=0.25, days=1):
    return matching.one_to_one(matching.candidates(a, b, km, days), _writer(spark))


def test_match_same_event(spark):
    a = events(spark, [(DAY, -12.0, -77.0, "PE-1", 1)])
    b = events(spark, [(DAY, -12.0, -77.0, "PE-2", 3)])
    (row,) = matching.union_events(a, b, matched(spark, a, b)).collect()
    assert (row.fuente, row.fallecidos, row.ruta) == ("A+B", 3, "PE-1")


def test_match_is_one_to_one_and_null_safe(spark):
    a = events(spark, [(DAY, -12.0, -77.0, "r", 0), (DAY, -12.0, -77.0, "r", 0), (None, -12.0, -77.0, "r", 0), (DAY, None, -77.0, "r", 0)])
    b = events(spark, [(DAY, -12.0, -77.0, "r", 0), (DAY, -12.01, -77.0, "r", 0)])
    pairs = matched(spark, a, b).collect()
    assert [(p.a_id, p.b_id) for p in pairs] == [(0, 0)]
    s = matching.match_summary(matching.union_events(a, b, matched(spark, a, b))).first()
    assert s.n_union == s.n_a + s.n_b - s.n_ab <= s.n_naive


@pytest.mark.parametrize("days,n", [(1, 0), (4, 1)])
def test_match_tolerance(spark, days, n):
    a = events(spark, [(DAY, -12.0, -77.0, "r", 0)])
    b = events(spark, [(DAY + dt.timedelta(3), -12.0, -77.0, "r", 0)])
    assert matched(spark, a, b, days=days).count() == n
    assert matching.common_window(a, b) == (None, None)


def test_match_equals_greedy(spark):
    rng = random.Random(5)
    rows = lambda n: [(DAY, rng.randrange(8) / 1000, rng.randrange(8) / 1000, "r", 0) for _ in range(n)]
    ra, rb = rows(40), rows(40)
    got = {(p.a_id, p.b_id) for p in matched(spark, events(spark, ra), events(spark, rb)).collect()}
    free, want = set(range(40)), set()
    for j, (_, la, lo, *_r) in enumerate(rb):
        near = [(math.hypot(la - ra[i][1], (lo - ra[i][2]) * math.cos(math.radians(la))) * 111, i) for i in free if math.hypot(la - ra[i][1], lo - ra[i][2]) <= 0.25 / 111]
        if near:
            free.discard(min(near)[1])
            want.add((min(near)[1], j))
    assert got == want


def test_interval_join_first_segment_and_unassigned(spark):
    seg = spark.createDataFrame([(0, "PE-1", 0.0, 10.0), (1, "PE-1", 10.0, 20.0), (2, "PE-5", 20.0, 30.0)], "seg long, ruta string, k0 double, k1 double")
    ev = spark.createDataFrame([(1, "PE-1", 5.0), (2, "PE-5", 25.0), (3, "PE-1", 999.0), (4, "XX", 5.0), (5, "PE-1", 10.0), (6, "PE-1", None)], "id long, ruta string, km double")
    got = {r.id: r.seg for r in spatial.interval_join(ev, seg, "ruta", "km", "k0", "k1", "seg", "seg", "id", 7.0).collect()}
    assert got == {1: 0, 2: 2, 3: None, 4: None, 5: 0, 6: None}


def test_panel_and_totals(spark):
    seg = spark.createDataFrame([(i, 10) for i in range(3)], "seg_id long, long_km long")
    ev = spark.createDataFrame([(0, 2020, 1), (None, 2020, 9)], "seg_id long, anio long, fallecidos long")
    p = panel.build_panel(seg, [2020, 2021], ev)
    rows = p.collect()
    assert len(rows) == 6 and sum(r.n_eventos == 0 for r in rows) == 5 and sum(r.n_eventos for r in rows) == 1
    assert {(r.expo_km, r.expo_km_anio) for r in rows} == {(10, 20)}
    assert panel.panel_totals(p).agg(F.sum("total")).first()[0] == 1


def test_largest_remainder_conserves_totals(spark):
    df = spark.createDataFrame([(g, i, t, 1 + i % 7) for g, t in (("a", 100), ("b", 40)) for i in range(25)], "g string, i long, t long, w long")
    got = {r.g: r.s for r in aggregates.largest_remainder(df, "g", "t", "w", "i").groupBy("g").agg(F.sum("share").alias("s")).collect()}
    assert got == {"a": 100, "b": 40}


def test_eb_shrinks_and_degenerate_prior(spark):
    rng = random.Random(3)
    rows = [(i, i % 6, 1 + rng.randrange(25), 0) for i in range(400)]
    rows = [(i, g, km, sum(rng.random() < 0.02 * (g + 1) * rng.choice([0.2, 1, 3]) for _ in range(km * 5))) for i, g, km, _ in rows]
    p = panel.leave_one_out_rate(spark.createDataFrame(rows, "id long, g long, km long, y long"), "g", "y", "km")
    out = panel.shrink(p, panel.prior_strength(p, "y", "km"), "y", "km").collect()
    for r in out:
        lo, hi = sorted((r.prior, r.y / r.km))
        assert lo - 1e-9 <= r.eb <= hi + 1e-9
    flat = panel.leave_one_out_rate(spark.createDataFrame([(i, 0, 10, 1) for i in range(9)], "id long, g long, km long, y long"), "g", "y", "km")
    got = panel.shrink(flat, panel.prior_strength(flat, "y", "km"), "y", "km").collect()
    assert all(r.k_degenerate and r.eb == r.prior and r.weight == 0 for r in got)


def test_negative_binomial_recovers_coefficients(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(4)
    x, off = rng.normal(size=3000), rng.uniform(0, 1, 3000)
    mu = np.exp(0.5 + 0.8 * x + off)
    y = rng.poisson(mu * rng.gamma(1 / 0.7, 0.7, 3000))
    df = spark.createDataFrame([(float(a), 1.0, float(b), float(c)) for a, b, c in zip(y, x, off)], "y double, one double, x double, off double")
    m = models.fit_negative_binomial(df, "y", ["one", "x"], "off", grid=25)
    assert abs(m["beta"][1] - 0.8) < 0.1 and 0.4 < m["alpha"] < 1.2 and m["mcfadden"] > 0
    assert models.fit_counts(df, "y", ["one", "x"], "off")["beta"][0] == pytest.approx(0.5, abs=0.15)
    assert 85 < models.interval_coverage(models.predict(df, m), "y", "mu", m["alpha"], 0.95) <= 100


def test_contract_rules_and_quarantine(spark):
    df = spark.createDataFrame([(1, "a", -71.3), (1, "b", None), (2, None, 500.0)], "code long, clase string, lon double")
    got = {(r["column"], r.rule): r.n for r in quality.contract_report(df, {"columns": {"code": {"unique": True, "type": "integer"}, "clase": {"nullable": False, "allowed_values": ["A"]}, "lon": {"min": -90, "max": 0}, "falta": {}}, "allow_extra": False}).collect()}
    assert got == {("code", "unique"): 1, ("clase", "nullable"): 1, ("clase", "allowed_values"): 1, ("lon", "max"): 1, ("falta", "missing"): 1}
    rules = [{"name": "neg", "kind": "no_negativos", "columns": ["lon"], "severity": "critical"}]
    found = quality.violations(df.withColumn("row_id", F.monotonically_increasing_id()), rules, "row_id", "2024-01-01")
    assert found.count() == 1
    empty = quality.violations(df.limit(0).withColumn("row_id", F.lit(1)), rules, "row_id", "2024-01-01")
    assert quality.quarantine(df.limit(0).withColumn("row_id", F.lit(1)), empty, "row_id", "d").count() == 0


def test_bootstrap_holds_the_point_and_weights_sum(spark):
    df = spark.range(500).select((F.col("id") % 7 != 0).alias("a"), F.when(F.col("id") % 3 != 0, F.col("id") % 5 != 0).alias("b"))
    r = quality.bootstrap_interval(df, [F.col("a"), F.col("b")])
    assert r["low"] <= r["point"] <= r["high"]
    s = quality.weight_sensitivity({k: 50.0 for k in quality.WEIGHTS})
    assert s["spread"] == pytest.approx(0, abs=1e-9)
    assert abs(sum(quality.WEIGHTS.values()) - 1) < 1e-9
    assert quality.gate(95, 1) == "FAILED" and quality.gate(80, 0) == "WARNING" and quality.gate(95, 0) == "PASSED"


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, " Lima  ", "-71.3°", "01/02/2021"), (2, 1, "Ánc", "x", "2021-02-01"), (3, 2, "", None, None)], "row long, k long, dep string, lon string, f string")
    spec = {"fold": ["dep"], "numeric": ["lon"], "dates": {"f": ["yyyy-MM-dd", "dd/MM/yyyy"]}, "key": ["k"], "order": "row"}
    once = cleaning.clean(df, spec)
    assert [tuple(r) for r in once.orderBy("row").collect()] == [(1, 1, "LIMA", -71.3, dt.date(2021, 2, 1)), (3, 2, None, None, None)]
    assert sorted(once.collect()) == sorted(cleaning.clean(once, spec).collect(), key=lambda r: r.row) or once.exceptAll(cleaning.clean(once, spec)).isEmpty()


def test_text_and_numbers(spark):
    row = spark.range(1).select(
        text.fold(F.lit(" Áncash  norte ")).alias("a"), text.corridor(F.lit("PE-1N")).alias("b"), text.corridor(F.lit("PE-03")).alias("c"), text.alnum_key(F.lit("Vía Nº 5")).alias("d"),
        text.lat_lon(F.lit("-12.5, -77")).alias("e"), text.lat_lon(F.lit("Lima")).alias("f"), text.escape_html(F.lit('<a&"')).alias("g"), text.first_number(F.lit("km 12,5 a")).alias("h"),
        numeric.temporal_factor(F.lit(dt.datetime(2024, 1, 6, 18))).alias("i"), numeric.temporal_factor(F.lit(dt.datetime(2024, 1, 7, 23))).alias("j"), numeric.temporal_factor(F.lit(dt.datetime(2024, 1, 6, 19, 30))).alias("k"),
    ).first()
    assert (row.a, row.b, row.c, row.d, tuple(row.e), row.f, row.g, row.h) == ("ANCASH NORTE", "PE-1", "PE-03", "vian5", (-12.5, -77.0), None, "&lt;a&amp;&quot;", 12.5)
    assert (row.i, row.j, row.k) == (1.25, 1.43, 1.625)


def test_identifier_guard():
    with pytest.raises(ValueError):
        aggregates.safe_name("x; DROP TABLE y")
    with pytest.raises(ValueError):
        files.read(None, {"source_type": "nope", "path": ""})


def test_resample_and_windows(spark):
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.05), (1, 2, 0.0, 0.2)], "route_id long, i long, lat double, lon double")
    got = [r.lon for r in routes.resample(pts, 1.0).orderBy("k").collect()]
    assert len(got) == 23 and got == sorted(got) and got[0] == 0.0
    w = routes.windows(spark.createDataFrame([(0.0,), (5.0,), (7.0,)], "km double"), "km", 5.0).collect()
    assert sorted((r.km, r.win) for r in w) == [(0.0, 0), (5.0, 0), (5.0, 1), (7.0, 1)]


def test_folds_and_split(spark):
    f = models.group_folds({"a": 10, "b": 5, "c": 5, "d": 1}, 2)
    assert f["a"] != f["b"] == f["c"]
    s = models.split(spark.range(2000), "id").groupBy("is_test").count().collect()
    assert {r.is_test for r in s} == {True, False}


def test_spreadsheet_and_sinks(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>titulo</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>CÓDIGO</t></is></c><c r="B2" t="inlineStr"><is><t>km</t></is></c></row><row r="3"><c r="B3"><v>7.5</v></c><c r="A3" t="inlineStr"><is><t>x1</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    df = files.read(spark, {"source_type": "excel", "path": str(tmp_path / "a.xlsx"), "options": {"columns": ["CÓDIGO", "km"], "header_row": 1}})
    assert [tuple(r) for r in df.collect()] == [("x1", "7.5")]
    typed = sinks.coerce_types(df, ["CÓDIGO", "km"])
    assert dict(typed.dtypes) == {"CÓDIGO": "string", "km": "double"}
    root = f"file://{tmp_path}/lake"
    assert sinks.write_bronze(df, root, "d", "1", "aa")[1] and not sinks.write_bronze(df, root, "d", "1", "aa")[1] and sinks.write_bronze(df, root, "d", "1", "bb")[1]
    assert files.sniff_encoding("ñ".encode()) == "utf-8-sig" and files.sniff_encoding(b"\xf1 abcdef") == "cp1252" and files.sniff_separator("a;b;c,d") == ";"


def test_archive_stream_adds_nothing_twice(spark, tmp_path):
    from corduroy.streaming.live import archive_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "item string, n long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("item string, n long").json(str(tmp_path / "in"))
        archive_stream(stream, str(tmp_path / "out"), ["item"], str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("b", 3), ("c", 4)], "item string, n long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    assert sorted(r.item for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()) == ["a", "b", "c"]
