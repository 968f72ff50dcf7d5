"""Audit operators and small expressions."""

import datetime as dt

from pyspark.sql import functions as F

from corduroy.functions import geo, text
from corduroy.operators import audit


def test_audit(spark):
    df = spark.createDataFrame([(1, "lima", dt.date(2020, 1, 1)), (2, "Áncash", dt.date(2022, 1, 1)), (3, None, None)], "k long, dep string, f date")
    c = audit.catalog_circularity(df, "dep", ["LIMA", "PUNO"]).first()
    assert (c.n_seen, c.n_known, c.pct_known, c.examples) == (2, 1, 50.0, ["ANCASH"])
    v = audit.vocabulary_overlap(df, "dep", df.where("k = 1"), "dep").first()
    assert (v.n_a, v.n_b, v.n_both, v.jaccard, v.verdict) == (2, 1, 1, 0.5, "distinto")
    assert [tuple(r) for r in audit.imputation_audit(df, {"dep": "mode", "x": "median"}).collect()] == [("dep", "mode", 1, 33.33)]
    got = {r.claim: r.verdict for r in audit.assess(df, {"required": ["k", "dep"], "key": "k", "date": "f"}, "2022-06-01").collect()}
    assert got["La cobertura no tiene anios vacios"] == "NO" and got["El intervalo contiene al puntaje"] == "SI"


def test_expressions(spark):
    row = spark.range(1).select(
        text.departure(F.lit("2024-01-06 18:00")).alias("a"), text.redate(F.lit("20240106")).alias("b"), text.ramp(F.lit(0.5), (0, 0, 0), (255, 255, 255)).alias("c"),
        geo.round_coords(F.array(F.array(F.lit(1.234567), F.lit(2.0))), 2).alias("d"), geo.point_at(F.array(*[F.lit(i) for i in range(5)]), F.lit(0.5)).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (dt.datetime(2024, 1, 6, 18), "06/01/2024", "#808080", [[1.23, 2.0]], 2)
