"""Audit of the quality measurement itself: coverage, circular catalogues, vocabularies, integrity, imputation, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .aggregates import year_coverage
from .live import claims
from .quality import bootstrap_score, dimensions, sensitivity_verdict, weight_sensitivity


def catalog_circularity(df: DataFrame, column: str, catalog: list[str]) -> DataFrame:
    """One row: values seen, values in the catalogue, share of seen values that it holds, and up to five that it lacks."""
    known = df.sparkSession.createDataFrame([(v,) for v in catalog], "v string").select(fold(F.col("v")).alias("v")).distinct().withColumn("ok", F.lit(True))
    seen = df.select(fold(F.col(column)).alias("v")).where("v IS NOT NULL").distinct().join(known, "v", "left")
    lacking = seen.where("ok IS NULL").orderBy("v").limit(5).agg(F.collect_list("v").alias("examples"))
    return seen.agg(F.count("*").alias("n_seen"), F.count("ok").alias("n_known"), F.round(100.0 * F.try_divide(F.count("ok"), F.count("*")), 2).alias("pct_known")).join(lacking)


def vocabulary_overlap(a: DataFrame, a_column: str, b: DataFrame, b_column: str) -> DataFrame:
    """One row: sizes of both vocabularies, of what they share, the Jaccard index and its verdict."""
    x, y = a.select(fold(F.col(a_column)).alias("v")).where("v IS NOT NULL").distinct(), b.select(fold(F.col(b_column)).alias("v")).where("v IS NOT NULL").distinct()
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "v", "full_outer")
    row = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count("*").alias("n_any"))
    j = F.round(F.try_divide(F.col("n_both"), F.col("n_any")), 4)
    return row.withColumn("jaccard", j).withColumn("verdict", F.when(j >= 0.95, "igual").when(j >= 0.80, "parcial").otherwise("distinto"))


def imputation_audit(df: DataFrame, plan: dict) -> DataFrame:
    """column, strategy, n_null, pct_null of the columns that a plan imputes, in one pass."""
    cols = [c for c in plan if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "`column` string, strategy string, n_null long, pct_null double")
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    items = [F.struct(F.lit(c).alias("column"), F.lit(plan[c] if isinstance(plan[c], str) else "constant").alias("strategy"), F.col(c).alias("n_null"), F.round(100.0 * F.try_divide(F.col(c), F.col("_n")), 2).alias("pct_null")) for c in cols]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def assess(df: DataFrame, spec: dict, as_of: str, spread_limit: float = 5.0) -> DataFrame:
    """Claims about a dataset's score, each with its evidence and limit; there is no single index of them."""
    dims = dimensions(df, spec, as_of).first().asDict()
    dqs = dims.pop("dqs")
    spread = weight_sensitivity(dims, spec.get("weights", None) or {k: 1 / len(dims) for k in dims})["spread"]
    boot = bootstrap_score(df, spec, as_of).where("dimension = 'dqs'").first().asDict()
    rows = [
        ("El puntaje no depende de los pesos", spread <= spread_limit, f"p05-p95 {spread:.2f}, robustez {sensitivity_verdict(spread, spread_limit)}", f"{spread_limit} puntos"),
        ("El intervalo contiene al puntaje", boot["centred"], f"{boot['low']:.2f} a {boot['high']:.2f}", "95 %"),
        ("La integridad se mide", "integrity" in spec, f"{dims['integrity']:.2f}", "100 fijo si no hay llave"),
        ("El puntaje alcanza el umbral", dqs >= 90, f"{dqs:.2f}", "90"),
    ]
    if spec.get("date"):
        c = year_coverage(df, spec["date"]).first()
        rows.append(("La cobertura no tiene anios vacios", None if c.first_day is None else c.empty_years == 0, f"{c.first_day} a {c.last_day}", "0 anios vacios"))
    return claims(rows, df.sparkSession)
