"""Segment-by-year panels, Empirical-Bayes estimates and black spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import quantiles


def build_panel(segments: DataFrame, years: list[int], events: DataFrame) -> DataFrame:
    """Every segment (seg_id, long_km) x year with explicit zeros: n_eventos, n_fallecidos, expo_km, expo_km_anio, densidad_anual.

    events: seg_id, anio, fallecidos; the grid is an explode of the years, not a join.
    """
    grid = segments.select("seg_id", "long_km", F.explode(F.array(*[F.lit(y).cast("long") for y in years])).alias("anio"))
    n = events.where("seg_id IS NOT NULL").groupBy("seg_id", "anio").agg(F.count("*").alias("n_eventos"), F.sum("fallecidos").alias("n_fallecidos"))
    cells = grid.join(n, ["seg_id", "anio"], "left")
    return cells.select("seg_id", "anio", F.coalesce("n_eventos", F.lit(0)).alias("n_eventos"), F.coalesce("n_fallecidos", F.lit(0)).alias("n_fallecidos"), F.col("long_km").alias("expo_km"), (F.col("long_km") * len(years)).alias("expo_km_anio"), F.try_divide(F.coalesce("n_eventos", F.lit(0)).cast("double"), F.nullif(F.col("long_km").cast("double"), F.lit(0.0))).alias("densidad_anual"))


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_cells"), F.round(100.0 * F.count_if(F.col("n_eventos") == 0) / F.count("*"), 4).alias("pct_zero"), F.sum("n_eventos").alias("total"), F.count_distinct("seg_id").alias("n_segments"))


def panel_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("seg_id").agg(F.sum("n_eventos").alias("total"), F.round(F.avg("n_eventos"), 6).alias("media_anual"), F.sum("n_fallecidos").alias("fallecidos"), F.count_if(F.col("n_eventos") > 0).alias("anios_con_evento"))


def leave_one_out_rate(df: DataFrame, group: str, events: str, exposure: str) -> DataFrame:
    """df with ``prior``: the group's rate without the row itself; where nothing else is left, the whole table's."""
    g, every = Window.partitionBy(group), df.agg(F.sum(events).alias("_ty"), F.sum(exposure).alias("_tx"))
    rows = df.withColumn("_gy", F.sum(events).over(g)).withColumn("_gx", F.sum(exposure).over(g)).join(F.broadcast(every))  # one row
    own = F.try_divide((F.col("_gy") - F.col(events)).cast("double"), F.nullif((F.col("_gx") - F.col(exposure)).cast("double"), F.lit(0.0)))
    whole = F.try_divide((F.col("_ty") - F.col(events)).cast("double"), F.nullif((F.col("_tx") - F.col(exposure)).cast("double"), F.lit(0.0)))
    return rows.withColumn("prior", F.coalesce(own, whole, F.lit(0.0))).drop("_gy", "_gx", "_ty", "_tx")


def prior_strength(df: DataFrame, events: str, exposure: str) -> DataFrame:
    """One row k: mean squared prior over the variance of rates beyond Poisson, weighted by exposure; null: no over-dispersion."""
    x = F.col(exposure).cast("double")
    use = df.where(x >= 1).select(x.alias("w"), (F.col(events) / x).alias("r"), F.col("prior").alias("p"))
    m = use.agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.pow(F.col("r") - F.col("p"), 2)) / F.sum("w")).alias("var"), (F.sum(F.col("p")) / F.sum("w")).alias("noise"), (F.sum(F.col("w") * F.pow("p", F.lit(2))) / F.sum("w")).alias("p2"))
    return m.select(F.when(F.col("var") > F.col("noise"), F.col("p2") / (F.col("var") - F.col("noise"))).alias("k"))


def shrink(df: DataFrame, k: DataFrame, events: str, exposure: str) -> DataFrame:
    """df with eb, weight and excess; without over-dispersion the weight is 0 and the estimate the prior (k_degenerate)."""
    rows = df.join(F.broadcast(k))  # one row
    y, x, p = F.col(events).cast("double"), F.col(exposure).cast("double"), F.col("prior")
    rows = rows.withColumn("k_degenerate", F.col("k").isNull()).withColumn("weight", F.when(F.col("k").isNull(), 0.0).otherwise(x / (x + F.col("k"))))
    rows = rows.withColumn("eb", F.when(F.col("k").isNull(), p).otherwise((y + F.col("k") * p) / (x + F.col("k"))))
    return rows.withColumn("excess", F.try_divide(F.col("eb") - p, F.nullif(p, F.lit(0.0)))).drop("k")


def black_spots(df: DataFrame, region: str, events: str, exposure: str, min_events: int = 3, q: float = 0.95, sources: dict[str, str] | None = None) -> DataFrame:
    """Rows of shrink() that meet one criterion at least: rate over the region's q-quantile, excess or residual over the table's.

    With ``sources`` (column of counts -> name), ``fuente`` names the one with most events, the first among equals.
    """
    x, p = F.col(exposure).cast("double"), F.col("prior")
    rows = df.withColumn("rate", F.col(events) / x).withColumn("residual", (F.col(events) - p * x) / F.sqrt(F.greatest(p * x, F.lit(1e-9))))
    excess, residual = (quantiles(rows, c, [q]).select(F.col("q")[0].alias(name)) for c, name in (("excess", "_qe"), ("residual", "_qr")))
    local = quantiles(rows, "rate", [q], [region]).select(region, F.col("q")[0].alias("_ql"))
    rows = rows.join(local, region).join(F.broadcast(excess)).join(F.broadcast(residual))  # one row each
    c = {"c_p95": F.col("rate") > F.col("_ql"), "c_eb": F.col("excess") > F.col("_qe"), "c_residual": F.col("residual") > F.col("_qr")}
    rows = rows.withColumns(c).withColumn("n_criteria", sum((F.col(k).cast("long") for k in c), F.lit(0).cast("long")))
    if sources:
        most = F.greatest(*[F.coalesce(F.col(k), F.lit(0)) for k in sources]) if len(sources) > 1 else F.col(next(iter(sources)))
        rows = rows.withColumn("fuente", F.coalesce(*[F.when(F.coalesce(F.col(k), F.lit(0)) == most, name) for k, name in sources.items()]))
    return rows.where((F.col("n_criteria") > 0) & (F.col(events) >= min_events)).drop("_qe", "_qr", "_ql")


def panel_years(panel: DataFrame) -> DataFrame:
    """anio, n_eventos, n_fallecidos, pct_zero and densidad (events over exposure) of each year."""
    year = panel.groupBy("anio").agg(F.sum("n_eventos").alias("n_eventos"), F.sum("n_fallecidos").alias("n_fallecidos"), F.round(100.0 * F.avg((F.col("n_eventos") == 0).cast("double")), 4).alias("pct_zero"), F.sum("expo_km").alias("_km"))
    return year.withColumn("densidad", F.round(F.try_divide(F.col("n_eventos").cast("double"), F.col("_km").cast("double")), 8)).drop("_km")
