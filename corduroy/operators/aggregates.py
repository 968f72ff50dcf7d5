"""Declarative aggregations and aggregate helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import quantiles

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def safe_name(name: str) -> str:
    """The name if it is a plain identifier; else ValueError."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"illegal identifier: {name!r}")
    return name


def aggregate(df: DataFrame, spec: dict) -> DataFrame:
    """spec: kind (count_by, sum_by, mean_by), by, value, limit. Rows by falling measure, then by key."""
    by = safe_name(spec["by"])
    if spec["kind"] == "count_by":
        out, first = df.groupBy(by).agg(F.count("*").alias("n")), "n"
    elif spec["kind"] == "sum_by":
        v = safe_name(spec["value"])
        out, first = df.groupBy(by).agg(F.sum(v).alias("total"), F.avg(v).alias("promedio")), "total"
    elif spec["kind"] == "mean_by":
        v = safe_name(spec["value"])
        out, first = df.where(F.col(v).isNotNull()).groupBy(by).agg(F.avg(v).alias("promedio"), F.count(v).alias("n")), "promedio"
    else:
        raise ValueError(f"unknown kind {spec['kind']!r}")
    return out.orderBy(F.desc(first), by).limit(int(spec.get("limit", 20)))


def mode_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent non-null value of each group, the smallest among equals."""
    return df.groupBy(by).agg(F.mode(value, True).alias("moda"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def latest(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each group."""
    cols = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(by, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Rows of both, the one with the greatest stamp for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(stamp))
    return old.unionByName(new, allowMissingColumns=True).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def year_coverage(df: DataFrame, date: str) -> DataFrame:
    """One row: first and last day, rows and days with rows, years without rows inside the span, share of the fullest year."""
    years = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("y")).agg(F.count("*").alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"), F.count_distinct(F.to_date(date)).alias("d"))
    return years.agg(F.min("lo").cast("date").alias("first_day"), F.max("hi").cast("date").alias("last_day"), F.sum("n").alias("n"), F.sum("d").alias("n_days"), (F.max("y") - F.min("y") + 1 - F.count("*")).cast("long").alias("empty_years"), F.round(100.0 * F.max("n") / F.sum("n"), 4).alias("modal_pct"))


def years_without(df: DataFrame, date: str) -> DataFrame:
    """anio: the years without rows between the first and the last one that have some."""
    years = df.where(F.col(date).isNotNull()).select(F.year(date).alias("anio")).distinct()
    span = years.agg(F.min("anio").alias("lo"), F.max("anio").alias("hi")).where("lo IS NOT NULL")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("anio"))
    return every.join(years, "anio", "left_anti")


def rows_by_year(df: DataFrame, date: str) -> DataFrame:
    """anio and n of the years that have rows."""
    return df.where(F.col(date).isNotNull()).groupBy(F.year(date).cast("long").alias("anio")).agg(F.count("*").alias("n"))


def annual_drop(years: DataFrame) -> DataFrame:
    """years (anio, n) with the mean of all earlier years and the drop against it in per cent."""
    earlier = Window.orderBy("anio").rowsBetween(Window.unboundedPreceding, -1)  # a row a year
    out = years.withColumn("_mean", F.avg("n").over(earlier))
    drop = F.round(100.0 * (1 - F.try_divide(F.col("n").cast("double"), F.col("_mean"))), 4)
    return out.select("anio", "n", F.round("_mean", 6).alias("media_previa"), drop.alias("caida_pct"))


def daily_traffic(counts: DataFrame, toll: str, year: str, vehicles: str) -> DataFrame:
    """toll, the last year with counts and its vehicles a day."""
    total = counts.groupBy(toll, year).agg(F.sum(vehicles).alias("n"))
    return latest(total, toll, year).select(toll, year, F.round(F.col("n") / 365.0, 6).alias("imd"))


def by_flag(df: DataFrame, flag: str, value: str) -> DataFrame:
    """n, mean and median of a value where a boolean is true and where it is false."""
    known = df.where(F.col(flag).isNotNull())
    rows = known.groupBy(flag).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("media"))
    return rows.join(quantiles(known, value, [0.5], [flag]).select(flag, F.col("q")[0].alias("mediana")), flag, "left")


def severity_ratio(df: DataFrame, by: list[str], deaths: str) -> DataFrame:
    """Events, deaths and deaths per event of each group."""
    rows = df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(deaths), F.lit(0)).cast("long").alias("fallecidos"))
    return rows.withColumn("por_evento", F.round(F.col("fallecidos") / F.col("n"), 6))


def correlations(df: DataFrame, column: str, others: list[str]) -> DataFrame:
    """column and r: the correlation of one column with each of the others, from one pass."""
    row = df.agg(*[F.corr(F.col(column).cast("double"), F.col(c).cast("double")).alias(f"r{i}") for i, c in enumerate(others)])
    cells = [F.struct(F.lit(c).alias("column"), F.round(F.col(f"r{i}"), 8).alias("r")) for i, c in enumerate(others)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def error_summary(df: DataFrame, error: str, near: float) -> DataFrame:
    """One row: mean, median, 90th, 95th and 99th percentile of an error and the share below ``near`` in per cent."""
    row = df.agg(F.round(F.avg(error), 6).alias("media"), F.round(100.0 * F.avg((F.col(error) < near).cast("double")), 4).alias("pct_cerca"))
    q = quantiles(df, error, [0.5, 0.9, 0.95, 0.99]).select(*[F.round(F.col("q")[i], 9).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))])
    return row.join(F.broadcast(q))  # one row each


def code_match(df: DataFrame, code: str, km: str, catalog: DataFrame) -> DataFrame:
    """One row: rows with a code, those whose code the catalogue (code, km_max) has, their share, and those beyond its last kilometre."""
    last = catalog.groupBy("code").agg(F.max("km_max").alias("_last"))
    held = df.where(F.col(code).isNotNull()).join(last, F.col(code) == last["code"], "left")
    hit = F.col("_last").isNotNull()
    return held.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_match"), F.round(100.0 * F.try_divide(F.count_if(hit), F.count("*")), 4).alias("pct_match"), F.count_if(F.col(km) > F.col("_last")).alias("n_beyond"))


def segment_statistics(segments: DataFrame) -> DataFrame:
    """ruta, n, km_min, km_max, long_km (the sum of lengths) and missing (what the extent has more than the lengths)."""
    low, high = F.least("km0", "km1"), F.greatest("km0", "km1")
    rows = segments.groupBy("ruta").agg(F.count("*").alias("n"), F.min(low).alias("km_min"), F.max(high).alias("km_max"), F.round(F.sum(high - low), 6).alias("long_km"))
    return rows.withColumn("missing", F.round(F.greatest(F.lit(0.0), F.col("km_max") - F.col("km_min") - F.col("long_km")), 6))


def incident_mix(events: DataFrame, by: str, kinds: dict[str, int]) -> DataFrame:
    """For each group the most frequent values of some columns: group, column, valor, n, pct (of the group's events).

    kinds: column -> how many values; blank ones don't count, ties go to the smaller value.
    """
    total = events.groupBy(by).agg(F.count("*").alias("_total"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("valor"), F.lit(k).alias("_k")) for c, k in kinds.items()])).alias("x")
    n = events.select(by, cells).select(by, "x.*").where("length(valor) > 0").groupBy(by, "column", "_k", "valor").agg(F.count("*").alias("n"))
    first = Window.partitionBy(by, "column").orderBy(F.desc("n"), "valor")
    few = n.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= max(kinds.values())).where("_i <= _k")
    return few.join(total, by).select(by, "column", "valor", "n", F.round(100.0 * F.col("n") / F.col("_total"), 1).alias("pct"))


def largest_remainder(df: DataFrame, group: str, total: str, weight: str, order: str) -> DataFrame:
    """df with ``share``: the group's total in whole parts by weight; the largest fractions get what rounding down leaves.

    Shares of a group add up to its total exactly; equal fractions go to the smaller ``order``.
    """
    g = Window.partitionBy(group)
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(g)
    rows = df.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_f").over(g)).withColumn("_n", F.row_number().over(g.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), order)))
    return rows.withColumn("share", (F.col("_f") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_x", "_f", "_left", "_n")


def jaccard(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the share of the distinct non-null values of either table that both have."""
    x, y = (t.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, F.lit(1)) for t, name in ((a, "_a"), (b, "_b")))
    both = x.join(y, column, "full_outer")
    return both.agg(F.round(F.try_divide(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("double"), F.count("*").cast("double")), 6).alias("jaccard"))


def overlap(seen: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """One row: the share, in per cent, of the distinct values seen that the catalogue has."""
    known = catalog.select(column).distinct().withColumn("_ok", F.lit(1))
    held = seen.select(column).where(F.col(column).isNotNull()).distinct().join(known, column, "left")
    return held.agg(F.round(100.0 * F.try_divide(F.count("_ok"), F.count("*")), 4).alias("circularidad"))
